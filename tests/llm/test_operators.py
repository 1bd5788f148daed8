"""Operators on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from tallyglass.llm import bpe, chat, jaccard, lines, mixing, near_vectors, pretokens, quality, repair, sharding, shared_keys, substrings
from tallyglass.llm.bitmaps import with_maybe
from tallyglass.llm.components import components
from tallyglass.llm.queries import tokenizer_file
from tallyglass.llm.shared_keys import Entries
from tallyglass.llm.store import written

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block int, mark string, starts int, row string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def table(spark, rows, sources=None):
    """Documents with extra columns whose names operators use inside."""
    out = [(d, t, None, (sources or {}).get(d, "s"), None if t is None else len(t), 7, "m", 3, "r") for d, t in rows]
    return spark.createDataFrame(out, DOCS)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 4))) for _ in range(60)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    out = []
    for d in range(60):
        w = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 4, 5, 6, 7, 8, 9, 12, 13, 30, 80]))]
        if d % 3 == 0:
            at = r.randint(0, len(w))
            w[at:at] = passage[r.randint(0, 10) : r.randint(24, 40)]
        out.append((d * 2, "".join(x + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for x in w)))
    base = [t for _, t in out if len(t.split()) > 4][:25]
    for k, t in enumerate(base):  # near copies
        w = t.split(" ")
        w[r.randrange(len(w))] = "changed"
        out.append((1001 + k, " ".join(w)))
        out.append((2001 + k, t.upper() if k % 2 else t))
    out += [(3000, None), (3001, ""), (3002, " \n\t "), (3003, "é " * 3000), (3004, "x" * 50_000), (None, out[0][1]), (None, None)]
    return out


def test_substrings(spark, rows):
    got = substrings.remove_repeats(table(spark, rows)).collect()
    want = sorted((str(d), len(brute.words(t)), b" ".join(k).decode()) for (d, t), k in zip(rows, brute.kept_words(rows)))
    assert sorted((str(x.doc_id), x.n_words, x.kept_text) for x in got) == want
    assert all(x.n_removed == sum(s.stop - s.first for s in x.removed) == x.n_words - len(brute.words(x.kept_text)) for x in got)


def test_substrings_tell_rows_that_share_an_id_apart(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long), (5, "own words " + long), (5, "x y"), (5, "own words " + long), (7, "x y " + long + " z"), (7, None)]
    got = substrings.remove_repeats(table(spark, rows)).collect()
    assert sorted((x.doc_id, x.kept_text) for x in got) == [
        (1, long), (5, "own words"), (5, "own words"), (5, "x y"), (7, ""), (7, "x y z"),
    ]


@pytest.mark.parametrize("checked", [False, True])
def test_entries_survive_packing(checked):
    r = np.random.default_rng(3)
    kinds = np.array([-(1 << 63), -5, 0, 7, 1 << 40, (1 << 63) - 1])
    for n in (1, 4, 500):
        made = Entries(
            kinds[r.integers(0, len(kinds), n)], r.integers(0, 2, n), r.integers(0, 1 << 63, n).astype(np.uint64),
            r.integers(0, 1 << 32, n).astype(np.uint32), r.integers(0, 1 << 32, n).astype(np.uint32) if checked else None,
        )
        back, want = shared_keys._unpack(shared_keys._pack(made)), shared_keys._rows(made)[0]
        for column in ("doc", "mark", "key", "place", "check") if checked else ("doc", "mark", "key", "place"):
            assert (getattr(back, column) == getattr(want, column)).all()


def test_lines(spark):
    r = random.Random(2)
    docs = [(d, "\n".join(r.choice(["a b", "c", "", " ", "d e f", "g"]) for _ in range(r.randint(1, 9)))) for d in range(60)]
    docs += [(90, None), (91, ""), (92, "\n\n\n\n"), (93, "q\n" * 3000)]
    got = {x.doc_id: x for x in lines.remove_repeated_lines(table(spark, docs)).collect()}
    for (d, t), want in zip(docs, brute.kept_lines(docs)):
        assert (got[d].text or "") == want, d
        assert got[d].n_lines == (0 if t is None else t.count("\n") + 1)
    assert got[90].text is None and got[5].starts == 3 and got[5].row == "r"


def test_similar_texts(spark, rows):
    got = {x.doc_id: x for x in jaccard.similar_texts(table(spark, rows)).collect()}
    size, part = brute.similar([x for x in rows if x[0] is not None])
    assert {d: (x.n_shingles, x.component_id) for d, x in got.items() if d is not None} == {d: (size[d], part[d]) for d in size}
    assert len(set(part.values())) < len(part) - 20


def test_similar_texts_at_any_boundary(spark, rows, monkeypatch):
    docs = table(spark, [x for x in rows if x[0] is not None])
    _, part = brute.similar([x for x in rows if x[0] is not None])
    for boundary in (1, 12):
        monkeypatch.setattr(jaccard, "choose_boundary", lambda histogram, percent, b=boundary: b)
        assert {x.doc_id: x.component_id for x in jaccard.similar_texts(docs).collect()} == part


@pytest.mark.parametrize("boundary", [None, 1, 12])
def test_similar_texts_count_direct_links(spark, rows, monkeypatch, boundary):
    if boundary:
        monkeypatch.setattr(jaccard, "choose_boundary", lambda histogram, percent: boundary)
    w = [f"chain{i}" for i in range(60)]
    chain = [(9000, " ".join(w[:50])), (9001, " ".join(w[5:55])), (9002, " ".join(w[10:60])), (9003, " ".join(w[10:60]))]
    short = [(9010 + i, " ".join(w[20 : 29 + i])) for i in range(6)]
    own = [x for x in rows if x[0] is not None] + chain + short
    sets = {d: brute.shingles(t) for d, t in own}
    near = lambda a, b: bool(a) and 100 * len(a & b) >= 75 * len(a | b)
    want = {d: sum(near(s, t) for e, t in sets.items() if e != d) for d, s in sets.items()}
    assert want[9000] == 1 and want[9001] == 3 and want[9002] == 2  # 9000 and 9002 meet over 9001 only
    got = jaccard.similar_texts(table(spark, own + [(None, chain[0][1])])).collect()
    assert {x.doc_id: x.n_links for x in got} == want | {None: None}


def test_similar_texts_count_rows_that_share_an_id(spark):
    w = [f"w{i}" for i in range(60)]
    a, b, c = (" ".join(w[i : i + 50]) for i in (0, 5, 10))
    docs = [(1, a), (1, b), (1, b), (2, c), (3, a)]
    sets = [brute.shingles(t) for _, t in docs]
    want = [sum(100 * len(s & t) >= 75 * len(s | t) for t in sets) - 1 for s in sets]
    got = jaccard.similar_texts(table(spark, docs)).collect()
    assert sorted((x.doc_id, x.n_links) for x in got) == sorted((d, n) for (d, _), n in zip(docs, want))


def near_copies(n, words, changes, seed=3):
    """Texts of one base text, each with some words of its own."""
    r = random.Random(seed)
    base = [f"b{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for d in range(n):
        own = list(base)
        for k in range(changes):
            own[r.randrange(words)] = f"own{d}x{k}"
        out.append((d, " ".join(own)))
    return out


def test_lists_of_a_document_are_not_sent_once_for_each(spark, monkeypatch):
    """A document of many lists sends each of them a few times, however many there are."""
    sent = []

    def seen(df, *given):
        sent.append(df.agg(F.count("*"), F.sum(F.size("lists"))).first())
        return paired(df, *given)

    paired = jaccard.in_block_pairs
    monkeypatch.setattr(jaccard, "in_block_pairs", seen)
    docs = near_copies(24, 800, 6)
    got = jaccard.similar_texts(table(spark, docs)).collect()
    sets = [brute.shingles(t) for _, t in docs]
    want = [sum(100 * len(s & t) >= 75 * len(s | t) for t in sets) - 1 for s in sets]
    assert {x.component_id for x in got} == {0} and [x.n_links for x in sorted(got)] == want
    one = jaccard.similar_texts(table(spark, docs[:1] + docs[:1]))  # no lists at all
    assert [x.n_links for x in one.collect()] == [1, 1]
    rows, carried = (sum(x[k] or 0 for x in sent) for k in (0, 1))
    assert 0 < carried and rows <= 24 * 2 * 8 and carried <= 24 * 2 * 8 * 200, sent


@pytest.mark.parametrize("blocks", [2, 7])
def test_large_clusters_by_packed_blocks(spark, rows, monkeypatch, blocks):
    """Clusters and lists of many small blocks give the same; a block of near copies travels in less than its texts."""
    packed = []

    def seen(df, keys):
        packed.append(df.agg(F.sum(F.length("data"))).first()[0])
        return paired(df, keys)

    paired, in_pairs = jaccard.paired, jaccard.in_block_pairs
    monkeypatch.setattr(jaccard, "paired", seen)
    monkeypatch.setattr(jaccard, "in_block_pairs", lambda df, keys, spread, size: in_pairs(df, keys, spread, size, blocks))
    monkeypatch.setattr(jaccard, "CLUSTER_BLOCK", 5 * blocks)
    monkeypatch.setattr(jaccard, "PART_BYTES", 20_000)
    copies = [(10_000 + d, t) for d, t in near_copies(60, 600, 8)]
    docs = [x for x in rows if x[0] is not None] + copies
    sets = {d: brute.shingles(t) for d, t in docs}
    near = lambda a, b: bool(a) and 100 * len(a & b) >= 75 * len(a | b)
    want = {d: sum(near(s, t) for e, t in sets.items() if e != d) for d, s in sets.items()}
    _, part = brute.similar(docs)
    got = {x.doc_id: x for x in jaccard.similar_texts(table(spark, docs)).collect()}
    assert {d: (x.n_links, x.component_id) for d, x in got.items()} == {d: (want[d], part[d]) for d in want}
    assert 0 < packed[0] < sum(len(t) for _, t in copies) / 2


def exchange_files(spark, kept=()):
    """Bytes of each file of an exchange that is not in ``kept``, once those that are removed have gone."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    for _ in range(30 if kept != () else 1):
        found = disk.getAllFiles()
        files = {f.getName(): f.length() for f in (found.apply(i) for i in range(found.size()))}
        left = {n: size for n, size in files.items() if n.startswith("shuffle_") and n not in kept}
        if not left:
            break
        time.sleep(0.1)
    return left


def test_written_tables_leave_no_files_of_exchanges(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, kept = spark.conf.get(key, None), exchange_files(spark)
    summed = written(spark.range(10_000).groupBy(F.col("id") % 100).count(), "summed")
    assert exchange_files(spark, kept) == {} and spark.conf.get(key, None) == before
    assert summed.agg(F.sum("count")).first()[0] == 10_000


def test_third_stage_leaves_no_files_of_exchanges_but_its_last(spark):
    docs = near_copies(10, 300, 6) + [(100 + d, t) for d, t in near_copies(5, 300, 200, seed=4)]
    kept = exchange_files(spark)
    stage = corpus_pipeline.ngram_jaccard(spark, table(spark, docs), "")
    assert exchange_files(spark, kept) == {}
    _, part = brute.similar(docs)
    assert {x.doc_id for x in stage.collect()} == set(part.values())


def test_overlaps_of_lists_are_never_too_low():
    """Entries of one short name count together: the first row has two under name 5, of weight 2 and 3."""
    member, weight = np.array([5, 5, 7, 5, 7, 9]), np.array([2, 3, 1, 2, 1, 4])
    got = jaccard._counts(member, weight, np.array([0, 3, 5, 6]), 0, 3)
    assert got[0, 1] == 6 and got[0, 2] == got[1, 2] == 0


@pytest.mark.parametrize("bitmaps", [1, 64])
def test_bitmaps_miss_no_key(spark, bitmaps):
    own = spark.range(-2000, 4000).withColumn("text", F.lit("t")).unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS id, 't' AS text"))
    keys = spark.range(-2000, 4000, 7)
    got = {r.id: r.maybe for r in with_maybe(own, keys, "id", "maybe", bitmaps).collect()}
    assert len(got) == 6001 and got[None] is False and all(got[k] for k in range(-2000, 4000, 7))
    assert sum(got.values()) < (1100 if bitmaps == 1 else 900)
    assert not any(r.maybe for r in with_maybe(own, keys.limit(0), "id", "maybe").collect())


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(10, 60)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.groups({x for p in links for x in p if x is not None}, [p for p in links if None not in p])
    assert got == {k: v for k, v in want.items() if k != v}


def test_vectors(spark):
    r = np.random.RandomState(0)
    base = r.standard_normal((40, 16))
    rows = [(i, (v + 0.05 * r.standard_normal(16) * (i % 3)).tolist()) for i, v in enumerate(np.repeat(base, 4, 0))]
    rows += [(900, rows[0][1]), (901, [2 * x for x in rows[0][1]]), (902, None), (903, [0.0] * 16), (904, [float("nan")] * 16)]
    rows += [(905, [None] + [1.0] * 15), (906, []), (907, [1.0]), (908, [1.0])]
    got = {x.vec_id: x for x in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    sound = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [
        (a, b) for a in sound for b in sound
        if a < b and len(sound[a]) == len(sound[b]) and sound[a] @ sound[b] / np.sqrt(sound[a] @ sound[a]) / np.sqrt(sound[b] @ sound[b]) >= 0.95
    ]
    found = sum(x.n_links for x in got.values()) / 2
    assert 0.97 * len(links) <= found <= len(links)
    part = brute.groups([i for i, _ in rows], links)
    assert sum(got[i].component_id == part[i] for i in part) >= 0.97 * len(part)
    assert all(got[i].n_links == 0 and got[i].kept for i in (902, 903, 904, 905, 906))


def test_vectors_that_share_an_id(spark):
    r = np.random.RandomState(1)
    v, w, far = r.standard_normal((3, 16))
    rows = [(7, v), (7, w), (7, v + 1e-4 * w), (8, v), (5, w + 1e-4 * v), (9, far)] + [(7, x) for x in r.standard_normal((20, 16))]
    unit = [x / np.sqrt(x @ x) for _, x in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i < j and unit[i] @ unit[j] >= 0.95]
    assert len(links) == 4  # three rows like v, two like w
    part = brute.groups(range(len(rows)), links)
    want = []
    for i, (d, _) in enumerate(rows):
        least = min(rows[j][0] for j in part if part[j] == part[i])
        want.append((d, sum(i in x for x in links), least, d == least))
    docs = spark.createDataFrame([(d, x.tolist()) for d, x in rows], "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in near_vectors.near_vectors(docs).collect()) == sorted(want)


def test_mixing_is_less_than_a_block_off(spark):
    sources = {d: ("big" if d < 700 else "mid" if d < 950 else "low" if d < 990 else None) for d in range(1000)}
    docs = table(spark, [(d, "t") for d in range(1000)], sources)
    got = mixing.mix_sources(docs, {"big": 0.5, "mid": 0.3, "low": 0.2}, block_rows=4, units=10).collect()
    assert sorted(x.doc_id for x in got) == list(range(1000))
    order = sorted({(x.slot, x.source) for x in got})
    assert [s for s, _ in order] == list(range(len(order)))
    share = {"big": 5, "mid": 3, "low": 2, None: 1}
    had = dict.fromkeys(share, 0)
    for n, (_, s) in enumerate(order[:33], 1):  # three periods of 11 units, before a source runs out
        had[s] += 1
        assert all(abs(had[k] - n * u / 11) < 1 for k, u in share.items())
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def mixed_by_hand(sizes, units, block_rows):
    """(source, block) in the order of their slots: earliest due first among the released, then by name."""
    left = {s: -(-n // block_rows) for s, n in sizes.items()}
    had = dict.fromkeys(left, 0)
    out = []
    while any(had[s] < left[s] for s in left):
        own = sorted((s, min(units[s], left[s] - had[s])) for s in left if had[s] < left[s])
        total = sum(u for _, u in own)
        turn = {s: 0 for s, _ in own}
        for t in range(total):
            due = [(-(-(turn[s] + 1) * total // u), s) for s, u in own if turn[s] < u and turn[s] * total // u <= t]
            s = min(due)[1]
            out.append((s, had[s] + turn[s]))
            turn[s] += 1
        for s, u in own:
            had[s] += u
    return out


def test_mixing_many_sources_of_unlike_size(spark):
    r = random.Random(8)
    sizes = {f"s{i:03}": int(1.5 ** r.uniform(1, 15)) for i in range(250)} | {"": 40}
    sources = [s for s, n in sizes.items() for _ in range(n)]
    rows = [(d, s or r.choice(["", None])) for d, s in enumerate(sources)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix_sources(docs, block_rows=4, units=600).collect()
    assert sorted(x.doc_id for x in got) == list(range(len(rows)))
    whole = sum(n**0.5 for n in sizes.values())
    units = {s: max(1, int(n**0.5 / whole * 600 + 0.5)) for s, n in sizes.items()}
    assert len(set(units.values())) > 5
    order = sorted({(x.slot, x.source or "", x.block) for x in got})
    assert [x for x, _, _ in order] == list(range(len(order)))
    assert [(s, b) for _, s, b in order] == mixed_by_hand(sizes, units, 4)


def test_mixing_rows_under_one_id_or_none(spark):
    rows = [(None, "a", f"t{i}") for i in range(200)] + [(7, "a", f"t{i % 3}") for i in range(100)] + [(9, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_sources(docs, {"a": 1.0}, block_rows=3).collect()
    assert Counter((x.doc_id, x.source, x.text) for x in got) == Counter(rows)
    assert len({(x.slot, x.place) for x in got}) == len(rows)
    nth = {(x.doc_id is not None): [] for x in got}
    for x in got:
        if x.source == "a":
            nth[x.doc_id is not None].append(x.block * 3 + x.place)
    assert max(nth[False]) < min(nth[True])  # rows without an id first


def test_sharding_moves_rows_only_to_the_new_shard(spark):
    docs = table(spark, [(d, "é" * (d % 5)) for d in range(3000)] + [(None, None), (None, "a"), (7, "b")])
    got = sharding.shard_rows(docs, [1.0] * 16).collect()
    for shard in range(16):
        assert sorted(x.slot for x in got if x.shard == shard) == list(range(sum(x.shard == shard for x in got)))
    assert {x.grown_shard for x in got if x.grown_shard != x.shard} == {16}
    assert all(x.size == 2 * (x.doc_id % 5) + 1 for x in got if x.doc_id and x.doc_id > 10)
    assert all(x.text_crc32 == zlib.crc32(("é" * (x.doc_id % 5)).encode()) for x in got if x.doc_id and x.doc_id > 10)
    heavy = sharding.shard_rows(docs, [3.0, 1.0, 0.0]).groupBy("shard").count().collect()
    assert {x.shard for x in heavy} == {0, 1} and max(x["count"] for x in heavy) > 2000


def odd_texts():
    r = random.Random(3)
    own = [
        "", " ", "a", "a  b", "a \n b", "it's 's ''s 'sx I'll we've x're'd", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>",
        "　　z", "x" * 300, "!" * 50 + "'s", "\t\tfoo\r\n\r\nbar  ", "日本語 123 ٣٤ ½", "😀😀 😀'm", "\x1cfoo \x1c bar", "​x ​", "x\u0085 y",
    ]
    return own + ["".join(r.choice("ab 'sltrevmd\n\t.,!19é日  ") for _ in range(r.randint(0, 40))) for _ in range(1500)]


def test_bpe_is_the_library(spark, library):
    texts = odd_texts() + [None]
    docs = table(spark, list(enumerate(texts)))
    file = tokenizer_file()
    got = bpe.decode(bpe.encode(docs, file), file).collect()
    for x in got:
        want = library.encode(texts[x.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(x.ids), "<u4").tolist() == want, texts[x.doc_id]
        assert x.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), file).count() == 0


def test_bpe_segment_tree_on_long_pieces(library):
    own = bpe.Vocabulary(open(tokenizer_file(), encoding="utf-8").read())
    r = random.Random(1)
    pieces = ["ab" * 4000, "a" * 5001, "".join(r.choice("etaoin") for _ in range(9000))]
    for piece, ids in zip(pieces, own.encode(pieces)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(piece, add_special_tokens=False).ids


def test_pieces_survive_a_full_table():
    calls = []

    def encode(pieces):
        calls.append(len(pieces))
        return [np.array([len(p)], "<u4").tobytes() for p in pieces]

    encoder = pretokens.PieceEncoder(encode, most=3)
    for _ in range(2):
        assert encoder.ids(["aa bbb c", "dddd e"])[0].tolist() == [2, 4, 2]
    assert len(encoder.key) <= 5 and sum(calls) >= 5


def test_token_files(spark, library):
    texts = odd_texts() + [None]
    docs = table(spark, [(d * 3, t) for d, t in enumerate(texts)] + [(None, "no id")])
    shards = repair.write_shards(docs, tokenizer_file(), shard_ids=5000)
    assert shards.count() > 2
    got = sorted(repair.read_shards(shards).collect(), key=lambda x: x.start)
    at = 0
    assert got[0].doc_id is None
    for x in got:
        text = "no id" if x.doc_id is None else texts[x.doc_id // 3] or ""
        want = library.encode(text, add_special_tokens=False).ids + [2]
        assert (x.start, x.n_tokens, np.frombuffer(bytes(x.ids), "<u4").tolist()) == (at, len(want), want)
        at += len(want)
    assert [x.doc_id for x in got[1:]] == sorted(x.doc_id for x in got[1:])


@pytest.mark.parametrize("n, kinds", [(0, 5), (1, 5), (50, 2), (5000, 3), (5000, 1), (30000, 400)])
def test_shard_reads_any_run(n, kinds):
    r = np.random.RandomState(n)
    ids = r.randint(0, kinds, n).astype(np.uint32)
    shard = repair.Shard(repair.pack_shard([1], [n], ids, 500))
    assert (shard.ids() == ids).all() and (n < 5000 or kinds > 3 or len(shard.symbols) < n / 2)
    for _ in range(30):
        i = r.randint(0, n + 1)
        j = r.randint(i, n + 1)
        assert (shard.ids(i, j - i) == ids[i:j]).all()


def _frequent(sym):
    """Pairs that occur often, without overlapping themselves."""
    count, last = {}, {}
    for i, p in enumerate(zip(sym[:-1].tolist(), sym[1:].tolist())):
        if p[0] != p[1] or last.get(p, -2) != i - 1:
            count[p] = count.get(p, 0) + 1
            last[p] = i
    return {p for p, n in count.items() if n >= repair.LEAST_COUNT}


@pytest.mark.parametrize("kind", ["copies", "random", "run", "text"])
def test_shard_leaves_no_frequent_pair(kind):
    r = np.random.RandomState(3)
    ids = {
        "copies": np.tile(r.randint(0, 400, 700), 64), "random": r.randint(0, 30, 30_000), "run": np.repeat([1, 2, 2, 1], 3000),
        "text": np.minimum(r.zipf(1.3, 40_000), 400),
    }[kind].astype(np.uint32)
    shard = repair.Shard(repair.pack_shard([1], [len(ids)], ids, 500))
    assert not _frequent(shard.symbols)
    assert (shard.ids() == ids).all()
    for i, j in ((0, 1), (7, 900), (len(ids) - 5, len(ids)), (5000, 9000)):
        assert (shard.ids(i, j - i) == ids[i:j]).all()
    if kind == "copies":
        assert len(shard.symbols) <= 64


def test_quality_counts_and_verdict(spark, rows):
    good = [(d, " ".join(f"{w}{d % 7}" for w in (t or "").split()) + " plain words here") for d, t in rows if d is not None]
    bad = [(5000 + d, "!! ".join((t or "x").upper().split()) + "!! $$$ |||") for d, t in good]
    docs = table(spark, good + bad + [(9000, None), (9001, "w " * 40), (None, "a\nb\na\n\n\n")])
    labels = spark.createDataFrame(
        [(d, 1) for d, _ in good] + [(d, 0) for d, _ in bad] + [(None, 1), (77777, 0), (9000, None)], "doc_id long, quality int"
    )
    model = quality.train(docs, labels)
    got = {x.doc_id: x for x in quality.judge(docs, model).collect()}
    long = [d for d, t in good + bad if not got[d].base_failed]
    assert sum(got[d].kept == (d < 5000) for d in long) >= 0.95 * len(long)
    assert got[9000].base_failed and not got[9000].kept and got[9001].n_repeat_words == 40
    assert (got[None].n_words, got[None].n_dup_lines, got[None].word_chars) == (3, 1, 3)
    kept = {x.doc_id for x in quality.judged_rows(docs, model).collect()}
    assert kept == {d for d, x in got.items() if x.kept}
    nothing = quality.train(docs, labels.limit(0))
    assert all(x.kept != x.base_failed for x in quality.judge(docs, nothing).collect())


def test_preference_pairs(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "r"), (0, 3, "assistant", "bb"), (1, 0, "user", "q")]
    turns += [(1, 1, "assistant", "a"), (1, 2, "assistant", None), (2, None, None, "x"), (None, 0, "user", "lost")]
    own = chat.conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    pairs = own.groupBy(F.floor(F.col("conv_id") / 2).alias("pair_id")).agg(
        F.max(F.when(F.col("conv_id") % 2 == 0, F.col("turns"))).alias("chosen"),
        F.max(F.when(F.col("conv_id") % 2 == 1, F.col("turns"))).alias("rejected"),
    )
    got = {x.pair_id: x for x in chat.preference_pairs(pairs).collect()}
    first = got[0]
    assert first.prompt == "<|user|>\nq<|end|>\n<|assistant|>\na<|end|>\n" and first.n_prompt_turns == 2
    assert [first.chosen[s.first : s.stop] for s in first.chosen_mask] == ["bb<|end|>\n"]
    assert [first.rejected[s.first : s.stop] for s in first.rejected_mask] == ["<|end|>\n"] and first.usable
    assert got[1].prompt == "" and got[1].rejected == "" and not got[1].usable


@pytest.mark.parametrize("operator", [substrings.remove_repeats, lines.remove_repeated_lines, jaccard.similar_texts, lambda d: sharding.shard_rows(d, [1.0] * 3)])
def test_empty_tables(spark, operator):
    assert operator(table(spark, [])).collect() == []
    assert near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_word_kernel_matches_bytes_split():
    from tallyglass.llm.words import blocks

    texts = odd_texts()
    got = [b.data[i:j].tobytes() for b in blocks(pa.array(texts), limit=500) for i, j in zip(b.starts, b.ends)]
    assert got == [w for t in texts for w in t.encode().split()]


def thue_morse(n, a, b):
    """A word of two letters; its sums by powers of an odd number modulo 2**64 equal those of the word with both swapped."""
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_long_words_alike_for_sums_of_powers_stay_apart(spark, library, n):
    one, two = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    line = " ".join(f"w{i}" for i in range(6)) + " {} " + " ".join(f"v{i}" for i in range(7))
    texts = [line.format(one), line.format(two), line.format(one)]
    docs = table(spark, [(1, texts[0]), (2, texts[1]), (3, texts[2])])
    assert {x.doc_id: x.n_removed for x in substrings.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 14}
    assert {x.doc_id: x.component_id for x in jaccard.similar_texts(docs).collect()} == {1: 1, 2: 2, 3: 1}
    file = tokenizer_file()
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    got = {x.doc_id: np.frombuffer(bytes(x.ids), "<u4").tolist() for x in bpe.encode(docs, file).collect()}
    assert [got[k] for k in (1, 2, 3)] == want
    got = {x.doc_id: np.frombuffer(bytes(x.ids), "<u4").tolist() for x in repair.read_shards(repair.write_shards(docs, file)).collect()}
    assert [got[k][:-1] for k in (1, 2, 3)] == want
    seven = " ".join(f"w{i}" for i in range(7))
    docs = table(spark, [(1, f"{seven} {one} {seven} {two}"), (2, f"{seven} {one} {seven} {one}")])
    model = quality.fit([], np.zeros(0, np.int64))
    assert {x.doc_id: x.n_repeat_words for x in quality.judge(docs, model).collect()} == {1: 0, 2: 16}


def test_pieces_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(pretokens, "run_hashes", lambda data, starts, size, family=0: np.full(len(starts), 7, np.uint64))
    encoder = pretokens.PieceEncoder(lambda pieces: [np.frombuffer(p.encode("utf-32-le"), "<u4").tobytes() for p in pieces])
    for texts in (["one two", "two one one"], ["three", "one"], ["é one"]):
        assert [ids.tolist() for ids in encoder.ids(texts)] == [[ord(c) for c in t] for t in texts]


def test_long_pieces_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(pretokens, "run_hashes", lambda data, starts, size, family=0: np.full(len(starts), 7, np.uint64))
    encoder = pretokens.PieceEncoder(lambda pieces: [np.frombuffer(p.encode("utf-32-le"), "<u4").tobytes() for p in pieces])
    one, two, three = "abcdefgh", "abcdefghi", "x" * 300 + "y"
    for texts in ([f"{one} {two} {one}"], [two, one, three], [three + "z", f"é {three}"], ["abcdefg", "abcdefg\0", "gfedcba"]):
        assert [ids.tolist() for ids in encoder.ids(texts)] == [[ord(c) for c in t] for t in texts]


def test_pieces_in_bytes_match_the_library(library):
    r = random.Random(8)
    signs = ["a", "Z", "é", "ß", "漢", "🙂", "𝔸", "7", "²", "Ⅷ", "٣", " ", " ", "\n", "\t", "\u00a0", "\u2003", "\u3000", "\x85", "'", "'s", "'re", "'ll", ".", "—", "\0"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["", " ", "\u3000", "x" * 3000, "<|endoftext|>a\u3000<|endoftext|>"]
    encoder, _ = repair._library(open(tokenizer_file(), encoding="utf-8").read())
    for text, ids in zip(texts, encoder.ids(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def _shard_of(texts, least):
    encoder = pretokens.PieceEncoder(lambda pieces: [np.array([ord(c) for c in p], "<u4").tobytes() for p in pieces], most=60)
    held, want = [], []
    for first in range(0, len(texts), 50):  # the table is given up at times
        for text, chain in zip(texts[first : first + 50], encoder.pieces(texts[first : first + 50])):
            held += [*chain, (chain[-1][0], np.array([chain[-1][0].number(2)]))]
            want += [*map(ord, text), 2]
    assert len({id(table) for table, _ in held}) > 1
    return repair.Shard(repair._pack_pieces([1], [len(want)], held, 500, least)), want


def test_shard_of_pieces_leaves_no_frequent_pair():
    r = random.Random(5)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(150)] + ["a" * 40, "ab" * 30]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["a" * 500, "é" * 90]
    shard, want = _shard_of(texts, repair.LEAST_COUNT)
    assert shard.ids().tolist() == want and shard.ids(1234, 777).tolist() == want[1234:2011]
    assert not _frequent(shard.symbols)


def test_pairs_inside_a_piece_are_counted_once_for_all_its_copies(monkeypatch):
    """The rounds look at the distinct pieces first, so the whole row begins with far fewer symbols than ids."""
    rows = []
    replace = repair._replace
    monkeypatch.setattr(repair, "_replace", lambda ids, *rest: rows.append(len(ids)) or replace(ids, *rest))
    shard, want = _shard_of([" ".join(["incomprehensible", "representation", str(k % 70)]) for k in range(600)], repair.LEAST_COUNT)
    assert shard.ids().tolist() == want
    assert len(rows) == 2 and rows[0] < len(want) / 4 and rows[1] < len(want) / 4


def test_equally_frequent_pairs_of_a_passage_take_few_rounds(monkeypatch):
    """All pairs of a repeated passage are equally frequent: one neighbour must not wait for the other along the passage."""
    rounds = []
    sort = np.argsort
    monkeypatch.setattr(repair.np, "argsort", lambda *x, **y: rounds.append(1) or sort(*x, **y))
    passage = np.random.RandomState(2).permutation(2000)[:1000]
    sym, left, _ = repair.compress(np.tile(passage, 20).astype(np.uint32), 2000)
    assert len(left) >= 999 and len(rounds) < 60


@pytest.mark.parametrize("base", [400, 1 << 31])
def test_rules_of_large_symbols(base):
    ids = np.tile(np.random.RandomState(1).randint(0, 400, 500), 30).astype(np.uint32) + np.uint32(base - 400)
    shard = repair.Shard(repair.pack_shard([1], [len(ids)], ids, base))
    assert not _frequent(shard.symbols) and (shard.ids(17, 9000) == ids[17:9017]).all()


def test_words_hash_without_collisions():
    from tallyglass.llm.words import blocks

    r = random.Random(4)
    every = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 40))) for _ in range(40_000)})
    for family in (0, 1):
        found = [h for b in blocks(pa.array([" ".join(every)])) for h in b.hashes(family).tolist()]
        assert len(set(found)) == len(every)


def test_pieces_are_found_in_small_blocks(monkeypatch):
    """A block's arrays are several times its text: it stays below a megabyte of code points unless one text is longer."""
    assert pretokens.BLOCK_CHARS <= 1 << 20
    seen = []
    own = pretokens.PieceEncoder(lambda pieces: [b"\x01\0\0\0"] * len(pieces))
    block = own._block
    monkeypatch.setattr(own, "_block", lambda texts: seen.append(sum(map(len, texts))) or block(texts))
    assert len(own.ids(["word " * 1000] * 1000)) == 1000
    assert max(seen) <= 1 << 20


def test_classes_of_code_points():
    import sys
    import unicodedata

    kinds = {"L": 1, "N": 2}
    want = np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)])
    want[pretokens._WHITE] = 3
    assert (pretokens._classes() == want).all()


def test_token_files_of_one_repeated_id(spark, library):
    texts = [f"text {i} é" * 3 for i in range(300)]
    docs = table(spark, [(7, t) for t in texts] + [(None, t) for t in texts[:200]])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = repair.write_shards(docs, tokenizer_file(), shard_ids=500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards.select("part").distinct().count() > 1
    got = repair.read_shards(shards).collect()
    own = {tuple(library.encode(t, add_special_tokens=False).ids + [2]) for t in texts}
    assert len(got) == 500 and {tuple(np.frombuffer(bytes(x.ids), "<u4").tolist()) for x in got} == own
    at = 0
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == at
        at += x.n_tokens
    assert repair.read_shards(repair.write_shards(docs.limit(0), tokenizer_file())).collect() == []
    one = repair.write_shards(table(spark, [(1, "long " * 9000)]), tokenizer_file(), shard_ids=500, least_count=3)
    assert one.count() == 1 and repair.read_shards(one).first().n_tokens == len(library.encode("long " * 9000).ids) + 1
