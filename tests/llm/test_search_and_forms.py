"""Identifiers, fill-in-middle forms and ranked search against plain Python versions."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyglass.llm import fim, identifiers, ranked

DOCS = "doc_id long, text string, form string, n long, row string, kind int, m long, term string, item_id string, nth int, vector binary"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "f", 5, "r", 1, 2, "t", "i", 3, b"v") for d, t in rows], DOCS)


# ---------------------------------------------------------------- fill in middle


def plain_form(doc, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:low], lines[low:high], lines[high:]))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows():
    r = random.Random(1)
    rows = [(d, "".join(r.choice(["a", "é", "😀", "\n", "<", "<S", "P>", " "]) for _ in range(r.randint(0, 60)))) for d in range(300)]
    rows += [(400, None), (401, ""), (402, "\n"), (403, "\n\n\n"), (404, "x <P> y\n"), (405, "no break"), (406, "a\r\nb"), (None, "a\nb\nc")]
    return rows + [(407, "long line é " * 40_000 + "\n"), (408, "l\n" * 200_000), (7, "one id\ntwice"), (7, "one id\ntwice"), (-5, "a\nb")]


def test_forms(spark):
    rows = fim_rows()
    got = fim.fill_in_middle(table(spark, rows))
    assert got.columns == ["doc_id", "text", "row", "kind", "m", "term", "item_id", "nth", "vector", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = got.withColumn("back", fim.restore(F.col("form"), F.col("output"))).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    want = sorted(((d, t, *plain_form(d, t)) for d, t in rows), key=key)
    assert sorted(((x.doc_id, x.text, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in back), key=key) == want
    assert all(x.back == (x.text or "") for x in back)
    assert {x.form for x in back} == {"plain", "psm", "spm"}


def test_forms_by_share(spark):
    docs = table(spark, [(d, "a\nb") for d in range(1000)])
    share = {r.form: r["count"] for r in fim.fill_in_middle(docs, seed=3, plain_percent=30, spm_percent=0).groupBy("form").count().collect()}
    assert set(share) == {"plain", "psm"} and 230 < share["plain"] < 370
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


# ---------------------------------------------------------------- ranked search


def terms_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def plain_ranks(items, docs, k=50):
    own = [Counter(terms_of(t)) for _, t in docs]
    n_docs, n_terms = sum(bool(c) for c in own), sum(c.total() for c in own)
    df = Counter(t for c in own for t in c)
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(terms_of(text))
    out = []
    for i, terms in asked.items():
        scores = []
        for (d, _), c in zip(docs, own):
            if not c:
                continue
            m = 50 + (50 * c.total() * n_docs) // n_terms
            w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms & c.keys()}
            score = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in w)
            if score > 0:
                scores.append((-score, (d is not None, d), d))
        out += [(i, n, d, -s) for n, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def search():
    r = random.Random(2)
    words = ["".join(r.choice("abcdé0") for _ in range(r.randint(1, 3))) for _ in range(80)] + ["Straße", "THE", "naïve", "x" * 3000]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "\n", "_", "\x7f"]) for _ in range(n))
    docs = [(d, text(r.randint(0, 40))) for d in range(300)]
    docs += [(1000 + k, docs[5][1].upper() if k % 2 else docs[5][1]) for k in range(120)]  # a large class
    docs += [(2000 + k, "b a") for k in range(70)] + [(3000, None), (3001, ""), (3002, ".,_"), (None, docs[7][1]), (7, "again under one id a b")]
    docs += [(3003, text(4000)), (3004, "the " * 20_000)]
    items = [(i, text(r.randint(1, 12))) for i in range(30)] + [(40, None), (41, ""), (42, "zzz qqq"), (43, "a b"), (43, "c"), (None, "the a")]
    return items, docs


@pytest.mark.parametrize("block_terms, k", [(200_000, 50), (40, 50), (200_000, 3)])
def test_ranks(spark, search, block_terms, k):
    items, docs = search
    asked = spark.createDataFrame([(i, t, "d", 1, 2.0) for i, t in items], "item_id long, text string, doc_id string, rank int, score double")
    got = ranked.rank_documents(asked, table(spark, docs).repartition(7), k, block_terms).collect()
    assert sorted((tuple(x) for x in got), key=str) == plain_ranks(items, docs, k)


def test_ranks_of_empty_tables(spark, search):
    items, docs = search
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert ranked.rank_documents(asked, table(spark, docs[:0])).collect() == []
    assert ranked.rank_documents(asked, table(spark, [(1, None), (2, ".")])).collect() == []
    none = ranked.rank_documents(asked.limit(0), table(spark, docs))
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_of_one_hash_stay_apart(monkeypatch, spark):
    import numpy as np

    monkeypatch.setattr(ranked, "run_hashes", lambda data, starts, size, family=0: np.full(len(starts), 9, np.uint64))
    vocabulary, number = ranked._vocabulary([b"a", b"bb", b"ccc"])
    data = np.frombuffer(b"ccc dd a bb", np.uint8)
    found = vocabulary.numbers(data, np.array([0, 4, 7, 9]), np.array([3, 2, 1, 2]))
    assert found.tolist() == [number[2], -1, number[0], number[1]]


# ---------------------------------------------------------------- identifiers


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[ -]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_rules_are_the_patterns():
    r = random.Random(3)
    parts = ["a", "B9", "@", ".", "-", " ", "1", "25", "256", "4111111111111111", "4111 1111-1111 1111", "+", "(", ")", "é", "\n", "x@y.z", "10.0.0.1", "+1 (234) 555-0199"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(6000)]
    texts += ["", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8.9", "1.2.3", "0001.0.0.0255", "+1 " + " " * 500, "%+-@-.-", "a@b..c", "4" * 400, "9" * 4000 + ".1.1.1"]
    for text in texts:
        assert [(identifiers.KINDS[k], i, j) for k, i, j in identifiers._Text(text).spans] == plain_spans(text), text


def test_rules_are_linear():
    import time

    n = 200_000
    began = time.time()
    for text in ("a" * n, "1" * n, "a" * n + "@", "@" * n, "1." * n, "1 " * n, "+1" + " " * n, "+1 " * n, "a@" * n, "-" * n):
        identifiers._Text(text).mentions()
    assert time.time() - began < 60


def spans_of(x):
    return [(s.kind, s.start, s.stop) for s in x.spans if s.base]


def test_spans_of_rules(spark):
    rows = [(1, "write to ann@example.org or +1 (234) 555-0199 ok"), (2, None), (3, ""), (4, "x" * 60_000 + " 10.0.0.1"), (None, "10.0.0.1"), (None, "10.0.0.1")]
    rows += [(5, "é😀 10.0.0.1 4111 1111 1111 1111"), (5, "nothing"), (6, "300.1.1.1 4111 1111 1111 1112 +1 2345")]
    got = identifiers.find_identifiers(table(spark, rows)).collect()
    assert sorted(((x.doc_id is None, x.doc_id or 0), spans_of(x)) for x in got) == sorted(((d is None, d or 0), plain_spans(t)) for d, t in rows)
    for x in got:
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(s.kind == k and s.base for s in x.spans) for k in identifiers.KINDS)
    assert identifiers.find_identifiers(table(spark, [])).collect() == []


def test_patterns_discover_identifiers(spark):
    rows = [(k, f"please call office phone: +1 (234) 555-{1000 + k} today") for k in range(12)]
    rows += [(50 + k, f"please call office phone: +1 (234) 555-{1000} today") for k in range(40)]  # copies tell nothing new
    rows += [(100, "the office phone: 555-0199 (home) today"), (101, "another 555-0199 elsewhere"), (102, "version 3.5 of 2004, room 12b")]
    # Words before seeds of several kinds say nothing, and few seeds say nothing.
    rows += [(200 + k, f"see 10.0.0.{k} or") for k in range(8)] + [(300 + k, f"see x{k}@y.org or") for k in range(8)] + [(400, "see page7b or")]
    rows += [(500 + k, f"host: 10.0.1.{k} up") for k in range(3)] + [(510, "host: srv12 up")]
    # What a rule dropped stays dropped.
    sound = [n for n in range(1111, 1400) if luhn(f"411111111111{n}")][:14]
    rows += [(600 + k, f"card number 4111 1111 1111 {n}") for k, n in enumerate(sound)]
    rows += [(650, "card number 4111 1111 1111 1112"), (651, "card number 4111-xxxx-1112")]
    got = {x.doc_id: x for x in identifiers.find_identifiers(table(spark, rows)).collect()}
    text = dict(rows)
    more = {(d, s.kind, text[d][s.start : s.stop]) for d, x in got.items() for s in x.spans if not s.base}
    assert more == {
        (100, "phone", "555-0199"), (101, "phone", "555-0199"), (651, "card", "4111-xxxx-1112"),
    }
    for d, x in got.items():
        assert spans_of(x) == plain_spans(text[d])
        order = [(identifiers.KINDS.index(s.kind), s.start) for s in x.spans]
        assert order == sorted(order)


def test_graph_scores(spark):
    edges = [("p", f"s{k}", 0) for k in range(9)] + [("p", "u", None), ("q", "u", None), ("q", "v", None)] + [("q", f"s{k}", 0) for k in range(9)]
    edges += [("r", f"t{k}", 1) for k in range(4)] + [("r", "v", None), ("o", "s1", 0), ("o", "w", None)]
    table = spark.createDataFrame(edges, "pattern string, value string, kind int")
    got = {x.value: (x.kind, round(x.score, 3)) for x in identifiers.score_graph(table, trust=0.75, accept=0.7).collect()}
    # p: 9 of 11 at first, q: 9 of 12. Then u counts for p, u and v for q.
    p, q = (9 / 11, 9 / 12)
    for _ in range(2):
        u, v = 1 - (1 - p) * (1 - q), q
        p, q = (9 + u) / 11, (9 + u + v) / 12
    assert got == {"u": (0, round(1 - (1 - p) * (1 - q), 3)), "v": (0, round(q, 3))}
