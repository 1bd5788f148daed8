import itertools
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallyglass.operators import chunking as c

DOC = "source string, doc_type string, content string"


def sections(spark, text):
    df = spark.createDataFrame([("d", "t", text)], DOC)
    return [(r["section"], r["section_text"], r["section_start"]) for r in c.split_sections(df).orderBy("section_no").collect()]


def test_sections(spark):
    text = "# Title\n\n## One\na\n### deep\nb\n## Two \nc"
    got = sections(spark, text)
    assert [(s, o) for s, _, o in got] == [("One", 9), ("Two", 29)]
    assert all(text[o:].startswith(t) for _, t, o in got)
    assert "### deep" in got[0][1]


def test_preamble_is_kept_with_its_title_when_it_has_a_body(spark):
    assert sections(spark, "# T\nhello\n## A\nx")[0] == ("", "# T\nhello\n", 0)
    assert sections(spark, "# T\n\n## A\nx")[0][0] == "A"
    assert sections(spark, "no header at all") == [("", "no header at all", 0)]
    assert sections(spark, "# only a title") == []
    assert sections(spark, "") == []
    assert sections(spark, "## \nnot a header") == [("", "## \nnot a header", 0)]
    assert sections(spark, "text ## A\nx") == [("", "text ## A\nx", 0)]


def test_titles(spark):
    rows = [("# A b \nx", "A b"), ("x\n#  Late\n", "Late"), ("## no", ""), ("#no space", ""), ("", "")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", c.doc_title("t")).collect())


def reference_windows(text, size, overlap):
    spans = [m.span() for m in re.finditer(r"[^ \t\n\r\f]+", text)]
    out, pos = [], 0
    while pos < len(spans):
        end = min(pos + size, len(spans))
        out.append((spans[pos][0], spans[end - 1][1], end - pos))
        if end >= len(spans):
            break
        pos += size - overlap
    return out


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 224, 255, 256, 257, 288, 289, 480, 481, 512, 600, 1000])
def test_window_edges(spark, n):
    text = "  " + " \n".join(f"w{i}" for i in range(n))
    rows = c.window_chunks(spark.createDataFrame([(text,)], "t string"), "t").orderBy("window_no").collect()
    assert [(r["text_start"], r["text_end"], r["token_count"]) for r in rows] == reference_windows(text, 256, 32)
    assert all(text[r["text_start"] : r["text_end"]] == r["content"] for r in rows)
    if n == 600:
        assert [r["token_count"] for r in rows] == [256, 256, 152]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    texts=st.lists(st.text(alphabet="ab éß漢😀\n\t#", max_size=120), min_size=1, max_size=20),
    size=st.integers(1, 9),
    data=st.data(),
)
def test_windows_match_a_plain_loop(spark, texts, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in c.window_chunks(df, "t", size, overlap).orderBy("id", "window_no").collect():
        got.setdefault(r["id"], []).append((r["text_start"], r["text_end"], r["token_count"]))
        assert texts[r["id"]][r["text_start"] : r["text_end"]] == r["content"]
    assert got == {i: w for i, t in enumerate(texts) if (w := reference_windows(t, size, overlap))}


def test_overlap_must_be_smaller_than_the_window(spark):
    with pytest.raises(ValueError):
        c.window_chunks(spark.createDataFrame([("a",)], "t string"), "t", 4, 4)


def _spans(text):
    return [m.span() for m in re.finditer(r"[^ \t\n\r\f]+", text)]


def test_plugged_tokenizer_gives_the_same_chunks(spark):
    def make():
        import re

        return lambda t: [m.span() for m in re.finditer(r"[^ \t\n\r\f]+", t)]

    text = "# T\nlead in\n## A\n" + " ".join(f"w{i}" for i in range(300)) + "\n## B\n\n## C\n" + "x é " * 140
    df = spark.createDataFrame([("a", "t", text), ("b", "t", "# T"), ("c", "t", "one")], DOC)
    built_in = sorted(map(tuple, c.chunk_documents(df, 50, 10).collect()))
    plugged = sorted(map(tuple, c.chunk_documents(df, 50, 10, tokenizer=make).collect()))
    assert built_in == plugged and len(built_in) > 10


def test_chunk_records(spark):
    text = "# T\nintro words\n## A\n" + " ".join("abcdefghij") + "\n## A\nagain"
    rows = c.chunk_documents(spark.createDataFrame([("f.md", "policy", text)], DOC), 4, 1).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert all(text[r["char_start"] : r["char_end"]] == r["content"] for r in rows)
    assert {r["doc_title"] for r in rows} == {"T"} and [r["section"] for r in rows][-1] == "A"
    assert len({r["chunk_id"] for r in rows}) == len(rows)


def test_chunking_does_not_shuffle(spark):
    df = spark.createDataFrame([("a", "t", "x")], DOC)
    plan = c.chunk_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Filter (size" not in plan


def test_overlap_with_neighbours(spark):
    rows = [("1", "s", "A", 0, 0, 10), ("2", "s", "A", 1, 6, 20), ("3", "s", "A", 2, 8, 12), ("4", "s", "B", 3, 9, 30), ("5", "z", "B", 4, 0, 5)]
    df = spark.createDataFrame(rows, "chunk_id string, source string, section string, chunk_index int, char_start int, char_end int")
    got = {r["chunk_id"]: (r["shared_prefix"], r["shared_suffix"]) for r in c.chunk_overlap(df).collect()}
    # Chunk 2 starts in 4 shared characters; its end could share 12 but only 10 are left.
    assert got == {"1": (0, 4), "2": (4, 10), "3": (4, 0), "4": (0, 0), "5": (0, 0)}


def test_token_positions_of_a_long_text(spark):
    text = "\n " + "  ".join(f"tok{i}" for i in range(3000)) + " "
    rows = c.token_positions(spark.createDataFrame([(1, text)], "id int, t string"), "t").orderBy("token_no").collect()
    assert [(r["char_start"], r["char_end"]) for r in rows] == _spans(text)
    assert [r["token_no"] for r in rows] == list(range(3000))


def test_running_sums_at_the_edges_of_their_runs(spark):
    sizes = [0, 1, 63, 64, 65, 128, 4095, 4096, 4097, 9000]
    df = spark.createDataFrame([(n, [(i * 7) % 5 for i in range(n)]) for n in sizes] + [(-1, None)], "n int, x array<int>")
    for n, x, got in df.select("n", "x", c._running(F.col("x")).alias("got")).collect():
        assert got == (None if x is None else [0, *itertools.accumulate(x)]), n


def test_many_sections_start_where_they_should(spark):
    text = "".join(f"## s{i}\n" + "x" * (i % 7) + "\n" for i in range(5000))
    rows = c.split_sections(spark.createDataFrame([(1, text)], "id int, content string")).collect()
    assert len(rows) == 5000
    assert all(text[r.section_start :].startswith(r.section_text) for r in rows)


def test_token_positions_count_characters_of_their_own_text(spark):
    texts = ["é\U0001f600a  b\u00a0c\n", None, "", " \t", "x", "\u2003y z", "tok " * 3000]
    rows = c.token_positions(spark.createDataFrame([(i, t, [i]) for i, t in enumerate(texts)], "id int, t string, k array<int>"), "t")
    assert [x.simpleString() for x in rows.schema] == ["id:int", "k:array<int>", "token_no:int", "token:string", "char_start:int", "char_end:int"]
    assert "Generate" not in rows._jdf.queryExecution().optimizedPlan().toString()
    for i, t in enumerate(texts):
        got = rows.where(F.col("id") == i).orderBy("token_no").collect()
        want = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^ \t\n\r\f]+", t or "")]
        assert [(r.token, r.char_start, r.char_end) for r in got] == want
        assert [r.token_no for r in got] == list(range(len(want))) and all(r.k == [i] for r in got)
