"""Personal identifiers in texts: four plain rules, and a bootstrap that learns where they stand.

Spans that the rules find are seeds. The words around a seed make lexical patterns (the word before it, the two words
before it, the words on both sides); the slot of a pattern takes strings that hold a digit or an @. Patterns and the
strings in their slots (instances) are the two sides of a graph, which Spark scores in rounds: a pattern trusts a kind
by the share of its instances that are of it, an unknown instance gathers the trust of its patterns. Instances that
reach the bar are identifiers wherever they stand, and seeds are too where a rule passed over them.

All rules look at a text in linear time. Strings, not rows, are counted, so copies of a document add nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.llm.store import written
from tallyglass.llm.worker import tidy

KINDS = ("email", "ip", "card", "phone")
_EMAIL, _IP, _CARD, _PHONE = range(4)

MIN_SEEDS = 5  # distinct seeds of one kind that a pattern must have
TRUST = 0.8  # share of a pattern's instances, one more than there are, from which on it speaks for a kind
ACCEPT = 0.8  # score of an instance that counts as an identifier
ROUNDS = 3

# The characters of each rule.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_DIGITS = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_MARK = re.compile(r"[0-9@]")
_NUMBER = re.compile(r"[0-9]+")
_FLAT = str.maketrans("\t\n\v\f\r", "     ")
_OPENING, _CLOSING = " \"'([{<", " \"')]}>.,;:!?"
_AROUND = "\"'()[]{}<>.,;:!?"


def emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """Each @ takes what can be a name on its left, behind the match before, and needs a dotted name on its right."""
    done = 0
    at = text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        domain = _DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            done = domain.end()
            yield first, done, True
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int, bool]]:
    """Runs of digits between single dots, four by four from the first one on."""
    for chain in _DOTTED.finditer(text):
        runs = [m.span() for m in _NUMBER.finditer(text, *chain.span())]
        for k in range(0, len(runs) - 3, 4):
            own = runs[k : k + 4]
            sound = all(len(part := text[i:j].lstrip("0")) <= 3 and int(part or "0") <= 255 for i, j in own)
            yield own[0][0], own[3][1], sound


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        yield m.start(), m.end(), 16 <= len(digits) <= 19 and _luhn(digits)


def phones(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _DIALLED.finditer(text):
        yield m.start(), m.end(), 8 <= sum(c.isdigit() for c in m.group()) <= 15


_RULES = (emails, addresses, cards, phones)


class _Text:
    """A text with the spans that the rules found, and the words next to a place."""

    def __init__(self, text: str):
        self.text = text
        self.flat = text.translate(_FLAT)
        self.spans: list[tuple[int, int, int]] = []
        self.dropped: set[tuple[int, int, int]] = set()
        for kind, rule in enumerate(_RULES):
            for first, stop, sound in rule(text):
                if sound:
                    self.spans.append((kind, first, stop))
                else:
                    self.dropped.add((kind, first, stop))
        self.ends = {stop: (first, kind) for kind, first, stop in reversed(self.spans)}
        self.starts = {first: kind for kind, first, _ in reversed(self.spans)}
        self.all_ends, self.all_starts = sorted(self.ends), sorted(self.starts)

    # A word next to a place ends at a space or at a span, so that texts without spaces are not read again and again.
    def _left(self, at: int) -> tuple[str, int]:
        while at and self.flat[at - 1] in _OPENING and at not in self.ends:
            at -= 1
        if at in self.ends:
            first, kind = self.ends[at]
            return f"<{KINDS[kind]}>", first
        before = bisect_left(self.all_ends, at)
        low = self.all_ends[before - 1] if before else 0
        first = max(low, self.flat.rfind(" ", low, at) + 1)
        return _NUMBER.sub("0", self.flat[first:at].lower()) if at else "^", first

    def _right(self, at: int) -> str:
        while at < len(self.flat) and self.flat[at] in _CLOSING and at not in self.starts:
            at += 1
        if at in self.starts:
            return f"<{KINDS[self.starts[at]]}>"
        behind = bisect_right(self.all_starts, at)
        high = self.all_starts[behind] if behind < len(self.all_starts) else len(self.flat)
        stop = self.flat.find(" ", at, high)
        return _NUMBER.sub("0", self.flat[at : high if stop < 0 else stop].lower()) if at < len(self.flat) else "$"

    def patterns(self, first: int, stop: int) -> list[str]:
        near, at = self._left(first)
        far, _ = self._left(at)
        return [f"{near} _", f"{far} {near} _", f"{near} _ {self._right(stop)}"]

    def unknown(self) -> Iterator[tuple[int, int]]:
        """Strings with a digit or an @ outside all spans; neighbours that are one space apart are one string."""
        cover: list[tuple[int, int]] = []
        for _, first, stop in sorted(self.spans, key=lambda s: s[1]):
            if cover and first < cover[-1][1]:
                cover[-1] = (cover[-1][0], max(stop, cover[-1][1]))
            else:
                cover.append((first, stop))
        free, held = 0, None
        for low, high in [*cover, (len(self.text), len(self.text))]:
            at = free
            while mark := _MARK.search(self.flat, at, low):
                first = max(self.flat.rfind(" ", free, mark.start()) + 1, free)
                stop = self.flat.find(" ", mark.end(), low)
                stop = low if stop < 0 else stop
                if held and first == held[1] + 1 and held[1] >= free:
                    held = (held[0], stop)
                else:
                    if held:
                        yield held
                    held = (first, stop)
                at = stop
            if held:
                yield held
            free, held = high, None

    def mentions(self) -> list[dict]:
        out = [self._mention(first, stop, kind) for kind, first, stop in self.spans]
        for first, stop in self.unknown():
            while first < stop and self.text[first] in _AROUND:
                first += 1
            while first < stop and self.text[stop - 1] in _AROUND:
                stop -= 1
            if first < stop:
                out.append(self._mention(first, stop, None))
        return out

    def _mention(self, first: int, stop: int, kind: int | None) -> dict:
        return {
            "start": first, "stop": stop, "value": self.flat[first:stop].lower(), "kind": kind,
            "dropped": [k for k in range(len(KINDS)) if (k, first, stop) in self.dropped],
            "patterns": self.patterns(first, stop),
        }


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
_MENTIONS = pa.list_(
    pa.struct(
        [
            ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string()), ("kind", pa.int32()),
            ("dropped", pa.list_(pa.int32())), ("patterns", pa.list_(pa.string())),
        ]
    )
)
_FOUND = (
    "row long, doc_id long, spans array<struct<kind:int,start:int,stop:int>>, mentions array<struct<start:int,stop:int,"
    "value:string,kind:int,dropped:array<int>,patterns:array<string>>>"
)


def _found(docs: DataFrame) -> DataFrame:
    """Of each row its number, the spans of the rules, and all mentions with their patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column("text").cast(pa.large_string())
                some = pc.match_substring_regex(texts, "[0-9@]")
                own = (_Text(t) for t in texts.filter(some).to_pylist())
                spans: list[list] = []
                mentions: list[list] = []
                for hit in some.to_pylist():
                    text = next(own) if hit else None
                    spans.append([{"kind": k, "start": i, "stop": j} for k, i, j in text.spans] if text else [])
                    mentions.append(text.mentions() if text else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(spans, _SPANS), pa.array(mentions, _MENTIONS)],
                    ["row", "doc_id", "spans", "mentions"],
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.mapInArrow(tidy(run), _FOUND)


def score_graph(edges: DataFrame, min_seeds: int = MIN_SEEDS, trust: float = TRUST, accept: float = ACCEPT, rounds: int = ROUNDS) -> DataFrame:
    """``value, kind, score`` of unknown instances that are accepted, from ``pattern, value, kind`` (null: unknown).

    Edges are distinct. A pattern's trust in a kind is the share of its instances that are of it, unknown ones with
    their score, among one more than there are; where ``trust`` is reached, the pattern speaks for the kind. The score of
    an instance is 1 less the product of what its speakers lack. Patterns that could never reach the bar, even if all
    their unknown instances were of a kind, and those without an unknown instance are left out before the rounds.
    """
    n = F.count("*").alias("total")
    unknown = F.count_if(F.col("kind").isNull()).alias("n_unknown")
    seen = edges.groupBy("pattern").agg(n, unknown, *(F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(len(KINDS))))
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"n{k}").alias("n_seeds")) for k in range(len(KINDS)))))
    able = seen.where("n_unknown > 0").select("pattern", "total", "n_unknown", each)
    able = able.where((F.col("n_seeds") >= min_seeds) & (F.col("n_seeds") + F.col("n_unknown") >= trust * (F.col("total") + 1)))
    able = written(able, "patterns")
    open_edges = edges.where("kind IS NULL").select("pattern", "value").join(able.select("pattern", "kind"), "pattern")
    open_edges = written(open_edges, "open-edges")
    scores = None
    for _ in range(rounds):
        gathered = F.lit(0.0)
        told = able
        if scores is not None:
            sums = open_edges.join(scores, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("gathered"))
            told = able.join(sums, ["pattern", "kind"], "left")
            gathered = F.coalesce("gathered", F.lit(0.0))
        share = ((F.col("n_seeds") + gathered) / (F.col("total") + 1)).alias("share")
        speakers = told.select("pattern", "kind", share).where(F.col("share") >= trust)
        spoken = open_edges.join(speakers, ["pattern", "kind"]).groupBy("value", "kind")
        scores = written(spoken.agg((1 - F.exp(F.sum(F.log(1 - F.col("share"))))).alias("score")), "scores")
    best = scores.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("kind"))).alias("best"))
    return best.select("value", (-F.col("best.kind")).alias("kind"), F.col("best.score").alias("score")).where(F.col("score") >= accept)


def _named(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.transform(
        spans, lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["base"].alias("base"))
    )


def find_identifiers(docs: DataFrame, min_seeds: int = MIN_SEEDS, trust: float = TRUST, accept: float = ACCEPT, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, spans`` of each row of ``docs``.

    ``spans`` are ``kind, start, stop`` in code points and ``base``: whether a rule found it. They go by kind (as
    in ``KINDS``), then place; the counts are of those that rules found. A span that was learnt lies outside all
    others, and its string is none that the rule of its kind matched and dropped. Null and empty texts have no spans.
    Rows without ``doc_id`` or under a repeated one are rows each. Other columns are ignored.
    """
    found = written(_found(docs), "identifiers")
    mentions = found.select("row", F.inline("mentions"))
    edges = mentions.select(F.explode("patterns").alias("pattern"), "value", "kind").distinct()
    seeds = mentions.where("kind IS NOT NULL").groupBy("value").agg(F.min("kind").alias("kind"))
    seeds = written(seeds, "seeds")
    # A string that a rule knows elsewhere is no unknown one.
    fresh = edges.where("kind IS NULL").join(seeds.select("value"), "value", "left_anti")
    edges = written(edges.where("kind IS NOT NULL").unionByName(fresh), "edges")
    learnt = score_graph(edges, min_seeds, trust, accept, rounds).select("value", "kind").unionByName(seeds)
    open_mentions = mentions.where("kind IS NULL").select("row", "start", "stop", "value", "dropped")
    more = open_mentions.join(learnt, "value").where(~F.array_contains("dropped", F.col("kind")))
    more = more.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "stop", F.lit(False).alias("base"))).alias("more"))
    none = F.array().cast("array<struct<kind:int,start:int,stop:int,base:boolean>>")
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.lit(True).alias("base")))
    both = found.join(more, "row", "left").select(
        "doc_id",
        *(F.expr(f"CAST(size(filter(spans, s -> s.kind = {k})) AS LONG)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.array_sort(F.concat(base, F.coalesce("more", none))).alias("spans"),
    )
    return both.withColumn("spans", _named(F.col("spans")))
