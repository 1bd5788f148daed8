"""Sources mixed to target weights by Pfair scheduling, in built-in functions only.

A source's rows form blocks. A weight is a number of units; in a period of as many slots as there are units in all,
block j of a source with u units of Q is released at floor(j Q / u) and due at ceil((j + 1) Q / u). Each slot goes to
the released block that is due first, of several the one whose source comes first by name, so a source is always less
than one block off its share. A source that runs out takes part in one more period with the blocks it has left, and is gone
afterwards. Successive periods with the same sources and units have the same schedule, which is laid out once.

Sources stay rows. How many units a period has, and how many blocks went before it, are running sums of what changes when a
source runs out. Sources with the same units in a period form a class: their blocks have the same windows and take turns by
name, so the sweep over a period's slots keeps one number for each class, and classes are few: sources with different
units add up, so a period of Q slots has fewer than the root of 2 Q of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyglass.llm.numbering import numbered, running_sums
from tallyglass.llm.store import written

BLOCK_ROWS = 16
UNITS = 256
EXPONENT = 0.5  # default weights are rows to this power, which lifts small sources

PERIODS = 65_536  # periods that one row is multiplied by at once
_SLOTS = 256  # slots of a run of the sweep

# One slot after the other, in runs, so that no long list is copied at each slot: `c` counts the blocks that each
# class has had, block c of a class is turn c DIV m of its member c % m.
_TURN = "STRUCT<k: BIGINT, turn: BIGINT>"
_SCHEDULE = f"""
flatten(aggregate(
    sequence(0L, (total - 1) DIV {_SLOTS}),
    named_struct('c', transform(classes, x -> 0L), 'out', CAST(array() AS ARRAY<ARRAY<{_TURN}>>)),
    (st, run) -> transform(
        array(aggregate(
            sequence(run * {_SLOTS}, least(total, (run + 1) * {_SLOTS}) - 1),
            named_struct('c', st.c, 'own', CAST(array() AS ARRAY<{_TURN}>)),
            (s, t) -> transform(
                array(array_min(transform(classes, (x, i) -> if(
                    s.c[i] < x.units * x.m AND ((s.c[i] DIV x.m) * total) DIV x.units <= t,
                    named_struct(
                        'due', ((s.c[i] DIV x.m + 1) * total + x.units - 1) DIV x.units,
                        'k', x.ks[CAST(s.c[i] % x.m AS INT)], 'i', i, 'turn', s.c[i] DIV x.m), NULL)))),
                best -> named_struct(
                    'c', transform(s.c, (n, i) -> if(i = best.i, n + 1, n)),
                    'own', concat(s.own, array(named_struct('k', best.k, 'turn', best.turn)))))[0])),
        s -> named_struct('c', s.c, 'out', concat(st.out, array(s.own))))[0],
    st -> st.out))
"""


def _schedule(sources: DataFrame) -> DataFrame:
    """``src, block, slot`` for each block of ``sources`` (src, k, u, blocks), k their number by name."""
    sources = sources.selectExpr("src", "k", "u", "blocks DIV u AS full", "blocks % u AS rest")
    # Units change by d at period p.
    changes = sources.selectExpr(
        "inline(array(struct(0L AS p, if(full > 0, u, rest) AS d), struct(full AS p, if(full > 0, rest - u, 0L) AS d),"
        " struct(full + 1 AS p, -rest AS d)))"
    )
    steps = changes.groupBy("p").agg(F.sum("d").alias("total")).where("p = 0 OR total <> 0")
    summed = running_sums(steps.selectExpr("p", "total", "total * p AS moved", "1L AS kind"), "p", ["total", "moved", "kind"])
    kinds = written(summed.selectExpr("kind", "p", "total", "p * total - moved AS before"), "kinds")
    following = kinds.selectExpr("kind - 1 AS kind", "p AS next")
    periods = kinds.join(following, "kind").where("total > 0")

    placed = sources.join(kinds.selectExpr("p AS full", "kind AS last"), "full")
    whole = placed.where("last > 1").selectExpr("explode(sequence(1L, last - 1)) AS kind", "u AS units", "k")
    part = placed.where("rest > 0").selectExpr("last AS kind", "rest AS units", "k")
    classes = whole.unionByName(part).groupBy("kind", "units").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    listed = classes.selectExpr("kind", "struct(units, CAST(size(ks) AS BIGINT) AS m, ks) AS class")
    listed = listed.groupBy("kind").agg(F.array_sort(F.collect_list("class")).alias("classes"))
    turns = listed.join(periods.select("kind", "total"), "kind").repartition("kind")
    turns = written(turns.selectExpr("kind", f"posexplode({_SCHEDULE}) AS (at, x)").selectExpr("kind", "at", "x.k AS k", "x.turn AS turn"), "turns")

    each = turns.join(periods, "kind").join(sources.select("src", "k", "u"), "k")
    each = each.withColumn("from", F.explode(F.expr(f"sequence(p, next - 1, {PERIODS}L)")))
    each = each.withColumn("period", F.explode(F.expr(f"sequence(`from`, least(`from` + {PERIODS}, next) - 1)")))
    return each.selectExpr("src", "period * u + turn AS block", "before + (period - p) * total + at AS slot")


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, units: int = UNITS
) -> DataFrame:
    """``docs`` with ``block`` (number in its source), ``slot`` (place of the block in the mix) and ``place`` in it.

    Every row comes out once; sorted by (``slot``, ``place``) the rows are the mix. ``weights`` gives the target
    weight of each source; a source that it does not name gets a weight of 1 unit. Without it a source weighs its
    number of rows to the power 0.5. Weights become whole units, about ``units`` in all, at least one each. Rows
    of a source go in the order of ``doc_id``. A null and an empty source are one source. There may be any number of
    sources; those of one period are swept in one task, as rows of a number each. An empty table gives no rows. Columns
    called ``block``, ``slot`` or ``place`` are replaced.
    """
    others = [c for c in docs.columns if c not in ("block", "slot", "place")]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
        F.col("doc_id").cast("long").alias("id"),
    )
    # A hash beside the id, so that rows under one id lie in several ranges.
    lined = numbered(rows, "src", [F.col("id").asc_nulls_first(), F.xxhash64("row").asc()], "nth")
    sizes = written(lined.groupBy("src").agg(F.count("*").alias("n")), "sources")
    if weights is None:
        weight = F.pow(F.col("n"), F.lit(EXPONENT))
    else:
        named = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)) if weights else None
        weight = F.coalesce(named[F.col("src")], F.lit(0.0)) if named is not None else F.lit(0.0)
    whole = sizes.agg(F.sum(weight).alias("all"))
    share = F.greatest(F.lit(1), F.round(weight / F.greatest("all", F.lit(1e-300)) * units))
    listed = sizes.crossJoin(F.broadcast(whole)).select(
        "src", share.cast("long").alias("u"), F.ceil(F.col("n") / F.lit(block_rows)).cast("long").alias("blocks")
    )
    sources = numbered(listed.withColumn("one", F.lit(0)), "one", [F.col("src").asc()], "k").drop("one")
    # One row for each block, so a document meets it in a join whose keys have at most `block_rows` rows.
    slots = written(_schedule(written(sources, "weights")), "slots")
    placed = lined.selectExpr("row", "src", f"nth DIV {block_rows} AS block", f"CAST(nth % {block_rows} AS INT) AS place")
    mixed = placed.join(slots, ["src", "block"])
    return mixed.select(*(F.col(f"row.`{c}`").alias(c) for c in others), "block", "slot", "place")
