"""Mixing sources to target weights by capped water-filling.

A budget of words is shared among the sources by weight. A source whose share would pass its cap (``max_epochs`` times its size)
is clamped there and what it cannot take is shared again among the others by weight, until none is above. Each source then
repeats all its documents as often as whole epochs fit; the fraction that is left takes documents once more in a seeded order,
the last of them in part, so that the words taken equal the rounded target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, free_name, packed, settled, spread, word_array, word_count, written

#: Hexadecimal digits of the draw that one level of the search for a source's boundary looks at.
_DIGITS, _LEVELS = 2, 2


def water_fill(sources: DataFrame, budget: float, *, cap: Column) -> DataFrame:
    """``sources`` (with weight double) with target double: min(cap, level * weight), the level such that targets add up to the budget.

    Every round is one aggregation over all sources, whose number is not bounded; only its sums come to the driver. Sources of
    zero cap get 0. If all caps together stay below the budget, every source gets its cap.
    """
    table = sources.withColumns({"_cap": cap.cast("double"), "_ratio": cap.cast("double") / F.col("weight")})
    ceiling = 0.0
    while True:
        clamped = F.col("_ratio") <= ceiling
        row = table.agg(F.sum(F.when(clamped, F.col("_cap"))).alias("held"), F.sum(F.when(~clamped, F.col("weight"))).alias("weight")).first()
        if not row["weight"]:
            level = float("inf")
            break
        level = (budget - (row["held"] or 0.0)) / row["weight"]
        if level <= ceiling or not table.where((F.col("_ratio") <= level) & ~clamped).take(1):
            break
        ceiling = level
    return table.withColumn("target", F.when(F.col("_ratio") <= level, F.col("_cap")).otherwise(level * F.col("weight"))).drop("_cap", "_ratio")


def cyclic_weights(sources: DataFrame, source_col: str, weights: Sequence[float]) -> DataFrame:
    """Weights repeating along the sources in code-point order, null last. The order needs one task; it holds a row a source, not documents."""
    rank = F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights))) + 1))


def mix(docs: DataFrame, *, size: Column, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size (long), target (double), epochs (whole repetitions), extra (words of one more, partial or
    whole repetition) and taken (long: epochs * size + extra). Columns of these names are replaced.

    A null source is a source of its own. Documents of size 0 (null and empty texts) take nothing; a very long text may be taken in part. An empty table gives none. Repeated rows are drawn each for itself; ties of the draw go by id.
    The draw is a digest of seed and id, so reruns agree. A hot source is never gathered: its boundary is found by sums over digest prefixes,
    and only documents that share the boundary's prefix (one of 65,536) are put in order.
    """
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "epochs", "extra", "taken")]
    draw = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    docs = settled(docs, "mix-rows")
    sized = docs.select(packed(docs.select(*names)).alias("_row"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), draw.alias("_draw"), F.col(source_col).alias("_source"), F.col(id_col).alias("_id"))
    base = written(sized.select("_source", "size", F.substring("_draw", 1, _LEVELS * _DIGITS).alias("_draw")), "mix")
    sources = base.groupBy("_source").agg(F.sum("size").alias("source_size"))
    sources = written(cyclic_weights(sources, "_source", weights), "mix-sources")
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    shares = water_fill(sources, budget, cap=F.col("source_size") * max_epochs).withColumn("target", F.round("target", 6))
    words, sizes = F.round("target").cast("long"), F.greatest("source_size", F.lit(1))
    plan = written(shares.select("_source", "source_size", "target", F.floor(words / sizes).alias("epochs"), (words % sizes).alias("_left")), "mix-plan")
    # The boundary: within a source, documents whose draw lies before it take one more repetition.
    edge = plan.select("_source", "_left", F.lit("").alias("_prefix"))
    for level in range(1, _LEVELS + 1):
        of = edge.select(F.col("_source").alias("_of"), "_left", "_prefix")
        within = base.join(of, F.col("_source").eqNullSafe(F.col("_of")) & (F.substring("_draw", 1, (level - 1) * _DIGITS) == F.col("_prefix")))
        steps = within.groupBy("_of", "_left", F.substring("_draw", 1, level * _DIGITS).alias("_step")).agg(F.sum("size").alias("_sum"))
        before = F.sum("_sum").over(Window.partitionBy("_of").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1))
        steps = steps.withColumn("_before", F.coalesce(before, F.lit(0)))
        at = steps.where((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_sum")))
        edge = written(at.select(F.col("_of").alias("_source"), (F.col("_left") - F.col("_before")).alias("_left"), F.col("_step").alias("_prefix")), "mix-edge")
    cuts = plan.drop("_left").join(edge.select(F.col("_source").alias("_edge"), F.col("_left").alias("_rest"), "_prefix"), F.col("_source").eqNullSafe(F.col("_edge")), "left")
    cuts = cuts.select(F.col("_source").alias("_of"), "source_size", "target", "epochs", "_rest", "_prefix")
    joined = sized.join(spread(cuts), F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of")
    prefix = F.substring("_draw", 1, _LEVELS * _DIGITS)
    # A source without boundary (nothing left, or no words) takes no more.
    away = joined.where(F.col("_prefix").isNull() | (prefix != F.col("_prefix")))
    away = away.withColumn("extra", F.when(prefix < F.col("_prefix"), F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("_source").orderBy("_draw", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    on = joined.where(prefix == F.col("_prefix"))
    on = on.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.coalesce(F.sum("size").over(order), F.lit(0)))))
    out = away.unionByName(on).withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))
    return out.select("_row.*", "size", "source_size", "target", "epochs", F.col("extra").cast("long").alias("extra"), "taken")


def repeated(mixed: DataFrame, columns: Sequence[str], *, text_col: str = "text") -> DataFrame:
    """The mix itself: each row of :func:`mix` as often as it is taken. A repetition in part holds the first ``extra`` words, one space between."""
    times = F.col("epochs") + (F.col("extra") > 0).cast("long")
    turn = free_name(mixed, "turn")
    rows = mixed.where((times > 0) & (F.col("taken") > 0)).withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), times)))
    part = (F.col(turn) > F.col("epochs")) & (F.col("extra") < F.col("size"))
    text = F.when(part, F.array_join(F.slice(word_array(F.col(text_col)), 1, F.col("extra").cast("int")), " ")).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text).select(*columns)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    sizes = written(documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return mix(sizes, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
      FROM d GROUP BY source),
f AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / weight AS ratio FROM s),
g AS (SELECT f.ratio, (1.5 * (SELECT sum(source_size) FROM s) - coalesce((SELECT sum(x.cap) FROM f x WHERE x.ratio < f.ratio), 0))
             / (SELECT sum(x.weight) FROM f x WHERE x.ratio >= f.ratio) AS level FROM f),
lv AS (SELECT arg_min(level, ratio) AS level FROM g WHERE level < ratio),
t AS (SELECT source, source_size, round(least(cap, coalesce((SELECT level FROM lv), 1e300) * weight), 6) AS target FROM f),
p AS (SELECT *, CAST(round(target) AS BIGINT) // greatest(source_size, 1) AS epochs, CAST(round(target) AS BIGINT) % greatest(source_size, 1) AS rest FROM t),
c AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM c
"""
