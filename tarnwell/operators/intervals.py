"""Joins and differences of intervals, exact and without comparing all intervals of a key with each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def whole_number(df: DataFrame, column: str) -> Column:
    """A place as a long: timestamps in microseconds, dates in days, whole numbers as they are."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    if kind == "date":
        return F.unix_date(F.col(column)).cast("long")
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"places are whole numbers, dates or timestamps, not {kind}")
    return F.col(column).cast("long")


def blocks(start: Column, stop: Column) -> Column:
    """The interval, ends included, as an array of (level, block): at most two blocks of each power of two, side by side, that cover it exactly. Empty if it ends before it starts, or for a null."""
    begin = F.struct(start.alias("low"), (stop + 1).alias("high"), F.array().cast("array<struct<level:int,block:long>>").alias("found"))

    def step(s: Column, level: Column) -> Column:
        more = s["low"] < s["high"]
        left, right = more & (s["low"].bitwiseAND(F.lit(1)) == 1), more & (s["high"].bitwiseAND(F.lit(1)) == 1)
        one = lambda keep, place: F.when(keep, F.array(F.struct(level.alias("level"), place.alias("block")))).otherwise(F.array().cast("array<struct<level:int,block:long>>"))
        # An odd end is a block of its own; what is left are whole blocks of the next level.
        low, high = s["low"] + left.cast("long"), s["high"] - right.cast("long")
        lone = one(left, s["low"])
        found = F.concat(s["found"], lone, F.when(low <= high, one(right, high)).otherwise(F.array().cast("array<struct<level:int,block:long>>")))
        return F.struct(F.shiftright(low, 1).alias("low"), F.shiftright(high, 1).alias("high"), found.alias("found"))

    # No block is longer than the interval, so its length bounds the levels; one too long for a number goes through all.
    bits = F.coalesce(F.length(F.bin(F.try_subtract(stop, start) + 1)), F.lit(63))
    cover = F.aggregate(F.sequence(F.lit(0), F.least(bits, F.lit(63)) - 1), begin, step)["found"]
    return F.when(start <= stop, cover).otherwise(F.array().cast("array<struct<level:int,block:long>>"))


def contained(points: DataFrame, spans: DataFrame, key: Sequence[str], at: str, start: str, stop: str) -> DataFrame:
    """Points joined to the spans of their key that hold them, ends included: the columns of ``points``, then those of ``spans`` but the key.

    A span is cut into the blocks of powers of two that cover it, a point lies in one block of each size, and the two join by equality: every match is a result, so a key with many points and
    spans costs no more than they and their matches. Null keys and places match nothing. Both sides have many times the rows that their files' sizes tell, so the join sorts: neither goes through the driver.
    """
    cut = spans.withColumn("_b", F.explode(blocks(whole_number(spans, start), whole_number(spans, stop)))).select("*", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).drop("_b")
    levels = sorted(r[0] for r in cut.select("_level").distinct().collect())  # 63 at most
    place = whole_number(points, at)
    homes = F.array(*[F.struct(F.lit(n).alias("_level"), F.shiftright(place, n).alias("_block")) for n in levels] or [F.struct(F.lit(None).cast("int").alias("_level"), F.lit(None).cast("long").alias("_block"))])
    dealt = points.withColumn("_h", F.explode(homes)).select(*points.columns, "_h._level", "_h._block")
    return dealt.join(cut.hint("merge"), [*key, "_level", "_block"]).select(*[dealt[c] for c in points.columns], *[cut[c] for c in spans.columns if c not in key])


def merged(spans: DataFrame, key: Sequence[str], start: str, stop: str) -> DataFrame:
    """(key.., start, stop), whole numbers: the union of each key's intervals, ends included, as the fewest intervals that do not touch.

    A sweep in the order of starts: an interval opens a new one if it starts beyond all that came before. Intervals that end before they start are none.
    """
    rows = spans.select(*key, whole_number(spans, start).alias("_a"), whole_number(spans, stop).alias("_z")).where(F.col("_a") <= F.col("_z"))
    # Of equal starts the longest stands for all, so that a hot start is one row before the sweep.
    rows = rows.groupBy(*key, "_a").agg(F.max("_z").alias("_z"))
    order = Window.partitionBy(*key).orderBy("_a")
    before = F.max("_z").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = rows.withColumn("_new", F.when(F.col("_a") <= before + 1, 0).otherwise(1))
    return opens.withColumn("_n", F.sum("_new").over(order)).groupBy(*key, "_n").agg(F.min("_a").alias(start), F.max("_z").alias(stop)).drop("_n")


def subtracted(spans: DataFrame, consumed: DataFrame, key: Sequence[str], start: str, stop: str) -> DataFrame:
    """``spans`` cut to what the key's ``consumed`` intervals leave of them, ends included, as whole numbers; a span may be left whole, in pieces or not at all.

    One sweep over the ends of both numbers, for each span, the merged consumed intervals that meet it: those from the first that does not end before the span to the last that starts within it. They are
    fetched by number, so rows grow with the spans and the pieces alone, and no side goes through the driver.
    """
    taken = merged(consumed.dropna(subset=list(key)), key, start, stop).withColumnsRenamed({start: "_s", stop: "_t"})
    taken = taken.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_s")))
    own = spans.withColumns({"_id": F.monotonically_increasing_id(), "_a": whole_number(spans, start), "_z": whole_number(spans, stop)})
    rest = stored(own.where(F.col("_a") <= F.col("_z")), "spans")  # ids that stay the same wherever they are read
    none = F.lit(None).cast("long")
    at = lambda place, turn, **more: F.struct(place.alias("at"), F.lit(turn).alias("turn"), *[more.get(c, none).alias(c) for c in ("_id", "_a", "_z")])
    mine = {c: F.col(c) for c in ("_id", "_a", "_z")}
    # Of ends at one place those that open a consumed interval come first and those that close one last.
    ends = rest.dropna(subset=list(key)).select(*key, F.explode(F.array(at(F.col("_a"), 1, **mine), at(F.col("_z"), 2, **mine))).alias("e"))
    ends = ends.unionByName(taken.select(*key, F.explode(F.array(at(F.col("_s"), 0), at(F.col("_t"), 3))).alias("e"))).select(*key, "e.*")
    before = Window.partitionBy(*key).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = ends.withColumns({"_closed": F.count_if(F.col("turn") == 3).over(before), "_opened": F.count_if(F.col("turn") == 0).over(before)}).where(F.col("_id").isNotNull())
    low, high = F.max(F.when(F.col("turn") == 1, F.col("_closed"))), F.max(F.when(F.col("turn") == 2, F.col("_opened")))
    met = counted.groupBy(*key, "_id", "_a", "_z").agg(low.alias("_low"), high.alias("_high")).where(F.col("_low") < F.col("_high"))
    met = met.withColumn("_n", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
    cut = met.join(taken.hint("merge"), [*key, "_n"]).select("_id", "_a", "_z", "_s", "_t")
    order = Window.partitionBy("_id").orderBy("_s")
    pieces = cut.select("_id", F.coalesce(F.lag("_t").over(order) + 1, F.col("_a")).alias("_from"), (F.col("_s") - 1).alias("_to"))
    last = cut.groupBy("_id").agg(F.max("_t").alias("_t"), F.first("_z").alias("_z")).select("_id", (F.col("_t") + 1).alias("_from"), F.col("_z").alias("_to"))
    left = pieces.unionByName(last).where(F.col("_from") <= F.col("_to"))
    whole = rest.join(cut.select("_id").distinct().hint("merge"), "_id", "left_anti").select("*", F.col("_a").alias("_from"), F.col("_z").alias("_to"))
    both = rest.join(left.hint("merge"), "_id").unionByName(whole)
    return both.select(*[F.col("_from").alias(c) if c == start else F.col("_to").alias(c) if c == stop else F.col(c) for c in spans.columns])
