"""Table-agnostic operators over keyed tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import redact


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new``, and those of ``existing`` whose key is not among them. Keys match as equal, never on null."""
    return existing.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def set_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """Distinct rows added in ``head`` or removed from ``base``, with column ``change``. Nulls are equal."""
    added = head.subtract(base).withColumn("change", F.lit("added"))
    return added.unionByName(base.subtract(head).withColumn("change", F.lit("removed")))


def unattested(systems: DataFrame, approvals: DataFrame, key: str, status: str, approved: object) -> DataFrame:
    """Systems whose status is missing or not the approved one, once each."""
    found = systems.join(approvals.select(key, status), key, "left")
    return found.where(F.col(status).isNull() | (F.col(status) != F.lit(approved))).distinct()


def without_any(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """NOT EXISTS on equal keys."""
    return left.join(right.select(*key).distinct(), list(key), "left_anti")


def first_by(df: DataFrame, key: Sequence[str], order: Column, values: Mapping[str, Column]) -> DataFrame:
    """Per key the first non-null of each value by ``order``; ties go by the value."""
    return df.groupBy(*key).agg(*[F.min(F.when(v.isNotNull(), F.struct(order.alias("o"), v.alias("v"))))["v"].alias(name) for name, v in values.items()])


def disambiguated(df: DataFrame, name: Column, order: Sequence[str], suffix: Column) -> DataFrame:
    """``df`` with unique_id: the first of equal names keeps it, later ones get ``name@suffix``."""
    place = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("unique_id", F.when(place == 1, name).otherwise(F.concat_ws("@", name, suffix)))


def transfers(df: DataFrame, group: Sequence[str], order: Sequence[str], member: str) -> DataFrame:
    """Pairs (src, dst) of members that follow each other in a group and differ."""
    after = F.lead(member).over(Window.partitionBy(*group).orderBy(*order))
    return df.select(*group, *order, F.col(member).alias("src"), after.alias("dst")).where(F.col("src") != F.col("dst"))


def top_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key. The rank limit is applied before the shuffle, so a hot key sends ``n`` rows a task."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= n)


def changes(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per key and field whose value in ``after`` is set and differs: key, field, old_value, new_value (strings), seq within the key.

    A null in ``after`` leaves the old value and is no change.
    """
    old = before.select(key, *[F.col(f).cast("string").alias(f"old_{f}") for f in fields])
    both = after.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).join(old, key, "left")
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("field"), F.col(f"old_{f}").alias("old_value"), F.col(f).alias("new_value")) for i, f in enumerate(fields)])
    changed = F.filter(entries, lambda e: e["new_value"].isNotNull() & ~e["new_value"].eqNullSafe(e["old_value"]))
    return both.select(key, F.posexplode(changed).alias("pos", "e")).select(key, (F.col("pos") + 1).alias("seq"), "e.field", "e.old_value", "e.new_value")


def counts_of(predicted: DataFrame, actual: DataFrame, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """True positives, false positives and false negatives of a predicted set of keys, per group of the key columns ``by``."""
    both = predicted.select(*key).distinct().withColumn("_p", F.lit(True)).join(actual.select(*key).distinct().withColumn("_a", F.lit(True)), list(key), "full_outer")
    p, a = F.col("_p").isNotNull(), F.col("_a").isNotNull()
    return both.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))


def entities_at(entities: DataFrame, systems: DataFrame, commit: str, key: Sequence[str]) -> DataFrame:
    """Distinct entities of the scans whose system was at a commit."""
    scans = systems.where(F.col("commit") == commit).select("bundle_id", "scan_id").distinct()
    return entities.join(scans, ["bundle_id", "scan_id"], "left_semi").select(*key).distinct()


def commit_diff(tables: Mapping[str, tuple[DataFrame, str]], systems: DataFrame, base: str, head: str) -> DataFrame:
    """(kind, bundle_id, id, change): entities of several tables (by the name of their id column) added or removed between two commits."""
    out = None
    for kind, (rows, name) in tables.items():
        ids = [entities_at(rows, systems, commit, ["bundle_id", name]).withColumnRenamed(name, "id").withColumn("id", F.col("id").cast("string")) for commit in (base, head)]
        found = set_diff(*ids).select(F.lit(kind).alias("kind"), "bundle_id", "id", "change")
        out = found if out is None else out.unionByName(found)
    return out


def over_budget(files: DataFrame, key: str, lines: str, most_files: int, most_lines: int) -> DataFrame:
    """Keys whose files, or lines in them, are more than a scan takes: key, files, lines and the limits."""
    sums = files.groupBy(key).agg(F.count("*").alias("files"), F.sum(lines).cast("long").alias("lines"))
    return sums.where((F.col("files") > most_files) | (F.col("lines") > most_lines)).withColumns({"most_files": F.lit(most_files), "most_lines": F.lit(most_lines)})


def slices(lines: DataFrame, spans: DataFrame, key: str, *, context: int = 40, header: int = 80, imports: str = r"^(import|from) ") -> DataFrame:
    """(key, start, part, line, text): of each span (key, start, stop) the import lines at the head of its file and the lines around it.

    ``lines`` are (key, line, text), counted from 1; secrets in them are redacted. Lines stay rows: a slice is as long as its span.
    """
    lines = lines.select(key, "line", redact(F.col("text")).alias("text"))
    head = lines.where((F.col("line") <= header) & F.col("text").rlike(imports)).join(spans.select(key, "start").distinct(), key).select(key, "start", F.lit("imports").alias("part"), "line", "text")
    wide = spans.select(key, "start", F.explode(F.sequence(F.greatest(F.col("start") - context, F.lit(1)), F.col("stop") + context)).alias("line")).distinct()
    return head.unionByName(lines.join(wide, [key, "line"]).select(key, "start", F.lit("window").alias("part"), "line", "text"))


def governed(existing: DataFrame, new: DataFrame, audit: DataFrame, key: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """An audited upsert: the table with the set fields of ``new`` in place of the old ones, and the audit entries to append (key, seq, field, old_value, new_value).

    seq goes on from the key's last entry in ``audit``. A null in ``new`` leaves a value as it is.
    """
    entries = changes(existing, new, key, fields)
    last = audit.groupBy(key).agg(F.max("seq").alias("_last"))
    numbered = entries.join(last, key, "left").withColumn("seq", (F.col("seq") + F.coalesce("_last", F.lit(0))).cast("int")).drop("_last")
    both = new.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields]).join(existing, key, "full_outer")
    kept = [c for c in existing.columns if c != key]
    return both.select(key, *[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in kept]), numbered
