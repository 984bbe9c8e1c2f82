"""Facts, graphs and findings as canonical lines, stores by bundle and commit, and what an earlier scan has left."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import commit_tag
from ..session import stored


def canonical_line(row: Column) -> Column:
    """A struct, map or array as one line of JSON with sorted keys; nulls stay."""

    def sort(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False), na_action="ignore")

    return F.pandas_udf(sort, "string")(F.to_json(row, {"ignoreNullFields": "false"}))


def flat_line(df: DataFrame) -> Column:
    """As :func:`canonical_line`, for rows without nested structs: the columns in sorted order, without Python."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def canonical_json(row: Column) -> Column:
    """A struct as JSON with sorted keys, two spaces of indentation and a line feed at the end."""

    def dump(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(json.loads(t), sort_keys=True, indent=2, ensure_ascii=False) + "\n", na_action="ignore")

    return F.pandas_udf(dump, "string")(F.to_json(row, {"ignoreNullFields": "false"}))


def fact_lines(facts: DataFrame) -> DataFrame:
    """Distinct facts as sorted lines of canonical JSON (column line)."""
    return facts.select(flat_line(facts).alias("line")).distinct().orderBy("line")


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(bundle_id, part, line): a graph in canonical form, its nodes by id, then its edges by family, type and ends. Lines, not one document, so that no graph is one value."""
    of = lambda rows, part: rows.select("bundle_id", F.lit(part).alias("part"), flat_line(rows.drop("bundle_id")).alias("line"))
    return of(nodes, "0 nodes").unionByName(of(edges, "1 edges")).distinct().orderBy("bundle_id", "part", "line")


def json_string(text: Column) -> Column:
    """A string as JSON, with no more escaped than has to be; null as null."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    named = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    for code in range(32):
        plain = F.replace(plain, F.lit(chr(code)), F.lit(named.get(chr(code), f"\\u{code:04x}")))
    return F.coalesce(F.concat(F.lit('"'), plain, F.lit('"')), F.lit("null"))


def graph_document(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, folder: str) -> None:
    """Each bundle's graph as one canonical JSON document (sorted keys, two spaces, a line feed at the end), in files below ``bundle_id=..`` that make it up one after another, in the order of their names.

    ``nodes`` are (bundle_id, id, type, fact_type, fact: JSON text), ``edges`` (bundle_id, family, type, src, dst, attrs: an array of structs of key and value, ordered), ``evidence`` rows of an edge's columns
    and evidence. A document is sorted and written by ranges of its lines; neither a graph nor an edge with all its evidence is ever one value. Repeated rows count once.
    """
    key = ["bundle_id", "family", "type", "src", "dst", "attrs"]
    edges, evidence, nodes = edges.select(*key).distinct(), evidence.select(*key, "evidence").distinct(), nodes.dropDuplicates(["bundle_id", "id"])
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    nothing = {"family": "", "type": "", "src": "", "dst": "", "id": "", "evidence": ""}
    plain = {n: F.lit(v) for n, v in nothing.items()} | {"attrs": F.array().cast(edges.schema["attrs"].dataType)}

    def lines(rows: DataFrame, section: int, part: int, line: Column, *own: str) -> DataFrame:
        return rows.select("bundle_id", F.lit(section).alias("section"), *[F.col(c).alias(c) if c in own else plain[c].alias(c) for c in ("family", "type", "src", "dst", "attrs")], F.lit(part).alias("part"), *[F.col(c).alias(c) if c in own else plain[c].alias(c) for c in ("evidence", "id")], line.alias("line"))

    comma = lambda last: F.when(last, "").otherwise(",")
    # What comes last in a list has no comma behind it.
    same = lambda names: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]
    ends = evidence.groupBy(*key).agg(F.max("evidence").alias("_end"))
    final = edges.groupBy("bundle_id").agg(F.max(F.struct(*key[1:])).alias("_final"))
    closed = edges.alias("a").join(ends.alias("b"), same(key), "left").select("a.*", "_end").join(final, "bundle_id")
    attrs = F.when(F.size("attrs") == 0, "{}").otherwise(text("{\n", F.array_join(F.transform(F.array_sort("attrs"), lambda p: F.concat(F.lit("        "), json_string(p["key"]), F.lit(": "), json_string(p["value"]))), ",\n"), "\n      }"))
    opened = text('    {\n      "attrs": ', attrs, ',\n      "dst": ', json_string(F.col("dst")), ',\n      "evidence": [', F.when(F.col("_end").isNull(), "],").otherwise(""))
    finished = text(F.when(F.col("_end").isNull(), "").otherwise("      ],\n"), '      "family": ', json_string(F.col("family")), ',\n      "src": ', json_string(F.col("src")), ',\n      "type": ', json_string(F.col("type")), "\n    }", comma(F.struct(*key[1:]) == F.col("_final")))
    proofs = evidence.alias("a").join(ends.alias("b"), same(key)).select("a.*", "_end")

    def indented(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(json.loads(t), sort_keys=True, indent=2, ensure_ascii=False).replace("\n", "\n      "), na_action="ignore")

    top = nodes.groupBy("bundle_id").agg(F.max("id").alias("_last"))
    fact = F.coalesce(F.pandas_udf(indented, "string")(F.col("fact")), F.lit("null"))
    node = text('    {\n      "fact": ', fact, ',\n      "fact_type": ', json_string(F.col("fact_type")), ',\n      "id": ', json_string(F.col("id")), ',\n      "type": ', json_string(F.col("type")), "\n    }", comma(F.col("id") == F.col("_last")))
    bundles = nodes.select("bundle_id").unionByName(edges.select("bundle_id")).distinct().join(final, "bundle_id", "left").join(top, "bundle_id", "left")
    no_edges, no_nodes = F.col("_final").isNull(), F.col("_last").isNull()
    frame = [lines(bundles, 0, 0, text('{\n  "edges": [', F.when(no_edges, "],").otherwise(""))), lines(bundles, 2, 0, text(F.when(no_edges, "").otherwise("  ],\n"), '  "nodes": [', F.when(no_nodes, "]\n}").otherwise(""))), lines(bundles.where(~no_nodes), 4, 0, F.lit("  ]\n}"))]
    body = [lines(closed, 1, 0, opened, *key), lines(proofs, 1, 1, text("        ", json_string(F.col("evidence")), comma(F.col("evidence") == F.col("_end"))), *key, "evidence"), lines(closed, 1, 2, finished, *key), lines(nodes.join(top, "bundle_id").withColumn("type", F.col("type")), 3, 0, node, "id")]
    order = ["bundle_id", "section", "family", "type", "src", "dst", "attrs", "part", "evidence", "id"]
    rows = reduce(DataFrame.unionByName, [*frame, *body])
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("bundle_id", "line").write.partitionBy("bundle_id").text(folder)


def write_artifacts(folder: str, facts: DataFrame, findings: DataFrame, marks: DataFrame) -> None:
    """facts, findings and entry-point marks as folders of lines of JSON, sorted across files and within them."""
    for name, rows in (("facts", facts), ("findings", findings), ("marks", marks)):
        fact_lines(rows).write.mode("overwrite").text(f"{folder}/{name}")


def read_artifacts(spark: SparkSession, folder: str, shapes: dict[str, StructType | str]) -> dict[str, DataFrame] | None:
    """The tables of an earlier scan; None if one is missing or a line of it is broken, so that the scan starts afresh."""
    out = {}
    try:
        for name, shape in shapes.items():
            rows = spark.read.schema(shape).option("mode", "FAILFAST").json(f"{folder}/{name}")
            out[name] = stored(rows, f"artifact-{name}")  # every line is parsed, once
    except (PySparkException, Py4JError):
        return None
    return out


def store_scans(records: DataFrame, folder: str, commit: Column) -> None:
    """Records in a folder for each bundle and commit (its first eight characters); a scan of the same commit replaces the earlier one."""
    kept = records.withColumn("commit8", commit_tag(commit))
    kept.write.partitionBy("bundle_id", "commit8").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def stored_scan(spark: SparkSession, folder: str, bundle_id: str, commit: str) -> DataFrame:
    return spark.read.parquet(folder).where((F.col("bundle_id") == bundle_id) & (F.col("commit8") == commit[:8]))


def ordered_dump(df: DataFrame, key: list[str]) -> DataFrame:
    """All rows in the order of their key, for comparisons."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in key])
