"""Graphs as canonical documents, byte for byte, and digest trees of tables."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import digests as D
from tarnwell.sources import outputs as O

ODD = ['plain', 'quote " and \\ back', "line\nfeed\ttab\x01\x1f", "é ü 日本 \U0001f600", "", "a/b<c>&'"]


@pytest.mark.parametrize("partitions", [1, 7])
def test_graph_document_is_canonical_json(spark, tmp_path, partitions):
    nodes = [(b, f"n{i}", "A", "AgentDef", json.dumps({"z": i, "a": {"list": ODD, "none": None, "empty": [], "map": {}}, "text": ODD[i % 6]})) for b in ("x", "y") for i in range(6)] + [("lone", "n", 'T"', "F", "{}")]
    edges = [(b, "ACDG", t, f"n{i}", f"n{(i + 1) % 6}", [("k", ODD[i])] if i % 2 else [], [f"{e}:{i}" for e in ODD[: i % 4]]) for b in ("x", "y") for t in ("bind", "transfer") for i in range(6)] + [("edge only", "F", "t", "a", "b", [("a", "1"), ("b", "2")], ["e"])]
    shape = "bundle_id string, family string, type string, src string, dst string, attrs array<struct<key:string,value:string>>"
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(edges + edges[:2], f"{shape}, evidence array<string>")
        proofs = table.select(*table.columns[:-1], F.explode("evidence").alias("evidence"))
        O.graph_document(spark.createDataFrame(nodes, "bundle_id string, id string, type string, fact_type string, fact string"), table.drop("evidence"), proofs, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for b in ("x", "y", "lone", "edge only"):
        wanted = {
            "nodes": [{"id": i, "type": t, "fact_type": f, "fact": json.loads(x)} for k, i, t, f, x in sorted(nodes) if k == b],
            "edges": [{"family": f, "type": t, "src": s, "dst": d, "attrs": dict(a), "evidence": sorted(set(e))} for k, f, t, s, d, a, e in sorted(edges) if k == b],
        }
        files = sorted(p for p in Path(tmp_path / "out" / f"bundle_id={b}").iterdir() if p.suffix == ".txt")
        assert "".join(p.read_bytes().decode() for p in files) == json.dumps(wanted, sort_keys=True, indent=2, ensure_ascii=False) + "\n", b
    assert partitions == 1 or len(list(Path(tmp_path / "out" / "bundle_id=x").glob("part-*.txt"))) > 1


def test_digest_trees(spark):
    rows = spark.range(3000).select("id", F.concat(F.lit("v"), F.col("id") % 7).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id") * 1.5).alias("x"))
    tree = D.digest_tree(rows, ["id"], 2)
    assert D.root(tree) == D.root(D.digest_tree(rows.orderBy(F.desc("v")).repartition(11).select("x", "v", "id"), ["id"], 2))
    assert sorted(tree.groupBy("level").agg(F.sum("n")).collect()) == [(0, 3000), (1, 3000), (2, 3000)]
    changed = rows.withColumn("v", F.when(F.col("id") == 77, "other").otherwise(F.col("v"))).where("id <> 1234").union(spark.sql("SELECT 9999L, 'new', null"))
    other = D.digest_tree(changed, ["id"], 2)
    ranges = D.differing_ranges(tree, other)
    assert D.root(tree) != D.root(other) and 1 <= ranges.count() <= 3
    assert {tuple(r) for r in D.row_changes(rows, changed, ["id"], ranges, 2).collect()} == {(77, "changed"), (1234, "removed"), (9999, "added")}
    assert D.differing_ranges(tree, tree).count() == 0
    # Repeats count, a null is not an empty string, and an empty table has a root.
    assert D.root(D.digest_tree(rows.union(rows.where("id = 3")), ["id"], 2)) != D.root(tree)
    none, blank = (spark.createDataFrame([(1, v)], "id int, v string") for v in (None, ""))
    assert D.root(D.digest_tree(none, ["id"])) != D.root(D.digest_tree(blank, ["id"]))
    assert D.root(D.digest_tree(rows.limit(0), ["id"])) == ""
