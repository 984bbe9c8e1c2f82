"""Versioned tables: upserts in place, two writers at once, writers that die, broken documents, artifacts, manifests and registries."""

import os
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnwell.sources.store import Conflict, Store

SHAPE = "bundle_id string, scan_id string, k int, v string"
SCOPE = ["bundle_id", "scan_id"]


def rows(spark, *some):
    return spark.createDataFrame(list(some), SHAPE)


def upsert(store, table, keys=None):
    return store.upsert({"t": table}, table.select(*SCOPE), SCOPE, {"t": keys} if keys else None)


def content(store, name="t", version=None):
    return sorted(tuple(r) for r in store.table(name, version).collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path), buckets=8)


def test_upsert_in_place(spark, store):
    assert store.version() == 0 and store.table("t") is None
    first = upsert(store, rows(spark, ("a", "1", 1, "x"), ("a", "1", 2, "y"), ("b", "1", 1, "z"), (None, "1", 1, "n")))
    again = upsert(store, rows(spark, ("a", "1", 3, "w"), ("a", "2", 1, "q"), ("a", "2", 1, "r")), ["bundle_id", "scan_id", "k"])
    assert [first, again, store.version()] == [1, 2, 2]
    assert set(content_any(store, 1)) == {("a", "1", 1, "x"), ("a", "1", 2, "y"), ("b", "1", 1, "z"), (None, "1", 1, "n")}
    now = content_any(store)
    assert {r for r in now if r[1] == "1"} == {("a", "1", 3, "w"), ("b", "1", 1, "z"), (None, "1", 1, "n")} and len(now) == 4
    upsert(store, rows(spark, (None, "1", 9, "m")))  # a null scope is replaced like any other
    assert {r for r in content_any(store) if r[0] is None} == {(None, "1", 9, "m")}
    # A scope without rows loses those it had.
    store.upsert({"t": rows(spark)}, spark.createDataFrame([("b", "1")], "bundle_id string, scan_id string"), SCOPE)
    assert not [r for r in content_any(store) if r[0] == "b"]


def content_any(store, version=None):
    return [tuple(r) for r in store.table("t", version).collect()]


def test_only_touched_buckets_are_rewritten(spark, store):
    upsert(store, spark.range(200).selectExpr("concat('b', id) AS bundle_id", "'1' AS scan_id", "cast(id AS int) AS k", "'x' AS v"))
    before = store._snapshot()[1]["t"]["buckets"]
    upsert(store, rows(spark, ("b7", "1", 7, "new")))
    after = store._snapshot()[1]["t"]["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) == 8
    assert store.table("t").count() == 200 and content(store)[0][0] == "b0" and store.table("t").where("v = 'new'").count() == 1


def test_several_tables_in_one_version(spark, store):
    scopes = spark.createDataFrame([("a", "1")], "bundle_id string, scan_id string")
    version = store.upsert({"x": rows(spark, ("a", "1", 1, "x")), "y": rows(spark, ("a", "1", 2, "y"))}, scopes, SCOPE)
    assert version == 1 and content(store, "x") == [("a", "1", 1, "x")] and content(store, "y") == [("a", "1", 2, "y")]


def test_two_writers_lose_nothing(spark, tmp_path):
    """Writers of the same bucket and of others, started from the same version."""
    failed = []

    def write(who):
        try:
            own = Store(spark, str(tmp_path), buckets=2)
            for i in range(4):
                upsert(own, rows(spark, (f"{who}{i}", "1", i, who), (f"{who}{i}", "1", i + 10, who)))
        except Exception as e:  # told below
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in "abc"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = Store(spark, str(tmp_path))
    assert not failed and store.version() == 12 and store.versions() == list(range(12, 0, -1))
    assert content(store) == sorted((f"{w}{i}", "1", j, w) for w in "abc" for i in range(4) for j in (i, i + 10))


def test_a_lost_race_merges_again_only_if_buckets_meet(spark, tmp_path):
    store, other = Store(spark, str(tmp_path), buckets=64), Store(spark, str(tmp_path), buckets=64)
    upsert(store, rows(spark, ("a", "1", 1, "x"), ("b", "1", 1, "x")))
    for theirs, calls in (("b", 1), ("a", 2)):
        seen = []

        def change(base):
            seen.append(1)
            entries = store._merged({"t": rows(spark, ("a", "9", len(seen), "mine"))}, spark.createDataFrame([("a", "9")], "bundle_id string, scan_id string"), SCOPE, {}, base)
            if len(seen) == 1:
                upsert(other, rows(spark, (theirs, "5", 1, "theirs")))
            return entries

        store.commit(change)
        assert len(seen) == calls and {r[:2] for r in content(store)} >= {("a", "9"), (theirs, "5")}


def test_a_writer_that_dies_changes_nothing(spark, store):
    upsert(store, rows(spark, ("a", "1", 1, "x")))
    before = content(store)

    def dies(base):
        store._merged({"t": rows(spark, ("a", "1", 2, "y"))}, spark.createDataFrame([("a", "1")], "bundle_id string, scan_id string"), SCOPE, {}, base)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.commit(dies)
    assert content(store) == before and store.version() == 1
    assert store.vacuum(older_than=0) == 1 and content(store) == before


def test_broken_documents_count_as_absent(spark, tmp_path, store):
    upsert(store, rows(spark, ("a", "1", 1, "x")))
    (tmp_path / "_log" / f"{2:020d}.json").write_text('{"tables": {"t"')
    assert store.version() == 1 and content(store) == [("a", "1", 1, "x")]
    assert upsert(store, rows(spark, ("b", "1", 1, "y"))) == 3 and len(content(store)) == 2
    assert not store._publish(3, "{}") and not [f for f in os.listdir(tmp_path / "_log") if "draft" in f and not f.endswith(".crc")]


def test_versions_are_given_up_only_after_the_attempts(spark, tmp_path):
    store = Store(spark, str(tmp_path), attempts=2)
    store._publish = lambda version, text: False
    with pytest.raises(Conflict):
        upsert(store, rows(spark, ("a", "1", 1, "x")))


def test_vacuum_keeps_what_is_read(spark, store):
    for i in range(4):
        upsert(store, rows(spark, ("a", "1", i, "x")))
    assert store.vacuum(keep=2, older_than=0) == 2 and store.versions() == [4, 3]
    assert content(store, version=3) == [("a", "1", 2, "x")] and content(store) == [("a", "1", 3, "x")]


def test_manifests(spark, store):
    shape = StructType.fromDDL("bundle_id string, last_commit string, deps_hash string")
    assert store.manifests(shape).count() == 0
    store.put_manifests(spark.createDataFrame([("a", "c1", "h"), ("b", "c1", None)], shape))
    store.put_manifests(spark.createDataFrame([("a", "c2", "h2")], shape))
    assert sorted(map(tuple, store.manifests(shape).collect())) == [("a", "c2", "h2"), ("b", "c1", None)]
    broken = spark.createDataFrame([("b", '{"bundle_id": "b", '), ("c", '{"bundle_id": "x"}')], "bundle_id string, document string")
    store.upsert({"manifests": broken}, broken.select("bundle_id"), ["bundle_id"])
    assert [tuple(r) for r in store.manifests(shape).collect()] == [("a", "c2", "h2")]


def test_artifacts_by_bundle_and_commit(spark, store):
    facts = spark.createDataFrame([("a", "0123456789", "f1"), ("a", "0123456789", "f2"), ("b", "99", "g")], "bundle_id string, commit string, fact_id string")
    scans = facts.select("bundle_id", "commit").union(spark.createDataFrame([("c", "7")], "a string, b string"))
    store.put_artifacts({"facts": facts}, scans)
    assert store.has_record("a", "01234567ff") and not store.has_record("a", "99") and store.has_record("c", "7")
    assert sorted(r.fact_id for r in store.artifacts("facts", "a", "0123456789").collect()) == ["f1", "f2"]
    assert store.artifacts("facts", "c", "7").count() == 0 and store.artifacts("facts", "x", "7") is None and store.artifacts("marks", "a", "0123456789") is None
    store.put_artifacts({"facts": facts.where("fact_id = 'f2'")}, scans.where("bundle_id = 'a'"))
    assert [r.fact_id for r in store.artifacts("facts", "a", "0123456789").collect()] == ["f2"] and store.artifacts("facts", "b", "99").count() == 1


def test_registry_of_another_schema_counts_as_absent(spark, store):
    assert store.registry("wrappers", 2) is None
    store.put_registry("wrappers", spark.createDataFrame([("w", "chat")], "name string, kind string"), 1, "name")
    assert store.registry("wrappers", 2).count() == 0 and [tuple(r) for r in store.registry("wrappers", 1).collect()] == [("w", "chat")]
    store.put_registry("wrappers", spark.createDataFrame([("w", "new"), ("v", "chat")], "name string, kind string"), 2, "name")
    assert store.registry("wrappers", 1).count() == 0 and store.registry("wrappers", 2).count() == 2


def test_hot_scope_is_split(spark, store):
    many = spark.range(20_000).select(F.lit("hot").alias("bundle_id"), F.lit("1").alias("scan_id"), F.col("id").cast("int").alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
    upsert(store, many)
    assert store.table("t").count() == 20_000 and store.table("t").agg(F.countDistinct("k")).first()[0] == 20_000
