"""The ledger as a stream equals its verification as a table after every micro-batch, across restarts."""

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import ledger as L
from tarnwell.streaming import ledger_stream as S

FIELDS = ["scan", "actor"]


@pytest.fixture(scope="module")
def chain(spark):
    entries = spark.range(60).select((F.col("id") % 3).cast("string").alias("bundle"), F.col("id").alias("at"), F.concat(F.lit("s"), "id").alias("scan"), F.when(F.col("id") % 4 > 0, "me").alias("actor"))
    rows = L.hash_chain(entries, "bundle", ["at"], FIELDS).drop("at").collect()
    return sorted(rows, key=lambda r: (r.bundle, r.seq)), rows[0].__fields__


def run(spark, tmp_path, name, batches, shape):
    """Each list of rows as one file and one run of the query, which restarts from its checkpoint every time."""
    folder, out, marks = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "marks"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.PROVIDER)
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(shape).parquet(folder)
            found = S.checked_chains(stream, "bundle", FIELDS)
            keep = lambda batch, _: batch.write.mode("append").parquet(out)
            found.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
            whole = L.verify(spark.read.schema(shape).parquet(folder), "bundle", FIELDS)
            yield i, {tuple(r) for r in S.latest(spark.read.parquet(out), "bundle").collect()}, {tuple(r) for r in whole.select("bundle", "entries", "ok", "first_bad_seq", "tip_hash").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def dealt(rows, n):
    """A ledger in the order in which it grew, in ``n`` micro-batches."""
    grown = sorted(rows, key=lambda r: (r["seq"], r["bundle"]))
    return [grown[i * len(grown) // n : (i + 1) * len(grown) // n] for i in range(n)]


SHAPE = "bundle string, scan string, actor string, seq int, prev_hash string, entry_hash string"


def plain(chain):
    rows, names = chain
    return [{n: r[n] for n in ("bundle", "scan", "actor", "seq", "prev_hash", "entry_hash")} for r in rows]


def test_stream_equals_verification_in_ten_batches(spark, tmp_path, chain):
    """Bundle 0 is whole, an entry of bundle 1 is forged, one of bundle 2 is missing."""
    rows = [dict(r, actor="forger") if (r["bundle"], r["seq"]) == ("1", 7) else r for r in plain(chain) if (r["bundle"], r["seq"]) != ("2", 12)]
    last = None
    for i, stream, table in run(spark, tmp_path, "ten", dealt(rows, 10), SHAPE):
        assert stream == table, i
        last = {r[0]: r[1:4] for r in stream}
    assert last == {"0": (20, True, None), "1": (20, False, 7), "2": (19, False, 13)}


@pytest.mark.parametrize("case", ["again", "relinked", "late", "unnumbered"])
def test_breaks_in_later_batches(spark, tmp_path, chain, case):
    rows = [r for r in plain(chain) if r["bundle"] == "0"]
    forged = dict(rows[9], actor="forger")
    forged["entry_hash"] = "f" * 64
    batches = {
        "again": [rows[:10], [rows[4]], rows[10:]],  # the fifth entry comes twice
        "relinked": [rows[:9], [forged], rows[10:]],  # a hash that its fields do not give
        "late": [rows[:5], rows[6:], [rows[5]]],  # a gap, and its entry after all
        "unnumbered": [rows[:5], [dict(rows[5], seq=None)], rows[5:]],
    }[case]
    for i, stream, table in run(spark, tmp_path, case, batches, SHAPE):
        (_, n, ok, bad, tip), (_, wanted_n, wanted_ok, wanted_bad, wanted_tip) = *stream, *table
        assert n == wanted_n
        if case == "late" and i == 2:
            assert (ok, bad, wanted_ok) == (False, 7, True)  # the stream has seen the gap
        elif case == "unnumbered" and i > 0:
            assert (ok, wanted_ok, bad) == (False, False, 0)
        else:
            assert (ok, bad) == (wanted_ok, wanted_bad) and tip in (wanted_tip, None)


def test_a_stream_needs_its_state_store(spark, tmp_path):
    spark.createDataFrame([], SHAPE).write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="providerClass"):
        S.checked_chains(spark.readStream.schema(SHAPE).parquet(str(tmp_path / "x")), "bundle", FIELDS)


def test_many_bundles_cost_a_bucket_each_at_most(spark, tmp_path, monkeypatch):
    """2000 bundles, one of them null, one forged: as many calls of the processor and states as there are buckets, and numbers beyond 2 ** 53 stay what they are."""
    first = 2**53 + 1
    entries = spark.range(4000).select(F.when(F.col("id") % 2000 > 0, F.col("id") % 2000 + first).alias("bundle"), F.col("id").alias("at"), F.lit("s").alias("scan"), F.lit("me").alias("actor"))
    chained = L.hash_chain(entries, "bundle", ["at"], FIELDS).drop("at").withColumn("actor", F.when((F.col("bundle") == first + 7) & (F.col("seq") == 2), "forger").otherwise(F.col("actor")))
    groups = S.checked_chains(chained, "bundle", FIELDS, buckets=8)
    assert "bucket" in groups._jdf.queryExecution().analyzed().toString()
    found = {tuple(r) for r in groups.collect()}
    wanted = {tuple(r) for r in L.verify(chained, "bundle", FIELDS).select("bundle", "entries", "ok", "first_bad_seq", "tip_hash").collect()}
    assert found == wanted and len(found) == 2000 and [r[:4] for r in found if not r[2]] == [(first + 7, 2, False, 2)]
