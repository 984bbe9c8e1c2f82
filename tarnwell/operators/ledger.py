"""A tamper-evident ledger: hash chains, their verification, and appends.

A bundle has a chain of its own, so that chains are built and checked in parallel. Every entry's hash covers its number, its fields and the hash
before it. A missing field is the text ``None``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .digests import digest_tree, root

GENESIS = "0" * 64


def field_text(fields: Sequence[str]) -> Column:
    """The fields of an entry as its hash covers them."""
    return F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("None")) for f in fields])


def entry_hash(seq: Column, fields: Column, previous: Column) -> Column:
    return F.sha2(F.concat_ws("|", seq.cast("string"), fields, previous), 256)


def _start(place: Column, seq: Column, tip: Column, segment: int | None) -> Column:
    """The hash before an entry that starts a chain or a segment; null for entries that follow the one before."""
    start = F.when(place == 1, tip)
    return start if segment is None else F.when((seq - 1) % segment == 0, F.lit(GENESIS)).otherwise(start)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds prev_hash and entry_hash to rows in the order of their chains; only the last hash is carried from batch to batch."""
    last = GENESIS
    for batch in batches:
        before, hashes = [], []
        for seq, text, start in zip(*(batch[c].to_pylist() for c in ("seq", "_text", "_start")), strict=True):
            before.append(last if start is None else start)
            last = sha256(f"{seq}|{text}|{before[-1]}".encode()).hexdigest()
            hashes.append(last)
        kept = [n for n in batch.schema.names if n not in ("_text", "_start")]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in kept), pa.array(before, pa.string()), pa.array(hashes, pa.string())], names=[*kept, "prev_hash", "entry_hash"])


def _chained(rows: DataFrame, bundle: str) -> DataFrame:
    """Rows of a bundle lie in one partition, as they were numbered there, and are folded in order of seq."""
    shape = StructType([f for f in rows.schema.fields if f.name not in ("_text", "_start")]).add("prev_hash", "string").add("entry_hash", "string")
    return rows.repartition(bundle).sortWithinPartitions(bundle, "seq").mapInArrow(_fold, shape)


def hash_chain(entries: DataFrame, bundle: str, order: Sequence[str], fields: Sequence[str], segment: int | None = None) -> DataFrame:
    """``entries`` with seq (from 1 within the bundle), prev_hash and entry_hash.

    Hashes of a chain follow from each other, so a bundle is folded in one task, which holds one batch and the last hash. With ``segment``
    the chain starts from the genesis hash again after so many entries.
    """
    seq = F.row_number().over(Window.partitionBy(bundle).orderBy(*order))
    rows = entries.withColumn("seq", seq).withColumn("_text", field_text(fields))
    return _chained(rows.withColumn("_start", _start(F.col("seq"), F.col("seq"), F.lit(GENESIS), segment)), bundle)


def verify(ledger: DataFrame, bundle: str, fields: Sequence[str], segment: int | None = None) -> DataFrame:
    """Per bundle: entries, ok, first_bad_seq (null if none) and tip_hash (the last hash before the break).

    An entry is bad if its number does not follow, its previous hash is not that of the entry before, or its own hash is not what its fields give.
    """
    order = Window.partitionBy(bundle).orderBy("seq")
    place = F.row_number().over(order)
    fresh = F.col("_place") == 1 if segment is None else (F.col("_place") - 1) % segment == 0
    rows = ledger.withColumns({"_place": place, "_before": F.lag("entry_hash").over(order)})
    rows = rows.withColumn("_expected", F.when(fresh, F.lit(GENESIS)).otherwise(F.col("_before")))
    good = (F.col("seq") == F.col("_place")) & (F.col("prev_hash") == F.col("_expected")) & (F.col("entry_hash") == entry_hash(F.col("seq"), field_text(fields), F.col("prev_hash")))
    rows = rows.withColumn("_bad", ~F.coalesce(good, F.lit(False)))
    first = F.min(F.when(F.col("_bad"), F.struct("_place", "seq", F.coalesce("_before", F.lit(GENESIS)).alias("tip"))))
    last = F.max(F.struct("_place", "entry_hash"))
    found = rows.groupBy(bundle).agg(F.count("*").alias("entries"), first.alias("f"), last.alias("l"))
    return found.select(bundle, "entries", F.col("f").isNull().alias("ok"), F.col("f.seq").alias("first_bad_seq"), F.coalesce("f.tip", "l.entry_hash").alias("tip_hash"))


def append(ledger: DataFrame, entries: DataFrame, bundle: str, order: Sequence[str], fields: Sequence[str], segment: int | None = None) -> DataFrame:
    """Rows to append for new ``entries``: numbers and hashes go on from each bundle's last entry. Rows already there are not touched."""
    tips = ledger.groupBy(bundle).agg(F.max(F.struct("seq", "entry_hash")).alias("_tip")).select(F.col(bundle).alias("_of"), F.col("_tip.seq").alias("_last"), F.col("_tip.entry_hash").alias("_hash"))
    numbered = entries.join(tips, F.col(bundle).eqNullSafe(F.col("_of")), "left").drop("_of")
    place = F.row_number().over(Window.partitionBy(bundle).orderBy(*order))
    rows = numbered.withColumn("_place", place).withColumn("seq", (F.coalesce("_last", F.lit(0)) + F.col("_place")).cast("int")).withColumn("_text", field_text(fields))
    rows = rows.withColumn("_start", _start(F.col("_place"), F.col("seq"), F.coalesce("_hash", F.lit(GENESIS)), segment))
    return _chained(rows.drop("_place", "_last", "_hash"), bundle)


def ledger_tip(ledger: DataFrame, bundle: str) -> str:
    """One digest of the last entries of all chains, whatever their order and partitions: kept elsewhere, it tells a ledger from one that has lost its newest rows."""
    tips = ledger.groupBy(bundle).agg(F.max_by("entry_hash", "seq").alias("tip"), F.max("seq").alias("seq"))
    return root(digest_tree(tips, [bundle]))
