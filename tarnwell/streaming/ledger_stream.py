"""The ledger checked as a stream: each bundle's state is the number and hash of its last good entry, whatever the ledger holds.

Bundles are small and many, so they are dealt to buckets by hash, whose states and entries go to Python together.

Every entry's own hash is checked by Spark's expressions before the entries of a micro-batch meet their bundle's state. A bundle's
result after any micro-batch is that of :func:`verify <tarnwell.operators.ledger.verify>` over all entries so far, also after a
restart from the checkpoint. An entry that comes again, or late, after higher numbers were read, is a break at its number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import GENESIS, entry_hash, field_text

_STATE = "bundle string, entries long, last_seq long, last_hash string, first_bad_seq long, tip_hash string"
_RESULT = "bundle string, entries long, ok boolean, first_bad_seq long, tip_hash string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _after(state: tuple, entries: Sequence[tuple]) -> tuple:
    """The state (entries, last_seq, last_hash, first_bad_seq, tip_hash) of a bundle after more entries (seq, entry_hash, prev_hash, own_good), in order, those without number first."""
    count, last_seq, last_hash, bad, tip = state
    for number, own, before, good in entries:
        if bad is None and number == last_seq + 1 and before == last_hash and good:
            last_seq, last_hash = number, own
        elif number is None or number <= last_seq:
            # Beside an entry that was read before: verification would break there.
            if bad is None or (number or 0) < bad:
                bad, tip = number or 0, last_hash if number == last_seq else None
        elif bad is None:
            bad, tip = number, last_hash
    return count + len(entries), last_seq, last_hash, bad, tip


class ChainCheck(StatefulProcessor):
    """Entries (bundle, seq, prev_hash, entry_hash, own_good) of one bucket of bundles in any order within a micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getListState("chains", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        known = {bundle: state for bundle, *state in self.states.get()} if self.states.exists() else {}
        found: dict = {}
        for batch in rows:
            numbers = [None if pd.isna(n) else int(n) for n in batch["seq"]]
            for bundle, *entry in zip(batch["bundle"], numbers, batch["entry_hash"], batch["prev_hash"], batch["own_good"], strict=True):
                found.setdefault(bundle, []).append(entry)
        for bundle, entries in found.items():
            entries.sort(key=lambda e: (e[0] is not None, e[0] or 0, e[1] is not None, e[1] or ""))
            known[bundle] = _after(known.get(bundle, (0, 0, GENESIS, None, None)), entries)
        self.states.put([(bundle, *state) for bundle, state in known.items()])
        out = [(bundle, n, bad is None, bad, last_hash if bad is None else tip) for bundle, (n, _, last_hash, bad, tip) in ((b, known[b]) for b in found)]
        result = pd.DataFrame(out, columns=["bundle", "entries", "ok", "first_bad_seq", "tip_hash"])
        yield result.astype({"first_bad_seq": "Int64"})

    def close(self) -> None:
        pass


def checked_chains(ledger: DataFrame, bundle: str, fields: Sequence[str], buckets: int = 4096) -> DataFrame:
    """Per bundle that a micro-batch (or a table) of the ledger touches: bundle, entries, ok, first_bad_seq (null if none), tip_hash.

    ``tip_hash`` is the last hash before the break; null for an entry that came again after later ones, whose predecessor's hash the state no longer holds. An entry without
    number is a break at 0. A bucket's entries of one micro-batch, five narrow columns, are put in order in one task, beside the last entries of its bundles: bound the former by the trigger, the latter by ``buckets``, which a
    checkpoint fixes.
    """
    spark: SparkSession = ledger.sparkSession
    if ledger.isStreaming and spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    good = F.coalesce(F.col("entry_hash") == entry_hash(F.col("seq"), field_text(fields), F.col("prev_hash")), F.lit(False))
    kind = ledger.schema[bundle].dataType.simpleString()
    # As text, since a number beside a null is rounded on its way to Python.
    name, named = (F.hex(bundle), F.unhex("bundle")) if kind == "binary" else (F.col(bundle).cast("string"), F.col("bundle").cast(kind))
    narrow = ledger.select(F.pmod(F.xxhash64(bundle), F.lit(buckets)).alias("bucket"), name.alias("bundle"), F.col("seq").cast("long").alias("seq"), "prev_hash", "entry_hash", good.alias("own_good"))
    found = narrow.groupBy("bucket").transformWithStateInPandas(ChainCheck(), outputStructType=_RESULT, outputMode="Update", timeMode="None")
    return found.select(named.alias(bundle), "entries", "ok", "first_bad_seq", "tip_hash")


def latest(results: DataFrame, bundle: str) -> DataFrame:
    """Of the results of several micro-batches the last one of each bundle: that of the most entries."""
    last = F.max_by(F.struct("entries", "ok", "first_bad_seq", "tip_hash"), "entries")
    return results.groupBy(bundle).agg(last.alias("r")).select(bundle, "r.*")
