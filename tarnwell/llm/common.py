"""Helpers that the corpus operators share: shared storage, words and hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType
from xxhash import xxh64_intdigest

#: A word is a run of characters other than ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without that setting, as in tests, gets a temporary folder; a cluster has to name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tarnwell-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/tarnwell/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: this cuts the lineage and survives lost executors.

    Spark deletes the shuffle files of the write when it has ended, as nothing reads them any more.
    """
    spark, path, key = df.sparkSession, new_folder(df.sparkSession, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if it only picks columns and rows of stored tables, else written: for operators that read it several times.

    What comes before is then not computed again, nor inlined into the columns of each of the operator's joins.
    """
    plan = df._jdf.queryExecution().analyzed()
    cheap = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation", "Relation", "LogicalRDD", "LocalRelation"}
    names, nodes = set(), [plan]
    while nodes:
        node = nodes.pop()
        names.add(node.nodeName().split(" ")[0])
        below = node.children()
        nodes += [below.apply(i) for i in range(below.length())]
    python = plan.containsPattern(df.sparkSession._jvm.org.apache.spark.sql.catalyst.trees.TreePattern.PYTHON_UDF())
    return df if names <= cheap and not python else written(df, name)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (split at ASCII white space) of all texts, one after another, and where each text begins (and the last one ends).

    Distinct words are hashed once a call. A null has no words.
    """
    split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
    coded = split.flatten().dictionary_encode()
    bounds = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)))
    known = coded.dictionary.cast(pa.binary()).to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False)
    if b"" in known:  # beside leading and trailing space
        real = code != known.index(b"")
        bounds = np.append(0, np.cumsum(real))[bounds]
        code = code[real]
    return np.fromiter(map(xxh64_intdigest, known), dtype=np.uint64, count=len(known))[code], bounds


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    name, taken = f"_{name}", {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def packed(df: DataFrame, without: Iterable[str] = ()) -> Column:
    """All columns of ``df`` but some as one struct: operators carry a user's row in it, so that no name of theirs meets one of his."""
    away = {c.lower() for c in without}
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in away] or [F.lit(0).alias("_")])


def word_array(text: Column) -> Column:
    """Words of a text; none for null."""
    spaced = F.coalesce(text, F.lit(""))
    for c in SPACE_CHARS[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    parts = F.split(spaced, " ")
    # Only leading, trailing and double spaces leave empty parts.
    return F.when(F.contains(F.concat(F.lit(" "), spaced, F.lit(" ")), F.lit("  ")), F.filter(parts, lambda w: w != "")).otherwise(parts)


def word_count(text: Column) -> Column:
    """Number of words (long), 0 for null, without keeping an array of them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def slices(values: pa.Array, limit: int = 1 << 20) -> Iterator[pa.Array]:
    """Consecutive slices of texts or byte strings of about ``limit`` bytes at most."""
    ends = np.cumsum(pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield values.slice(at, to - at)
        at = to


def chunks(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[tuple[pa.Array, ...]]:
    """The columns of consecutive rows whose last column (texts) has about ``limit`` bytes, however the rows come in batches."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch.column(batch.num_columns - 1), limit):
            rows = batch.slice(part.offset - batch.column(batch.num_columns - 1).offset, len(part))
            held.append(rows)
            size += pc.sum(pc.binary_length(part)).as_py() or 0
            if size >= limit:
                yield tuple(c.combine_chunks() for c in pa.Table.from_batches(held).columns)
                held, size = [], 0
    if held:
        yield tuple(c.combine_chunks() for c in pa.Table.from_batches(held).columns)


def small_batches(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A decorator of operators on a first argument ``docs``: what they execute themselves hands texts to Python 1000 rows at a time, not 10,000."""

    @wraps(run)
    def bounded(docs: DataFrame, *args, **named):
        conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(key)
        conf.set(key, str(min(1000, int(before)) if int(before) > 0 else 1000))
        try:
            return run(docs, *args, **named)
        finally:
            conf.set(key, before)

    return bounded


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, and the next stage may need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunked(start: Callable[[], Callable[[pa.Array], pa.Array]], shape: str, limit: int = 4 << 20) -> Callable[..., Column]:
    """An Arrow UDF of one column of texts: ``start()`` gives, once a task, a function from an array of about ``limit`` bytes of them to an array of results."""
    kind = to_arrow_type(DataType.fromDDL(shape))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = start()
        for values in batches:
            parts = [one(part).cast(kind) for part in slices(values, limit)]
            yield pa.concat_arrays(parts) if parts else pa.array([], type=kind)
        give_back()

    return F.arrow_udf(run, shape)


def sliced(start: Callable[[], Callable[[list], pa.Array]], shape: str, limit: int = 1 << 20) -> Callable[..., Column]:
    """An Arrow UDF of one column of texts or byte strings: ``start()`` gives, once a task, a function from a list of values to an array of results.

    Only a slice of about ``limit`` bytes is held as Python objects at a time, however many rows a batch has.
    """
    kind = to_arrow_type(DataType.fromDDL(shape))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = start()
        for values in batches:
            parts = [one(part.to_pylist()).cast(kind) for part in slices(values, limit)]
            yield pa.concat_arrays(parts) if parts else pa.array([], type=kind)
        give_back()

    return F.arrow_udf(run, shape)


def structs(rows: list[tuple], shape: pa.DataType) -> pa.Array:
    """Rows of values as an array of structs of the given type."""
    columns = list(zip(*rows, strict=True)) or [[] for _ in shape]
    return pa.StructArray.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, shape, strict=True)], fields=list(shape))


def batches_by_size(series, limit: int = 16 << 20):
    """Slices (start, stop) of a series of texts, each of about ``limit`` characters at most."""
    start, held = 0, 0
    for i, text in enumerate(series):
        held += len(text) if text is not None else 0
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(series):
        yield start, len(series)


def spread(df: DataFrame, rows_at_most: int = 2_000_000) -> DataFrame:
    """``df``, marked for broadcast if a count shows that it has few (narrow) rows; else joins shuffle it."""
    return F.broadcast(df) if df.limit(rows_at_most + 1).count() <= rows_at_most else df


def runs_of(batches, keys: list[str]):
    """Yields (batch, starts) such that no run of equal keys is cut: the input is sorted by ``keys`` within its partition."""
    import pandas as pd

    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        changes = np.flatnonzero((batch[keys] != batch[keys].shift()).any(axis=1).to_numpy())
        if len(changes) < 2:
            rest = batch
            continue
        yield batch.iloc[: changes[-1]], changes
        rest = batch.iloc[changes[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, np.append(np.flatnonzero((rest[keys] != rest[keys].shift()).any(axis=1).to_numpy()), len(rest))


#: CRC-32 of half a byte, as published with the polynomial.
_NIBBLES = [0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C, 0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C]


def sql_crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8, by halves of bytes, the lower one first."""
    half = lambda c, x: f"xor({c} >> 4, CAST({_NIBBLES} AS BIGINT[])[(xor({c}, {x}) & 15) + 1])"
    digits = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda y: CAST('0x' || y AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {digits}), lambda c, x: {half(half('c', 'x'), '(x >> 4)')}))"
