"""Token ids as binary shards: canonical length-limited Huffman coding from global counts, table-driven decoding of independent blocks.

A shard holds the documents of one range of ids, in ascending order. Its bytes, little-endian::

    magic "TWHUF001" | start u64 | vocabulary u32 | longest code u32 | documents u64 | blocks u64 | tokens u64 | payload bytes u64
    code length of every id, u8 each (0: unused)
    per document: null flag u8, id i64, tokens u64 (three arrays)
    per block: bit offset in the payload u64, tokens u32 (two arrays)
    payload

``start`` counts the ids of all documents in earlier shards. Codes are canonical, so their lengths say all. Each document starts
at a byte; a checkpoint gives the bit at which every ``BLOCK`` ids of a document begin, so blocks decode independently.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, discard, documents, give_back, new_folder, slices, small_batches, written

MAGIC = b"TWHUF001"
_HEAD = struct.Struct("<8sQIIQQQQ")
BLOCK = 1024
LONGEST = 16


class Encoder:
    """Encodes whole texts with a tokenizer file of the tokenizers library.

    Byte-level vocabularies never let a token pass the place before a lone space or line feed between two other characters, so texts are cut there. Each
    distinct piece of a chunk of texts is encoded once, many as one text, and told apart by the bytes of their tokens (a byte-level token has a
    character for each byte). Tokenizers of another kind encode each text as it is.
    """

    #: White space by Unicode or by Python, but for spaces and line feeds; next to it a text is not cut.
    _SPACE = r"[\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        pre = self.tokenizer.pre_tokenizer
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes_of = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)
        self.cuts = isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space and self.tokenizer.normalizer is None and not re.search(r"[ \n]", "".join(added))

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for i in range(0, len(texts), 64) for e in self.tokenizer.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each has. Every piece starts with a lone space or line feed and ends with neither."""
        ids = self._each(["".join(pieces[i : i + 200]) for i in range(0, len(pieces), 200)])
        ids = np.concatenate(ids) if ids else np.zeros(0, dtype=self.kind)
        ends = np.cumsum(self.bytes_of[ids])
        wanted = np.cumsum(pc.binary_length(pa.array(pieces, type=pa.string())).to_numpy(zero_copy_only=False).astype(np.int64))
        stops = np.searchsorted(ends, wanted)
        if (ends[stops] != wanted).any():
            raise ValueError("a token passes the end of a piece")
        return ids, np.diff(stops + 1, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (a null is an empty one), one after another, and how many each text has."""
        texts = texts.cast(pa.string()).fill_null("")
        if not self.cuts:
            found = self._each(texts.to_pylist())
            return np.concatenate([np.zeros(0, dtype=self.kind), *found]), np.array([len(f) for f in found], dtype=np.int64)
        mark = next(c for c in map(chr, range(0xE000, 0xF8FF)) if not pc.any(pc.match_substring(texts, c)).as_py())
        # Pieces between spaces: a line feed starts one, and the mark stands before the first of each text.
        split = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(mark, texts, ""), "\n", " \n"), " ")
        bounds = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)))
        coded = split.flatten().dictionary_encode()
        del split
        known, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        if not len(code):
            return np.zeros(0, dtype=self.kind), np.zeros(0, dtype=np.int64)
        first = np.zeros(len(code), dtype=bool)
        first[bounds[:-1]] = True
        flag = lambda pattern: pc.match_substring_regex(known, pattern).to_numpy(zero_copy_only=False)
        # No cut before or behind white space: such neighbours are one piece.
        late, early = flag(rf"^[\n{mark}]?$|{self._SPACE}$"), flag(rf"^\n?({self._SPACE}|$)")
        unsafe = early[code]
        unsafe[1:] |= late[code[:-1]]
        starts = np.flatnonzero(first | ~unsafe).astype(np.int32)
        lengths = np.diff(np.append(starts, np.int32(len(code))))
        plain = (lengths == 1) & ~first[starts] & ~late[code[starts]]
        base, tail = self._bases(known)
        lone = code[starts[plain]]
        own = base.indices.to_numpy(zero_copy_only=False)[lone]
        seen = np.zeros(len(base.dictionary), dtype=bool)
        seen[own] = True
        shown = base.dictionary.filter(pa.array(seen)).to_pylist()
        ids, sizes = self._pieces([p if p[:1] == "\n" else f" {p}" for p in shown])
        # Every other piece is encoded by itself.
        others = np.flatnonzero(~plain)
        stops = np.cumsum(lengths[others])
        places = np.repeat(starts[others] - stops + lengths[others], lengths[others]) + np.arange(lengths[others].sum())
        words = known.take(pa.array(code[places])).to_pylist()
        joined = [self._text(words[e - n : e], mark) for e, n in zip(stops.tolist(), lengths[others].tolist(), strict=True)]
        names = {t: i for i, t in enumerate(dict.fromkeys(joined))}
        more = self._each(list(names))
        dots = self._each([".", ","])
        table = np.concatenate([ids, *more, *dots])
        sizes = np.concatenate([sizes, [len(m) for m in more], [len(d) for d in dots]]).astype(np.int64)
        # Symbols of each text in order: its pieces, and a full stop or comma that follows one.
        piece, ended = np.empty(len(starts), dtype=np.int32), np.zeros(len(starts), dtype=np.int32)
        piece[plain] = (np.cumsum(seen, dtype=np.int32) - 1)[own]
        piece[others] = [len(shown) + names[t] for t in joined]
        ended[plain] = tail[lone]
        place = np.arange(len(starts), dtype=np.int32) + np.cumsum(ended > 0, dtype=np.int32) - (ended > 0)
        symbols = np.empty(len(starts) + int((ended > 0).sum()), dtype=np.int32)
        symbols[place] = piece
        symbols[place[ended > 0] + 1] = len(shown) + len(names) - 1 + ended[ended > 0]
        offsets = np.append(0, np.cumsum(sizes)) * self.kind.itemsize
        entries = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(table)])
        at = np.append(place[np.searchsorted(starts, bounds[:-1])], len(symbols))
        del piece, ended, place, starts, lengths, plain, unsafe, first, coded, code, lone, own
        out = entries.take(pa.array(symbols))
        ends = np.frombuffer(out.buffers()[1], dtype=np.int64)[: len(symbols) + 1]
        return np.frombuffer(out.buffers()[2], dtype=self.kind)[: ends[-1] // self.kind.itemsize], np.diff(ends[at]) // self.kind.itemsize

    @staticmethod
    def _bases(known: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Pieces without a full stop (1) or comma (2) behind a letter, which is always a token of its own, and which of them each has."""
        dot, comma = (pc.match_substring_regex(known, rf"\pL[{c}]$") for c in ".,")
        base = pc.if_else(pc.or_(dot, comma), pc.utf8_slice_codeunits(known, 0, -1), known).dictionary_encode()
        return base, dot.to_numpy(zero_copy_only=False) + 2 * comma.to_numpy(zero_copy_only=False)

    @staticmethod
    def _text(pieces: list[str], mark: str) -> str:
        """The part of a text that stands for neighbouring pieces."""
        return "".join(p[1:] if p[:1] == mark else p if p[:1] == "\n" else f" {p}" for p in pieces)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_ids(docs: DataFrame, path: str, *, id_col: str, text_col: str, end_id: int, chunk_bytes: int = 8 << 20) -> DataFrame:
    """doc (long), ids (binary) of every whole text with ``end_id`` at its end; a null text is empty. A task holds texts of about ``chunk_bytes`` at a time."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path)
        for docs, texts in chunks(batches, chunk_bytes):
            ids, sizes = of.encode(texts)
            # The end id goes behind each text.
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, of.kind.type(end_id))
            offsets = np.append(0, ends + np.arange(1, len(sizes) + 1)) * of.kind.itemsize
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)])
            for part in slices(held, chunk_bytes):
                yield pa.record_batch({"doc": docs.slice(part.offset, len(part)), "ids": part.cast(pa.binary())})
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(encode, "doc long, ids binary")


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need codes of more than {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(longest - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate((leaves, pairs))
        place = np.argsort(merged, kind="stable")
        level = merged[place]
        is_leaf.append(place < len(leaves))
    depth, take = np.zeros(len(leaves), dtype=np.uint8), 2 * len(leaves) - 2
    for flags in reversed(is_leaf):
        singles = int(flags[:take].sum())
        depth[:singles] += 1
        take = 2 * (take - singles)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in code order, and the code of every id."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    own = lengths[order].astype(np.int64)
    longest = int(own.max(initial=1))
    first = np.concatenate(([0], np.cumsum(1 << (longest - own))))[:-1]
    codes = np.zeros(len(lengths), dtype=np.uint32)
    codes[order] = first >> (longest - own)
    return order, codes


def pack(docs: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Payload and checkpoints (bit offset u64 of every block) of each document of at least one id."""
    ids = np.concatenate(docs)
    sizes = np.array([len(d) for d in docs])
    firsts = np.cumsum(sizes) - sizes
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    before = (ends - bits)[firsts]
    whole = (np.add.reduceat(bits, firsts) + 7) // 8
    begin = np.cumsum(whole) - whole
    at = ends - bits + np.repeat(8 * begin - before, sizes)
    shifted = codes[ids].astype(np.int64) << (32 - bits - (at & 7))
    byte, total = at >> 3, int(whole.sum()) + 4
    payload = np.zeros(total, dtype=np.uint8)
    for k in range(4):
        part = (shifted >> (24 - 8 * k)) & 255
        if k < 2 or part.any():
            payload += np.bincount(byte + k, weights=part, minlength=total).astype(np.uint8)
    out = []
    for size, first, start, n in zip(sizes, firsts, begin, whole, strict=True):
        marks = at[first : first + size : BLOCK] - 8 * start
        out.append((payload[start : start + n].tobytes(), marks.astype("<u8").tobytes()))
    return out


def unpack(payload: bytes, offsets: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, lanes: int = 1 << 15) -> np.ndarray:
    """Ids of all blocks, one after another. Blocks advance together by a table of all windows of the longest code's bits."""
    order, _ = canonical_codes(lengths)
    longest = int(lengths.max(initial=1))
    spans = 1 << (longest - lengths[order].astype(np.int64))
    symbols = np.zeros(1 << longest, dtype=np.uint32)
    steps = np.ones(1 << longest, dtype=np.int64)
    symbols[: spans.sum()] = np.repeat(order, spans)
    steps[: spans.sum()] = np.repeat(lengths[order], spans)
    raw = np.frombuffer(payload + b"\0\0\0\0", dtype=np.uint8)
    places = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), dtype=np.uint32)
    mask = (1 << longest) - 1
    by_size = np.argsort(-sizes, kind="stable")
    for a in range(0, len(by_size), lanes):
        own = by_size[a : a + lanes]
        at, to, left = offsets[own].astype(np.int64), places[own], sizes[own]
        for step in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -step, side="left"))
            here = at[:n]
            byte = here >> 3
            window = (raw[byte].astype(np.int64) << 24) | (raw[byte + 1].astype(np.int64) << 16) | (raw[byte + 2].astype(np.int64) << 8) | raw[byte + 3]
            key = (window >> (32 - longest - (here & 7))) & mask
            out[to[:n] + step] = symbols[key]
            at[:n] = here + steps[key]
    return out


def build_shard(rows: list[tuple[int | None, int, bytes, bytes]], start: int, lengths: np.ndarray) -> bytes:
    """Bytes of a shard from (id, tokens, payload, checkpoints) of its documents."""
    n = np.array([r[1] for r in rows], dtype=np.int64)
    payload = b"".join(r[2] for r in rows)
    ends = np.cumsum([len(r[2]) for r in rows])
    marks = [np.frombuffer(r[3], dtype="<u8") + 8 * (int(e) - len(r[2])) for r, e in zip(rows, ends, strict=True)]
    blocks = np.concatenate([np.minimum(BLOCK, k - BLOCK * np.arange(-(-k // BLOCK))) for k in n]) if len(n) else np.zeros(0)
    offsets = np.concatenate(marks) if marks else np.zeros(0)
    ids = [r[0] for r in rows]
    return b"".join((
        _HEAD.pack(MAGIC, start, len(lengths), int(lengths.max(initial=1)), len(rows), len(blocks), int(n.sum()), len(payload)),
        lengths.astype(np.uint8).tobytes(),
        np.array([i is None for i in ids], dtype=np.uint8).tobytes(), np.array([i or 0 for i in ids], dtype="<i8").tobytes(), n.astype("<u8").tobytes(),
        offsets.astype("<u8").tobytes(), blocks.astype("<u4").tobytes(), payload,
    ))


def read_shard(content: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(id, start, ids) of every document of a shard."""
    magic, start, vocabulary_size, _, n_docs, n_blocks, _, n_payload = _HEAD.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("no token shard")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(content, dtype=kind, count=n, offset=at)
        at += found.nbytes
        return found

    lengths, nulls, ids, sizes = take("u1", vocabulary_size), take("u1", n_docs), take("<i8", n_docs), take("<u8", n_docs).astype(np.int64)
    offsets, blocks = take("<u8", n_blocks), take("<u4", n_blocks).astype(np.int64)
    tokens = unpack(content[at : at + n_payload], offsets, blocks, lengths)
    ends = np.cumsum(sizes)
    for null, doc, size, end in zip(nulls, ids, sizes, ends, strict=True):
        yield None if null else int(doc), start + int(end - size), tokens[end - size : end]


def _count(width: str, vocabulary_size: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(vocabulary_size, dtype=np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                total += np.bincount(np.frombuffer(ids, dtype=width), minlength=vocabulary_size) if len(ids) > vocabulary_size // 4 else 0
            short = b"".join(ids for ids in batch["ids"] if len(ids) <= vocabulary_size // 4)
            total += np.bincount(np.frombuffer(short, dtype=width), minlength=vocabulary_size)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    return count


class Ranges:
    """Shards of ids: the ranges between ``cuts``, and of a range of one id alone ``pieces`` shards by the hash of what is in it."""

    def __init__(self, cuts: list[int], pieces: dict[int, int]):
        self.cuts = np.array(cuts, dtype=np.int64)
        self.pieces = np.array([pieces.get(p, 1) for p in range(len(cuts) + 1)], dtype=np.int64)
        self.first = np.cumsum(self.pieces) - self.pieces

    def shard(self, docs: pa.Array, hashes: pa.Array) -> np.ndarray:
        part = np.searchsorted(self.cuts, docs.to_numpy(zero_copy_only=False), side="left")
        place = ((hashes.to_numpy(zero_copy_only=False) >> 33) + (1 << 30)) * self.pieces[part] >> 31
        return (self.first[part] + place).astype(np.int32)

    @property
    def n(self) -> int:
        return int(self.pieces.sum())


def _packer(width: str, held, ranges: Ranges):
    """(part, payload, marks) of (doc, ids, hash of ids): the shard, and the packed ids."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        lengths = np.frombuffer(held.value, dtype=np.uint8)
        _, codes = canonical_codes(lengths)
        for docs, ids, hashes in batches:
            payloads, marks = [], []
            for part in slices(ids):
                for payload, mark in pack([np.frombuffer(i, dtype=width) for i in part.to_pylist()], lengths, codes):
                    payloads.append(payload)
                    marks.append(mark)
            yield pa.StructArray.from_arrays([pa.array(ranges.shard(docs, hashes)), pa.array(payloads, type=pa.binary()), pa.array(marks, type=pa.binary())], ["part", "payload", "marks"])
        give_back()

    return run


def _writer(folder: str, starts: dict[int, int], held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        rows, shard = [], None
        for batch in batches:
            for part, doc, null, n, payload, marks in zip(*(batch[c] for c in ("part", "doc", "no_id", "n_tokens", "payload", "marks")), strict=True):
                shard = int(part)
                rows.append((None if null else int(doc), int(n), payload, marks))
        if shard is None:
            return
        content = build_shard(rows, starts[shard], np.frombuffer(held.value, dtype=np.uint8))
        n_docs, n_tokens = len(rows), sum(r[1] for r in rows)
        store, path = fs.FileSystem.from_uri(folder)
        name = f"{path}/shard-{shard:07d}.huff"
        # A task that runs twice writes the same bytes; the move makes one whole file of them.
        with store.open_output_stream(own := f"{path}/.{uuid.uuid4().hex}.part") as out:
            out.write(content)
        store.move(own, name)
        rows.clear()
        give_back()
        yield pd.DataFrame({"shard": [shard], "path": [name], "n_docs": [n_docs], "n_tokens": [n_tokens], "n_bytes": [len(content)]})

    return run


def _shard_of(ranges: Ranges):
    def part(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for docs, hashes in batches:
            yield pa.array(ranges.shard(docs, hashes))

    return part


@small_batches
def write_tokens(docs: DataFrame, folder: str, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_tokens: int = 4 << 20, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Encode ``docs`` into shards in ``folder`` (a URI that the executors can write); returns one row per shard.

    Documents are in ascending order of id, null first; rows of the same id stand together, ordered by their ids' bytes. An empty
    table writes no shard. Shards hold about ``shard_tokens`` tokens each; an id (or null) with many more has several shards of its own, by the hash of what its rows hold. Very long texts
    are encoded whole. To the driver come the counts of the vocabulary and one total a shard.
    """
    spark = docs.sparkSession
    of = encoder(tokenizer)
    width, per, size = of.kind.str, of.kind.itemsize, max(of.size, end_id + 1)
    ids = written(token_ids(docs, tokenizer, id_col=id_col, text_col=text_col, end_id=end_id, chunk_bytes=chunk_bytes).withColumn("n_tokens", (F.octet_length("ids") / per).cast("long")), "token-ids")
    counts = np.zeros(size, dtype=np.int64)
    for row in ids.select("ids").mapInPandas(_count(width, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    n = max(1, -(-int(counts.sum()) // shard_tokens))
    cuts = ids.agg(F.percentile_approx("doc", [i / n for i in range(1, n)], 100 * n).alias("c")).first()["c"] if n > 1 else None
    key, digest = F.coalesce(F.col("doc"), F.lit(-(2**63))), F.xxhash64("ids")

    def totals_of(ranges: Ranges) -> dict[int, int]:
        return {r["part"]: r["n"] for r in ids.select(F.arrow_udf(_shard_of(ranges), "int")(key, digest).alias("part"), "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}

    cuts = sorted(set(cuts or []))
    totals = totals_of(ranges := Ranges(cuts, {}))
    if max(totals.values(), default=0) > 4 * shard_tokens:
        hot = {r["id"]: -(-r["n"] // shard_tokens) for r in ids.groupBy(key.alias("id")).agg(F.sum("n_tokens").alias("n")).where(F.col("n") > 2 * shard_tokens).collect()}
        if hot:
            cuts = sorted({*cuts, *hot, *(h - 1 for h in hot if h > -(2**63))})
            totals = totals_of(ranges := Ranges(cuts, {cuts.index(h): k for h, k in hot.items()}))
    starts, at = {}, 0
    for p in sorted(totals):
        starts[p], at = at, at + totals[p]
    held = spark.sparkContext.broadcast(code_lengths(counts).tobytes())
    packed = ids.withColumn("_p", F.arrow_udf(_packer(width, held, ranges), "part int, payload binary, marks binary")(key, F.col("ids"), digest))
    packed = packed.select("_p.part", F.coalesce("doc", F.lit(0)).alias("doc"), F.col("doc").isNull().alias("no_id"), "n_tokens", "_p.payload", "_p.marks")
    dealt = packed.repartitionById(max(totals, default=0) + 1, F.col("part")).sortWithinPartitions(F.col("no_id").desc(), "doc", "n_tokens", "payload")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    shards = written(dealt.mapInPandas(_writer(folder, starts, held), "shard long, path string, n_docs long, n_tokens long, n_bytes long"), "token-shards")
    discard(ids)
    return shards


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (long) of every document, decoded from the shards in ``folder``."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = [(doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, start, ids in read_shard(content)]
                docs = pd.array([r[0] for r in rows], dtype="Int64")
                yield pd.DataFrame({"doc_id": docs, "start": [r[1] for r in rows], "n_tokens": [r[2] for r in rows], "ids_crc32": [r[3] for r in rows]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.huff").load(folder)
    return files.select("content").mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_digest(docs: DataFrame, chunk_bytes: int = 8 << 20) -> DataFrame:
    folder = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer=vocabulary(), chunk_bytes=chunk_bytes)
    return read_tokens(docs.sparkSession, folder)


def op10_token_output(spark, sf_dir: str) -> DataFrame:
    return tokens_digest(documents(spark, sf_dir).select("doc_id", "text"))
