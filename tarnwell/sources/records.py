"""Inventory records: JSON documents, one per scan, read as a table of variants."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a record that hold the time of a scan and not its content.
CLOCK_FIELDS = ("inventory_provenance", "scanned_at")
_DECODER, _SPACE = json.JSONDecoder(), re.compile(r"[ \t\n\r]*")


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """All ``record.json`` below a folder: path, record (variant), bundle_id, scan_id. A file that is no JSON object is left out."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="record.json")
    return from_json(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def from_json(rows: DataFrame) -> DataFrame:
    """The same for a table with columns path and value (JSON text)."""
    parsed = rows.withColumn("record", F.try_parse_json("value")).where(F.schema_of_variant("record").startswith("OBJECT"))
    return parsed.select("path", "record", F.variant_get("record", "$.bundle_id", "string").alias("bundle_id"), scan_id(F.col("value")).alias("scan_id"))


def _places(text: str) -> dict[str, int] | None:
    """Where the values of the fields of a JSON object begin; None for any other value. Of equal names the last counts."""
    at = _skip(text, 0)
    if text[at : at + 1] != "{":
        return None
    places, at = {}, _skip(text, at + 1)
    while text[at : at + 1] != "}":
        key, at = _DECODER.raw_decode(text, at)
        places[key] = _skip(text, text.index(":", at) + 1)
        at = _DECODER.raw_decode(text, places[key])[1] if text[places[key]] != "[" else _end(text, places[key])
        at = _skip(text, at)
        if text[at : at + 1] == ",":
            at = _skip(text, at + 1)
        elif text[at : at + 1] != "}":
            raise json.JSONDecodeError("Expecting ',' delimiter", text, at)
    return places


def _skip(text: str, at: int) -> int:
    return _SPACE.match(text, at).end()


def _elements(text: str, at: int) -> Iterator[tuple[object, int]]:
    """The elements of the array that begins at a place, one at a time, each with the place behind it."""
    at = _skip(text, at + 1)
    while text[at : at + 1] != "]":
        value, at = _DECODER.raw_decode(text, at)
        at = _skip(text, at)
        if text[at : at + 1] not in (",", "]"):
            raise json.JSONDecodeError("Expecting ',' delimiter", text, at)
        yield value, at
        at = _skip(text, at + 1) if text[at] == "," else at


def _end(text: str, at: int) -> int:
    last = at
    for _, last in _elements(text, at):
        pass
    return text.index("]", last) + 1


def canonical_parts(text: str) -> Iterator[str]:
    """A record in canonical form (sorted keys, two spaces, without wall-clock fields), piece by piece: of its lists only one element is held as objects at a time, however long they are."""
    dumped = lambda value, indent: json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False).replace("\n", "\n" + " " * indent)
    places = _places(text)
    if places is None:
        yield dumped(json.loads(text), 0)
        return
    kept = sorted(k for k in places if k not in CLOCK_FIELDS)
    for i, key in enumerate(kept):
        yield ("," if i else "{") + "\n  " + json.dumps(key, ensure_ascii=False) + ": "
        if text[places[key]] != "[":
            yield dumped(_DECODER.raw_decode(text, places[key])[0], 2)
            continue
        n = 0
        for n, (value, _) in enumerate(_elements(text, places[key]), 1):
            yield ("," if n > 1 else "[") + "\n    " + dumped(value, 4)
        yield "\n  ]" if n else "[]"
    yield "\n}" if kept else "{}"


def scan_id(text: Column) -> Column:
    """Identity of a scan: a hash of its record in canonical form, without wall-clock fields."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        digest = hashlib.sha256()
        for part in canonical_parts(text):
            digest.update(part.encode())
        return digest.hexdigest()[:16]

    def of(texts: pa.Array) -> pa.Array:
        return pa.array([one(t.as_py()) for t in texts], pa.string())

    return F.arrow_udf(of, "string")(text)


def read_repo_list(spark: SparkSession, path: str) -> DataFrame:
    """Targets of a fleet scan: a line each, ``#`` starts a comment."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("target"))
    return lines.where(F.col("target") != "")
