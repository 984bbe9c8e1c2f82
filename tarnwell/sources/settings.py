"""Settings of a scan, and an organisation's lists of hosts and packages as a small table."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, fields, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import yaml_text

LISTS = ("gateway_hosts", "payment_hosts", "sensitive_hosts", "known_wrapper_packages")


@dataclass(frozen=True)
class Settings:
    """Limits of a scan; ``from_environment`` takes ``TARNWELL_<NAME>`` where it is set."""

    most_files: int = 100_000
    most_lines: int = 10_000_000
    adjudication_calls: int = 20
    evidences: int = 10
    hops: int = 4

    @classmethod
    def from_environment(cls, given: Mapping[str, str] = os.environ) -> Settings:
        found = {f.name: int(given[name]) for f in fields(cls) if (name := f"TARNWELL_{f.name.upper()}") in given}
        return replace(cls(), **found)


def read_org_pack(spark: SparkSession, path: str) -> DataFrame:
    """(pack, list, value) of an organisation's YAML files, each a pack by itself: of lists of values, or of maps of one value (``- fqname: value``). A file that is no YAML has no lists."""
    shape = pa.list_(pa.struct([("list", pa.string()), ("value", pa.string())]))

    def lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[{"list": k, "value": v} for k, v in yaml_text.listed(t or "")] for t in texts.to_pylist()], type=shape)

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("pack"), "value")
    return files.select("pack", F.explode(F.arrow_udf(lists, "array<struct<list:string,value:string>>")("value")).alias("e")).select("pack", "e.list", "e.value").distinct()


def members(pack: DataFrame, name: str, most: int = 10_000) -> list[str]:
    """The values of one list, in order; a pack with more than ``most`` is refused, as they become literals of a plan."""
    rows = [r["value"] for r in pack.where(F.col("list") == name).select("value").distinct().orderBy("value").limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"{name} has more than {most} values")
    return rows
