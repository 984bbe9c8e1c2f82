"""Incremental scans: what changed, whether a scan can be skipped or can be incremental, and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import upsert

# Files that all other files depend on.
GLOBAL_FILES = ("package.json", "package-lock.json", "pnpm-lock.yaml", "tsconfig.json", "poetry.lock", "uv.lock", "pyproject.toml")

#: Inputs of a scan, as columns of manifests, in the order in which a difference is told.
INPUTS = {"scanner_version": "scanner version changed", "analysis_version": "analysis version changed", "rulepacks": "rulepack versions changed", "deps_hash": "dependency manifests changed", "tsconfig_hash": "tsconfig changed", "org_pack_hash": "org pack changed", "source_roots": "source-root layout changed"}


def is_global_signal(path: Column) -> Column:
    """Whether a changed file alters what all modules resolve to."""
    base = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    return base.isin(*GLOBAL_FILES) | (base.startswith("requirements") & base.endswith(".txt"))


def files_hash(files: DataFrame) -> DataFrame:
    """(bundle_id, files_hash) of files (bundle_id, path, content_hash; null for a file that is missing): the order of rows does not count.

    Every file has a digest of its own; a bundle's is that of their sum, so that no bundle's files are gathered.
    """
    one = F.sha2(F.concat_ws("\0", "path", F.coalesce("content_hash", F.lit(""))), 256)
    halves = [F.conv(F.substring(one, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16, 31, 46)]
    sums = files.groupBy("bundle_id").agg(*[F.sum(h).alias(f"_{i}") for i, h in enumerate(halves)], F.count("*").alias("_n"))
    return sums.select("bundle_id", F.sha2(F.concat_ws("|", "_n", *[f"_{i}" for i in range(4)]), 256).alias("files_hash"))


def skipped(manifests: DataFrame, current: DataFrame) -> DataFrame:
    """``current`` (bundle_id, head_commit, record_present, scanner_version, analysis_version, rulepacks, org_pack_hash) with skip: the same commit has been scanned with the same inputs."""
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("scanner_version", "analysis_version", "rulepacks", "org_pack_hash")]
    known = ~F.coalesce("c.head_commit", F.lit("")).isin("", "unknown", "unversioned")
    skip = (F.col("m.last_commit") == F.col("c.head_commit")) & known & F.col("c.record_present")
    for s in same:
        skip = skip & s
    return current.alias("c").join(manifests.alias("m"), "bundle_id", "left").select("bundle_id", "c.head_commit", F.coalesce(skip, F.lit(False)).alias("skip"))


def decisions(manifests: DataFrame, current: DataFrame, changed: DataFrame) -> DataFrame:
    """(bundle_id, mode, reason): incremental if all inputs are those of the manifest and no global file changed, else full with the first reason.

    ``current`` has base_available and the columns of INPUTS, ``changed`` (bundle_id, path).
    """
    files = changed.groupBy("bundle_id").agg(F.count("*").alias("n_changed"), F.bool_or(is_global_signal(F.col("path"))).alias("global"))
    known = manifests.select("bundle_id", F.lit(True).alias("_known"), *[F.col(c).alias(f"_was_{c}") for c in INPUTS])
    rows = current.join(known, "bundle_id", "left").join(files, "bundle_id", "left")
    reason = F.when(F.col("_known").isNull(), "no prior scan for this bundle").when(~F.col("base_available"), "base commit unavailable for diff")
    for c, said in INPUTS.items():
        reason = reason.when(~F.col(c).eqNullSafe(F.col(f"_was_{c}")), said)
    reason = reason.when(F.col("global"), "diff touches a global resolution input")
    told = F.coalesce(reason, F.concat(F.coalesce("n_changed", F.lit(0)).cast("string"), F.lit(" file(s) changed")))
    return rows.select("bundle_id", F.when(reason.isNull(), "incremental").otherwise("full").alias("mode"), told.alias("reason"))


def updated_manifests(manifests: DataFrame, scans: DataFrame) -> DataFrame:
    """Manifests with those of the scanned bundles replaced."""
    return upsert(manifests, scans, ["bundle_id"])


def kept_facts(facts: DataFrame, evidence_modules: DataFrame, affected: DataFrame) -> DataFrame:
    """Facts (bundle_id, fact_id, ...) of modules that nothing changed; facts without a module are scanned again."""
    fine = evidence_modules.join(affected, ["bundle_id", "module"], "left_anti")
    return facts.join(fine.select("bundle_id", "fact_id").distinct(), ["bundle_id", "fact_id"], "left_semi")


def gated(table: DataFrame, schema: int, column: str = "schema") -> DataFrame:
    """Rows of a registry if they were written with this schema version; those of other versions count as absent."""
    return table.where(F.col(column) == schema)


def used_defaults(defaults: DataFrame, values: DataFrame, most: int = 2) -> DataFrame:
    """(bundle_id, fact_id, chips): of the environment keys (``env:KEY``) in a fact's value those that have a default, each once in their order, at most ``most`` of them.

    ``defaults`` are (bundle_id, key, value), ``values`` (bundle_id, fact_id, value).
    """
    asked = values.select("bundle_id", "fact_id", F.posexplode(F.array_distinct(F.regexp_extract_all("value", F.lit(r"env:([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))).alias("at", "key"))
    known = defaults.groupBy("bundle_id", "key").agg(F.min("value").alias("default"))
    found = asked.join(known, ["bundle_id", "key"]).groupBy("bundle_id", "fact_id").agg(F.array_sort(F.collect_list(F.struct("at", F.concat_ws("=", "key", "default").alias("chip")))).alias("c"))
    return found.select("bundle_id", "fact_id", F.slice(F.transform("c", lambda x: x["chip"]), 1, most).alias("chips"))


def health(events: DataFrame, by: Sequence[str] = ("bundle_id", "reason")) -> DataFrame:
    """How often each reason for an unresolved value came up."""
    return events.groupBy(*by).agg(F.count("*").alias("n"))
