"""Incremental rescans of source trees as one operation: changed files in, facts of all modules that they touch out.

Every micro-batch is one version of a store: its files, what they import, the facts of the affected modules and the number of the
batch are published together, so a batch that is delivered again changes nothing and one that fails half-way is as if it had never
begun. After any sequence of batches the tables hold what a scan of the whole trees would. Joins by file or module sort, so that no table that grows with the trees goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import incremental as I
from ..operators import modules as M
from ..session import stored
from ..sources.store import Store

_FILES = "bundle_id string, path string, text string, content_hash string"
_IMPORTS = "bundle_id string, path string, level int, target string, name string"
_NO_IMPORTS = "bundle_id string, importer string, level int, target string, name string, absolute string"
_SOURCE = r"\.py$"
_LAZY = r"(?m)^def __getattr__\("
#: scan(files with module, dependency edges, targets) -> facts (bundle_id, module, ...) of the targets (bundle_id, module) only.
Scan = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


class Rescan:
    """Scans of the trees in a store. ``inputs`` are the versions and hashes of :data:`INPUTS <tarnwell.operators.incremental.INPUTS>` that hold for all bundles; another value of any makes the next scan of a bundle a full one."""

    def __init__(self, store: Store, scan: Scan, inputs: Mapping[str, str] | None = None, facts: str = "facts"):
        self.store, self.scan, self.facts = store, scan, facts
        self.inputs = {c: (inputs or {}).get(c) for c in ("scanner_version", "analysis_version", "rulepacks", "org_pack_hash")}

    def _table(self, base: dict, name: str, shape: str) -> DataFrame:
        found = self.store._of(base.get(name))
        return self.store.spark.createDataFrame([], shape) if found is None else found

    def _inputs(self, files: DataFrame) -> DataFrame:
        """What a scan of each bundle rests on beside its modules."""
        name = F.regexp_extract("path", r"([^/]*)$", 1)
        of = lambda kept, column: I.files_hash(files.where(kept)).select("bundle_id", F.col("files_hash").alias(column))
        deps, config = of(I.is_global_signal(F.col("path")) & (name != "tsconfig.json"), "deps_hash"), of(name == "tsconfig.json", "tsconfig_hash")
        rooted = F.max(F.when(F.col("path").rlike(r"^src/[^/]+/__init__\.py$"), "src")).alias("source_roots")
        bundles = files.groupBy("bundle_id").agg(rooted).join(deps, "bundle_id", "left").join(config, "bundle_id", "left")
        return bundles.withColumns({c: F.lit(v).cast("string") for c, v in self.inputs.items()})

    def _change(self, changes: DataFrame, stream: str, batch: int, base: dict, said: list) -> dict:
        spark = self.store.spark
        last = changes.groupBy("bundle_id", "path").agg(F.max_by(F.struct("text"), "at").alias("f")).select("bundle_id", "path", "f.text")
        last = last.withColumn("content_hash", F.sha2("text", 256))
        old = self._table(base, "files", _FILES)
        known = old.select("bundle_id", "path", F.col("content_hash").alias("_was"))
        new = stored(last.join(known.hint("merge"), ["bundle_id", "path"], "left").where(~F.col("content_hash").eqNullSafe(F.col("_was"))).drop("_was"), "rescan-changed")
        bundles = new.select("bundle_id").distinct()
        marks = spark.createDataFrame([(stream, batch)], "stream string, batch long")
        done = self.store._merged({"batches": marks}, marks.select("stream"), ["stream"], {}, base)
        if not new.take(1):
            said.append(spark.createDataFrame([], "bundle_id string, mode string, reason string"))
            return done
        keys = ["bundle_id", "path"]
        touched = lambda rows: rows.join(bundles, "bundle_id", "left_semi")
        renewed = lambda rows, more: touched(rows).join(new.select(*keys).hint("merge"), keys, "left_anti").unionByName(more)
        present = new.where(F.col("text").isNotNull())
        files = stored(renewed(old, present), "rescan-files")
        imported = M.python_imports(present)
        imports = stored(renewed(self._table(base, "imports", _IMPORTS), imported), "rescan-imports")
        modules = stored(M.module_names(files.where(F.col("path").rlike(_SOURCE))), "rescan-modules")
        before = M.module_names(touched(old).where(F.col("path").rlike(_SOURCE)))
        # Full or incremental, and which modules that means.
        inputs = self._inputs(files)
        manifests = self._table(base, "manifests", inputs.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))
        decided = I.decisions(manifests, inputs.withColumn("base_available", F.lit(True)), new.select(*keys))
        gone = new.where(F.col("text").isNull() & F.col("path").rlike(_SOURCE)).select("bundle_id", F.lit(True).alias("_gone")).distinct()
        lost = F.coalesce(F.col("_gone"), F.lit(False)) & (F.col("mode") == "incremental")
        decided = decided.join(gone, "bundle_id", "left").select("bundle_id", F.when(lost, "full").otherwise(F.col("mode")).alias("mode"), F.when(lost, "source file deleted").otherwise(F.col("reason")).alias("reason"))
        decided = stored(decided, "rescan-decided")
        said.append(decided)
        bound = stored(M.bound_imports(imports.join(modules.select(*keys, F.col("module").alias("importer")).hint("merge"), keys).drop("path"), modules), "rescan-bound")
        edges, ways = M.dependency_edges(bound, modules), stored(M.dependency_ways(bound, modules), "rescan-ways")
        full = decided.where("mode = 'full'").select("bundle_id")
        part = new.join(full, "bundle_id", "left_anti").join(modules.hint("merge"), keys).select("bundle_id", "module")
        lazy = files.where(F.col("path").endswith("__init__.py") & F.col("text").rlike(_LAZY)).join(modules.hint("merge"), keys).select("bundle_id", "module")
        affected = M.affected_modules(part, ways, bound, lazy)
        whole = modules.select("bundle_id", "module").join(full, "bundle_id", "left_semi")
        targets = stored(affected.unionByName(whole).distinct(), "rescan-targets")
        found = self.scan(files.join(modules.select(*keys, "module").hint("merge"), keys), edges, targets)
        # Modules that a full scan no longer finds lose their facts.
        stale = before.select("bundle_id", "module").join(full, "bundle_id", "left_semi")
        entries = dict(done)
        for tables, scopes, scope in (({"files": present, "imports": imported}, new.select(*keys), keys), ({self.facts: found}, targets.unionByName(stale).distinct(), ["bundle_id", "module"]), ({"manifests": inputs}, bundles, ["bundle_id"])):
            entries |= self.store._merged(tables, scopes, scope, {}, base)
        return entries

    def applied(self, stream: str) -> int:
        """The number of the last batch of a stream that is in the store; -1 without any."""
        rows = self.store.table("batches")
        found = None if rows is None else rows.where(F.col("stream") == stream).agg(F.max("batch")).first()[0]
        return -1 if found is None else found

    def apply(self, changes: DataFrame, batch: int, stream: str = "changes") -> DataFrame | None:
        """Take a batch of ``changes`` (bundle_id, path, text: null if deleted, at: the order of changes of a path) into the store.

        Returns (bundle_id, mode, reason) of the bundles scanned; None if the batch was there already, so that nothing was done.
        """
        if batch <= self.applied(stream):
            return None
        said: list[DataFrame] = []
        changes = stored(changes.select("bundle_id", "path", "text", "at"), "rescan-batch")
        self.store.commit(lambda base: self._change(changes, stream, batch, base, said))
        return said[-1]

    def start(self, changes: DataFrame, checkpoint: str, stream: str = "changes") -> StreamingQuery:
        """Apply a stream of changes batch by batch, each exactly once, and stop when all that is there has been read."""
        each = lambda batch, number: self.apply(batch, number, stream)
        return changes.writeStream.foreachBatch(lambda batch, number: each(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def differences(a: Store, b: Store, names: Sequence[str]) -> DataFrame:
    """(name, side, n): how many rows of each table only one of two stores holds, repeats counted; no rows if they are equal."""
    out = []
    for name in names:
        x, y = a.table(name), b.table(name)
        columns = sorted(x.columns)
        both = x.select(*columns, F.lit(1).alias("_n")).unionByName(y.select(*columns, F.lit(-1).alias("_n")))
        out.append(both.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0").select(F.lit(name).alias("name"), F.when(F.col("_n") > 0, "first").otherwise("second").alias("side"), F.abs("_n").alias("n")))
    return reduce(DataFrame.unionByName, out).groupBy("name", "side").agg(F.sum("n").alias("n"))
