"""A store of versioned tables: a log of snapshots over immutable Parquet files.

A commit writes new files first and then publishes one version, a small document that names the files of every table, by an atomic
operation that fails if the number is taken. Readers take one version and see all of it or nothing. A writer that lost the race
looks at what was published meanwhile: if it left the buckets that he rewrote alone, his files still stand and only the document is
made anew; else his rows are merged with the new ones. A writer that dies before publishing has changed nothing.

Tables are cut into buckets by the hash of their scope's first column, so that an upsert rewrites the buckets of its scopes only. A
version's document has a line a table and bucket, whatever the tables hold. A document that cannot be read counts as absent.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import commit_tag

_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Too many commits were lost to other writers."""


class Store:
    """Versioned tables below ``root``, a folder that the driver and all executors share (a URI of any Hadoop file system, or a local path).

    Publishing needs an operation that fails if a name is taken: hard links on a local file system, renames without overwriting on others (HDFS).
    """

    def __init__(self, spark: SparkSession, root: str, *, buckets: int = 64, attempts: int = 20):
        self.spark, self.buckets, self.attempts = spark, buckets, attempts
        self.root = root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._files(self._log).mkdirs(self._path(self._log))

    # Files

    @property
    def _log(self) -> str:
        return f"{self.root}/_log"

    def _path(self, name: str):
        return self._fs.Path(name)

    def _files(self, name: str):
        return self._path(name).getFileSystem(self._conf)

    def _read(self, name: str) -> str | None:
        path, files = self._path(name), self._files(name)
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, version: int, text: str) -> bool:
        """Make a version visible; False if its number is taken."""
        target, draft = f"{self._log}/{version:020d}.json", f"{self._log}/.draft-{uuid.uuid4().hex}"
        files = self._files(draft)
        out = files.create(self._path(draft), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if urlparse(self.root).scheme in ("", "file"):
                local = lambda name: unquote(urlparse(name).path)
                try:
                    os.link(local(draft), local(target))
                except FileExistsError:
                    return False
                return True
            context = self._fs.FileContext.getFileContext(self._path(draft).toUri(), self._conf)
            none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = none
            try:
                context.rename(self._path(draft), self._path(target), options)
            except Exception as lost:
                if "AlreadyExists" in str(lost):
                    return False
                raise
            return True
        finally:
            files.delete(self._path(draft), False)

    # Versions

    def versions(self) -> list[int]:
        """Numbers of all published versions, readable or not, the newest first."""
        names = [s.getPath().getName() for s in self._files(self._log).listStatus(self._path(self._log))]
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def _snapshot(self, version: int | None = None) -> tuple[int, dict]:
        """The newest readable version up to ``version`` and its tables; (0, no tables) without any."""
        for v in self.versions():
            if version is None or v <= version:
                try:
                    tables = json.loads(self._read(f"{self._log}/{v:020d}.json") or "")["tables"]
                except (ValueError, KeyError, TypeError):
                    continue
                return v, tables
        return 0, {}

    def version(self) -> int:
        return self._snapshot()[0]

    def table(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as of a version, the newest by default; None if it did not exist."""
        return self._of(self._snapshot(version)[1].get(name))

    def _of(self, entry: Mapping | None, only: set[str] | None = None) -> DataFrame | None:
        if entry is None:
            return None
        shape = StructType.fromJson(json.loads(entry["schema"]))
        paths = [f"{self.root}/{p}" for b, folders in sorted(entry["buckets"].items()) if only is None or b in only for p in folders]
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    # Commits

    def _bucket_of(self, column: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(buckets))

    def _merged(self, tables: Mapping[str, DataFrame], scopes: DataFrame, scope: Sequence[str], keys: Mapping[str, Sequence[str]], base: dict) -> dict:
        """Write the buckets of ``scopes`` anew for every table; entries (schema, buckets) of what was written, and which buckets that is."""
        out, run = {}, uuid.uuid4().hex
        for name, rows in tables.items():
            entry = base.get(name)
            n = entry["of"] if entry else self.buckets
            touched = {str(r[0]) for r in scopes.select(self._bucket_of(scope[0], n)).distinct().collect()}
            if name in keys:
                rows = rows.dropDuplicates(list(keys[name]))
            old = self._of(entry, touched)
            if old is not None:
                # The key of a scope may be null; such rows are replaced like others. The join sorts, as there may be a scope a row.
                marks = scopes.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(scope)]).distinct()
                same = [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(scope)]
                rows = old.join(marks.hint("merge"), same, "left_anti").unionByName(rows, allowMissingColumns=True)
            folder = f"data/{run}/{name}"
            spread = rows.withColumn(_BUCKET, self._bucket_of(scope[0], n)).hint("rebalance", _BUCKET)  # a hot bucket is split over tasks
            spread.write.partitionBy(_BUCKET).parquet(f"{self.root}/{folder}")
            made = {s.getPath().getName() for s in self._files(self.root).listStatus(self._path(f"{self.root}/{folder}"))}
            shape = StructType([f for f in rows.schema.fields])
            out[name] = {"schema": shape.json(), "of": n, "buckets": {b: [f"{folder}/{_BUCKET}={b}"] if f"{_BUCKET}={b}" in made else [] for b in touched}}
        return out

    def commit(self, change: Callable[[dict], dict]) -> int:
        """Publish a version. ``change`` gets the tables of the newest version and returns entries with the buckets that it rewrote; it is called again only if another writer rewrote one of these."""
        version, base = self._snapshot()
        entries = change(base)
        for turn in range(self.attempts):
            tables = dict(base)
            for name, entry in entries.items():
                before = base.get(name, {"buckets": {}})["buckets"]
                tables[name] = entry | {"buckets": before | entry["buckets"]}
            number = max([version, *self.versions()[:1]]) + 1
            if number == version + 1 or self._snapshot()[0] == version:
                if self._publish(number, json.dumps({"tables": tables, "at": time.time()}, sort_keys=True)):
                    return number
            time.sleep(min(1.0, 0.01 * 2**turn) * (1 + uuid.uuid4().int % 100 / 100))
            newer, now = self._snapshot()
            if any(now.get(n, {"buckets": {}})["buckets"].get(b) != base.get(n, {"buckets": {}})["buckets"].get(b) or (n in now) != (n in base) or now.get(n, {}).get("schema") != base.get(n, {}).get("schema") for n, e in entries.items() for b in e["buckets"]):
                entries = change(now)
            version, base = newer, now
        raise Conflict(f"lost {self.attempts} commits to other writers")

    def upsert(self, tables: Mapping[str, DataFrame], scopes: DataFrame, scope: Sequence[str], keys: Mapping[str, Sequence[str]] | None = None) -> int:
        """In one version, replace in every table all rows of ``scopes`` (a table of the ``scope`` columns) by those given; other rows stay. Of rows with equal ``keys`` one stays.

        A scope without rows in a table loses those it had there. Tables are made when they are first written. Returns the version.
        """
        return self.commit(lambda base: self._merged(tables, scopes, scope, keys or {}, base))

    def vacuum(self, keep: int = 10, older_than: float = 24 * 3600.0) -> int:
        """Delete the files that none of the newest ``keep`` readable versions names and that are older than ``older_than`` seconds, so that no running writer loses his, and older versions. Returns the number of folders."""
        kept, held = [], set()
        for v in self.versions():
            found, tables = self._snapshot(v)
            if found == v and len(kept) < keep:
                kept.append(v)
                held |= {p.split("/")[1] for entry in tables.values() for paths in entry["buckets"].values() for p in paths}
        files, gone = self._files(self.root), 0
        for v in self.versions():
            if kept and v < kept[-1]:
                files.delete(self._path(f"{self._log}/{v:020d}.json"), False)
        data = self._path(f"{self.root}/data")
        for status in files.listStatus(data) if files.exists(data) else ():
            if status.getPath().getName() not in held and status.getModificationTime() / 1000 < time.time() - older_than:
                files.delete(status.getPath(), True)
                gone += 1
        return gone

    # What scans leave

    def put_manifests(self, manifests: DataFrame) -> int:
        """Manifests (bundle_id, ...) in place of earlier ones of their bundles, as documents."""
        rows = manifests.select("bundle_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))
        return self.upsert({"manifests": rows}, rows.select("bundle_id"), ["bundle_id"], {"manifests": ["bundle_id"]})

    def manifests(self, shape: StructType) -> DataFrame:
        """Manifests of that shape; one that does not parse, or has another bundle's name, counts as absent."""
        rows = self.table("manifests")
        if rows is None:
            return self.spark.createDataFrame([], shape)
        parsed = rows.select("bundle_id", F.from_json("document", shape).alias("m"))
        return parsed.where(F.col("m.bundle_id").eqNullSafe(F.col("bundle_id"))).select("m.*")

    def put_artifacts(self, tables: Mapping[str, DataFrame], commits: DataFrame) -> int:
        """Artifacts of scans, tables with bundle_id and commit, in place of those of the same bundle and (first eight characters of the) commit.

        ``commits`` (bundle_id, commit) names the scans, so that one without facts is known too.
        """
        tagged = {name: rows.withColumn("commit8", commit_tag(F.col("commit"))) for name, rows in tables.items()}
        scans = commits.select("bundle_id", "commit", commit_tag(F.col("commit")).alias("commit8")).distinct()
        return self.upsert({**tagged, "scans": scans}, scans, ["bundle_id", "commit8"])

    def has_record(self, bundle_id: str, commit: str) -> bool:
        rows = self.table("scans")
        return rows is not None and bool(rows.where((F.col("bundle_id") == bundle_id) & (F.col("commit8") == commit[:8])).take(1))

    def artifacts(self, name: str, bundle_id: str, commit: str) -> DataFrame | None:
        """A table of one scan; None if that scan has left none."""
        rows = self.table(name) if self.has_record(bundle_id, commit) else None
        return None if rows is None else rows.where((F.col("bundle_id") == bundle_id) & (F.col("commit8") == commit[:8]))

    def put_registry(self, name: str, entries: DataFrame, schema: int, key: str) -> int:
        """An organisation's registry: entries in place of those of the same key, marked with the schema version that wrote them."""
        rows = entries.withColumn("schema", F.lit(schema))
        return self.upsert({name: rows}, rows.select(key), [key], {name: [key]})

    def registry(self, name: str, schema: int) -> DataFrame | None:
        """The entries that this schema version wrote; those of other versions count as absent."""
        rows = self.table(name)
        return None if rows is None else rows.where(F.col("schema") == schema).drop("schema")
