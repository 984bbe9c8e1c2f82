"""Source trees as a data source of Spark: ``spark.read.format("tree")``.

Spark's own readers skip empty files and names that begin with a dot; this one lists both, and reads trees that lie in tar and zip
archives. The driver lists folders level by level until it has enough pieces of work; each task walks its folders, or its share of an
archive's members, by itself, so no task and not the driver sees all of a large tree. Files are reached with Arrow's file systems
(local, hdfs, s3, gs), on the executors too.
"""

from __future__ import annotations

import hashlib
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A larger file is listed, but its text is empty.
MAX_BYTES = 1_000_000
# Folders that are no part of a source tree.
SKIPPED_FOLDERS = (".git", "node_modules", "__pycache__", "venv")
ARCHIVES = (".zip", ".whl", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz")
SHAPE = "tree string, path string, text string, content_hash string, n_bytes long"
_ARROW = pa.schema([("tree", pa.string()), ("path", pa.string()), ("text", pa.string()), ("content_hash", pa.string()), ("n_bytes", pa.int64())])
_CHUNK = 1 << 20


@dataclass
class Piece:
    """A file, folder or archive: where it is, the tree it belongs to, its path there, and which share of an archive's members."""

    kind: str
    at: str
    tree: str
    path: str
    share: int = 0
    shares: int = 1


class Work(InputPartition):
    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


def is_archive(name: str) -> bool:
    return name.lower().endswith(ARCHIVES)


def _stem(name: str) -> str:
    return next((name[: -len(e)] for e in sorted(ARCHIVES, key=len, reverse=True) if name.lower().endswith(e)), name)


def _member_path(name: str) -> str | None:
    """A member's path within its archive; None if it lies in a skipped folder or would leave the archive."""
    path = posixpath.normpath(name.replace("\\", "/")).lstrip("/")
    parts = path.split("/")
    return None if path in ("", ".") or ".." in parts or set(parts[:-1]) & set(SKIPPED_FOLDERS) else path


class TreeReader(DataSourceReader):
    def __init__(self, root: str, trees: bool, archives: bool, pieces: int, share_bytes: int):
        self.root, self.trees, self.archives, self.pieces, self.share_bytes = root, trees, archives, pieces, share_bytes

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root if "://" in self.root else "file://" + self.root.removeprefix("file:"))

    def _found(self, files: fs.FileSystem, info: fs.FileInfo, tree: str, path: str) -> list[Piece]:
        """What a folder's entry is; nothing for a skipped folder. An archive is dealt out by its size: a share reads every so-manieth member."""
        if info.type == fs.FileType.Directory:
            return [] if info.base_name in SKIPPED_FOLDERS else [Piece("folder", info.path, tree, path)]
        if info.type != fs.FileType.File:
            return []
        if self.archives and is_archive(info.base_name):
            seekable = info.base_name.lower().endswith((".zip", ".whl", ".tar"))
            shares = max(1, -(-info.size // self.share_bytes)) if seekable else 1
            return [Piece("archive", info.path, tree, path, i, shares) for i in range(shares)]
        return [Piece("file", info.path, tree, path)]

    def _listed(self, files: fs.FileSystem, piece: Piece) -> list[Piece]:
        out = []
        for info in sorted(files.get_file_info(fs.FileSelector(piece.at)), key=lambda i: i.base_name):
            path = f"{piece.path}/{info.base_name}" if piece.path else info.base_name
            out += self._found(files, info, piece.tree, path)
        return out

    def partitions(self) -> list[Work]:
        files, root = self._files()
        info = files.get_file_info(root)
        name = posixpath.basename(root.rstrip("/"))
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        if self.trees:  # every entry of the root is a tree
            entries = self._listed(files, Piece("folder", root, "", ""))
            now = [Piece(p.kind, p.at, _stem(p.path) if p.kind == "archive" else p.path, "", p.share, p.shares) for p in entries if p.kind != "file"]
        elif is_archive(name) and info.type == fs.FileType.File:
            now = [Piece(p.kind, p.at, _stem(name), "", p.share, p.shares) for p in self.__class__(self.root, False, True, self.pieces, self.share_bytes)._found(files, info, "", "")]
        else:
            now = [Piece("folder", root, name, "")]
        while len(now) < self.pieces and any(p.kind == "folder" for p in now):
            now = [q for p in now for q in (self._listed(files, p) if p.kind == "folder" else [p])]
        n = max(1, min(len(now), self.pieces))
        return [Work(now[i::n]) for i in range(n)]

    def read(self, partition: Work) -> Iterator[pa.RecordBatch]:
        files, _ = self._files()
        rows, held = [], 0
        for piece in partition.pieces:
            for row in self._rows(files, piece):
                rows.append(row)
                held += len(row[2])
                if len(rows) >= 1000 or held >= 8 * _CHUNK:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, files: fs.FileSystem, piece: Piece) -> Iterator[tuple]:
        waiting = [piece]
        while waiting:
            at = waiting.pop()
            if at.kind == "folder":
                waiting += reversed(self._listed(files, at))
            elif at.kind == "archive":
                yield from self._members(files, at)
            else:
                with files.open_input_stream(at.at) as stream:
                    yield at.tree, at.path, *_contents(stream)

    def _members(self, files: fs.FileSystem, at: Piece) -> Iterator[tuple]:
        opened = _archive(files, at)
        if opened is None:  # no archive, whatever its name says: a file like any other
            if at.share == 0:
                with files.open_input_stream(at.at) as stream:
                    yield at.tree, at.path or posixpath.basename(at.at), *_contents(stream)
            return
        for i, (name, open_member) in enumerate(opened):
            path = _member_path(name)
            if path is not None and i % at.shares == at.share:
                with open_member() as stream:
                    yield at.tree, f"{at.path}/{path}" if at.path else path, *_contents(stream)


def _archive(files: fs.FileSystem, at: Piece) -> Iterator[tuple] | None:
    """(name, opener) of an archive's regular members, in its order; None if it cannot be opened."""
    name = at.at.lower()
    try:
        if name.endswith((".zip", ".whl")):
            whole = zipfile.ZipFile(files.open_input_file(at.at))
            return ((m.filename, lambda m=m: whole.open(m)) for m in whole.infolist() if not m.is_dir())
        tar = tarfile.open(fileobj=files.open_input_file(at.at), mode="r:") if name.endswith(".tar") else tarfile.open(fileobj=files.open_input_stream(at.at, compression=None), mode="r|*")
        return ((m.name, lambda m=m: tar.extractfile(m)) for m in tar if m.isfile())
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, ValueError):  # too short a file to seek in is a ValueError
        return None


def _contents(stream) -> tuple[str, str, int]:
    """Text (UTF-8, invalid bytes replaced; empty over ``MAX_BYTES``), digest of all bytes and their number; only so much is held."""
    digest, kept, n = hashlib.sha256(), [], 0
    while chunk := stream.read(_CHUNK):
        digest.update(chunk)
        n += len(chunk)
        kept = [*kept, chunk] if n <= MAX_BYTES else []
    return b"".join(kept).decode("utf-8", "replace"), digest.hexdigest(), n


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class TreeSource(DataSource):
    """Options: path; trees (true: every folder and archive right below the path is a tree of its own); archives (true: an archive within a tree is opened, its members lie below its path);
    pieces (of work to look for, 64); share_bytes (of an archive for one task, 64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> TreeReader:
        flag = lambda name: self.options.get(name, "false").lower() == "true"
        trees = flag("trees")
        return TreeReader(self.options["path"], trees, trees or flag("archives"), int(self.options.get("pieces", 64)), int(self.options.get("share_bytes", 64 << 20)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)
