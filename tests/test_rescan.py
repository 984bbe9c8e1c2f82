"""Incremental rescans leave what a scan of the whole trees would, after any sequence of changes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import graph as G
from tarnwell.operators import modules as M
from tarnwell.sources.store import Store
from tarnwell.streaming import rescan as R
from tarnwell.streaming.rescan import Rescan, differences

SHAPE = "bundle_id string, path string, text string, at long"


def scan(files, edges, targets):
    """A module's fact is the digest of all that it depends on: a module that was wrongly left alone keeps an old one."""
    node = lambda b, m: F.concat_ws("|", b, m)
    pairs = G.closure(edges.select(node("bundle_id", "src").alias("src"), node("bundle_id", "dst").alias("dst")), targets.select(node("bundle_id", "module").alias("root")))
    held = pairs.join(files.select(node("bundle_id", "module").alias("node"), "content_hash"), "node")
    facts = held.groupBy("root").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("node", "content_hash"))), ","), 256).alias("value"))
    return targets.withColumn("root", node("bundle_id", "module")).join(facts, "root").select("bundle_id", "module", "value")


def changes(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SHAPE)


def test_python_imports(spark):
    text = "import os, sys as s\nfrom . import a\nfrom ..b.c import (d as e,  # why\n    f)\nfrom g import *\nx = 1; import no\n  import in_block\n# import not_this\n"
    found = {tuple(r)[2:] for r in M.python_imports(spark.createDataFrame([("x", "p.py", text), ("x", "p.js", "import y")], "bundle_id string, path string, text string")).collect()}
    assert found == {(0, "os", None), (0, "sys", None), (1, "", "a"), (2, "b.c", "d"), (2, "b.c", "f"), (0, "g", None), (0, "in_block", None)}


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """Two trees, changed batch by batch at random: what the store said, and the trees after each batch."""
    rng = random.Random(4)
    names = ["pkg/__init__.py", *(f"pkg/m{i}.py" for i in range(7)), "top.py"]
    text = lambda: "\n".join(f"from pkg.m{rng.randrange(7)} import x" for _ in range(rng.randrange(3))) + f"\nv = {rng.randrange(10**6)}\n"
    now = {(b, n): text() for b in "ab" for n in names}
    store = Store(spark, str(tmp_path_factory.mktemp("rescan")), buckets=4)
    rescan, history = Rescan(store, scan, {"scanner_version": "1"}), []
    for batch in range(5):
        if batch == 0:
            some = [(b, n, t) for (b, n), t in now.items()]
        elif batch == 3:
            some = [("a", "pkg/m1.py", None), ("b", "requirements.txt", "x==1\n"), ("b", "pkg/m9.py", "from pkg import m2\n")]
        else:
            some = [("a", "pkg/m0.py", "v = 'passing'\n"), *((rng.choice("ab"), rng.choice(names[1:]), text()) for _ in range(2)), ("a", "notes.md", f"n {batch}")]
            some.append(("a", "pkg/m0.py", text()))  # the later of two changes of a path counts
        for b, n, t in some:
            now[b, n] = t
        now = {k: t for k, t in now.items() if t is not None}
        said = rescan.apply(changes(spark, *some), batch)
        history.append((sorted(map(tuple, said.collect())), dict(now), store.version()))
    return store, rescan, history


def test_modes(grown):
    said = [{b: (mode, reason) for b, mode, reason in rows} for rows, _, _ in grown[2]]
    assert said[0] == {b: ("full", "no prior scan for this bundle") for b in "ab"}
    assert said[1]["a"][0] == "incremental" and said[1]["a"][1].endswith("file(s) changed")
    assert said[3] == {"a": ("full", "source file deleted"), "b": ("full", "dependency manifests changed")} or said[3]["b"][1] == "dependency manifests changed"


def test_tables_equal_a_full_scan_after_every_batch(spark, grown, tmp_path):
    store, _, history = grown
    for i in (1, 3, 4):
        rows, now, version = history[i]
        fresh = Store(spark, str(tmp_path / str(i)), buckets=4)
        Rescan(fresh, scan, {"scanner_version": "1"}).apply(changes(spark, *((b, n, t) for (b, n), t in now.items())), 0)
        for name in ("files", "imports", "facts", "manifests"):
            as_of = lambda s, v=None, name=name: sorted((tuple(r) for r in s.table(name, v).select(*sorted(s.table(name).columns)).collect()), key=str)
            assert as_of(store, version) == as_of(fresh), (i, name)
        if i == 4:
            assert differences(store, fresh, ["files", "imports", "facts", "manifests"]).count() == 0


def test_a_batch_that_comes_again_changes_nothing(spark, grown):
    store, rescan, _ = grown
    before = store.version()
    assert rescan.apply(changes(spark, ("a", "pkg/m2.py", "v = 1\n")), 4) is None and store.version() == before
    assert rescan.applied("changes") == 4 and rescan.applied("others") == -1
    # The same contents again are no change; a batch that fails half-way is as if it had not begun.
    same = store.table("files").where("path = 'top.py'").select("bundle_id", "path", "text", F.lit(1).cast("long").alias("at"))
    assert rescan.apply(same, 5).count() == 0 and rescan.applied("changes") == 5

    def fails(*_):
        raise RuntimeError("stop")

    facts = sorted(map(tuple, store.table("facts").collect()))
    with pytest.raises(RuntimeError, match="stop"):
        Rescan(store, fails, {"scanner_version": "1"}).apply(changes(spark, ("a", "pkg/m2.py", "v = 2\n")), 6)
    assert rescan.applied("changes") == 5 and sorted(map(tuple, store.table("facts").collect())) == facts


def test_only_affected_modules_are_scanned(spark, tmp_path):
    asked = []

    def spy(files, edges, targets):
        asked.append(sorted(r.module for r in targets.collect()))
        return scan(files, edges, targets)

    rescan = Rescan(Store(spark, str(tmp_path / "s"), buckets=2), spy)
    tree = [("t", "p/__init__.py", ""), ("t", "p/a.py", "x = 1"), ("t", "p/b.py", "from p.a import x"), ("t", "p/c.py", "import p.b"), ("t", "q.py", "y = 2")]
    folder = str(tmp_path / "in")
    for rows in (tree, [("t", "p/a.py", "x = 2")], [("t", "q.py", "y = 3")]):
        changes(spark, *rows).coalesce(1).write.mode("append").parquet(folder)
        rescan.start(spark.readStream.schema(SHAPE).parquet(folder), str(tmp_path / "marks")).awaitTermination()
    assert asked == [["p", "p.a", "p.b", "p.c", "q"], ["p.a", "p.b", "p.c"], ["q"]]
    assert rescan.applied("changes") == 2


def test_no_join_by_module_is_a_broadcast(spark, tmp_path, monkeypatch):
    """Only joins by bundle alone may send a table through the driver, as those by file or module grow with the trees."""
    plans = []
    for place in (M, R):
        monkeypatch.setattr(place, "stored", lambda df, name, keep=place.stored: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, name))[1])
    store = Store(spark, str(tmp_path), buckets=2)
    merged = store._merged
    monkeypatch.setattr(store, "_merged", lambda tables, *more: (plans.extend(t._jdf.queryExecution().executedPlan().toString() for t in tables.values()), merged(tables, *more))[1])
    rescan = Rescan(store, lambda files, edges, targets: targets.withColumn("value", F.lit(1)))
    rescan.apply(changes(spark, ("x", "a.py", "v = 1\n"), ("x", "b.py", "import a\n"), ("x", "c.py", "v = 2\n")), 0)
    rescan.apply(changes(spark, ("x", "a.py", "v = 3\n")), 1)
    assert sorted(r.module for r in store.table("facts").collect()) == ["a", "b", "c"]
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if re.search(r"BroadcastHashJoin \[bundle_id#\w+, ", p)]
