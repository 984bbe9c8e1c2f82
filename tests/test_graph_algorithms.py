"""Re-exports by doubling, strong components, reached items, intervals: against brute force on small inputs, and rounds on long ones."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tarnwell.operators import graph as G
from tarnwell.operators import intervals as V
from tarnwell.operators import modules as M

# Re-exports


def canonical(spark, exports, names):
    e = spark.createDataFrame([("b", *x) for x in exports], "bundle_id string, module string, name string, to_module string, to_name string")
    n = spark.createDataFrame([("b", *x) for x in names], "bundle_id string, module string, name string")
    return {(r["module"], r["name"]): (r.canonical_module, r.canonical_name, r.cyclic) for r in M.canonical_names(n, e).collect()}


def test_re_exports_against_walking(spark):
    rng = random.Random(2)
    places = [(f"m{i}", f"n{i % 3}") for i in range(60)]
    exports = {p: rng.choice(places) for p in rng.sample(places, 45)}
    wanted = {}
    for p in places:
        seen, at = [p], p
        while at in exports and exports[at] not in seen:
            at = exports[at]
            seen.append(at)
        if at in exports:  # a cycle, named by its least member
            wanted[p] = (*min(seen[seen.index(exports[at]) :]), True)
        else:
            wanted[p] = (*at, False)
    assert canonical(spark, [(*a, *b) for a, b in exports.items()], places) == wanted
    assert any(w[2] for w in wanted.values()) and canonical(spark, [], [("m", "n")]) == {("m", "n"): ("m", "n", False)}
    assert canonical(spark, [("a", "x", "a", "x")], [("a", "x"), ("q", "x")]) == {("a", "x"): ("a", "x", True), ("q", "x"): ("q", "x", False)}


def test_a_thousand_re_exports_take_ten_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(M, "stored", lambda df, name, keep=M.stored: (rounds.append(name), keep(df, name))[1])
    found = canonical(spark, [(f"m{i}", "x", f"m{i + 1}", "x") for i in range(1000)], [("m0", "x"), ("m999", "x"), ("m1000", "x")])
    assert set(found.values()) == {("m1000", "x", False)} and len(rounds) <= 12


# Strong components and what they reach


def random_graph(seed, n=24, m=34):
    rng = random.Random(seed)
    return {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}


def forward(edges, n):
    reach = {i: {i} for i in range(n)}
    for _ in range(n):
        for a, b in edges:
            reach[a] |= reach[b]
    return reach


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_and_items(spark, seed):
    n, edges = 24, random_graph(seed)
    reach = forward(edges, n)
    e = spark.createDataFrame(list(edges), "src long, dst long")
    every = spark.range(n).withColumnRenamed("id", "node")
    found = {r.node: r.component for r in G.strong_components(e, every).collect()}
    assert found == {i: max(j for j in reach[i] if i in reach[j]) for i in range(n)}
    rng = random.Random(seed)
    items = {(rng.randrange(n), f"t{rng.randrange(40)}") for _ in range(30)}
    sets, places = G.reached_items(e, spark.createDataFrame(list(items), "node long, item string"), every.select(F.col("node").alias("root")))
    wanted = {i: {t for a, t in items if a in reach[i]} for i in range(n)}
    pairs = [(r.root, r.item) for r in G.listed_items(sets, places).collect()]
    assert sorted(pairs) == sorted((i, t) for i, ts in wanted.items() for t in ts)
    assert {r.root: r.n for r in G.item_counts(sets).collect()} == {i: len(ts) for i, ts in wanted.items() if ts}


def test_a_cycle_makes_no_pairs(spark):
    """All of one cycle share one set: a row or two for each, not one for each pair of them."""
    n = 14
    e = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)], "src long, dst long")
    items = spark.range(n).selectExpr("id AS node", "concat('t', id) AS item")
    sets, _ = G.reached_items(e, items, spark.range(n).withColumnRenamed("id", "root"))
    assert sets.count() <= 8 * n and {r.n for r in G.item_counts(sets).collect()} == {n}


# Edges with reasons for what was dropped


def test_dropped_edges_are_counted_in_the_same_pass(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    part = spark.createDataFrame([("F", "t", "a", "b"), ("F", "t", "a", "b"), ("F", "t", "a", "x"), ("F", "t", "y", "b"), ("F", "t", "x", "y"), ("F", "t", "x", "y")], "family string, type string, src string, dst string")
    seen = Observation("edges")
    assert [tuple(r[c] for c in (*G.EDGE, "seen")) for r in G.edges([part], nodes, seen).collect()] == [("F", "t", "a", "b", 2)]
    assert seen.get == {"seen": 6, "no_src": 1, "no_dst": 1, "no_ends": 2}
    counts = Observation("reasons")
    events = spark.createDataFrame([("depth",), ("time",), ("depth",), (None,), ("odd",)], "reason string")
    assert G.observed_reasons(events, "reason", ["depth", "time", "none"], counts).where("reason = 'time'").count() == 1
    assert counts.get == {"depth": 2, "time": 1, "none": 0, "other": 2}


# Intervals


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_points_in_spans(spark, seed):
    rng = random.Random(seed)
    spans = [(rng.choice("ab"), i, a, a + rng.choice([-1, 0, 1, 7, 100, 1000])) for i, a in enumerate(rng.randrange(-300, 300) for _ in range(60))] + [("a", 98, -(2**61), 2**61), ("b", 99, None, 3), (None, 97, 0, 9)]
    points = [(rng.choice("ab"), i, rng.randrange(-400, 400)) for i in range(80)] + [("a", 90, None), ("a", 91, 2**60), (None, 92, 3)]
    found = V.contained(spark.createDataFrame(points, "key string, p int, at long"), spark.createDataFrame(spans, "key string, s int, start long, stop long"), ["key"], "at", "start", "stop").collect()
    assert sorted((r.p, r.s) for r in found) == sorted((p, s) for k, p, at in points for h, s, a, z in spans if k is not None and k == h and None not in (at, a) and a <= at <= z)


def test_many_spans_and_points_of_one_file(spark):
    """100,000 of each, ten of which hold a point on average: the join makes the matches, not the product."""
    n = 100_000
    spans = spark.range(n).selectExpr("'f' AS key", "id * 10 AS start", "id * 10 + 99 AS stop")
    points = spark.range(n).selectExpr("'f' AS key", "id * 10 + 5 AS at")
    assert V.contained(points, spans, ["key"], "at", "start", "stop").count() == 10 * n - 45


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merged_and_subtracted(spark, seed):
    rng = random.Random(seed)
    some = lambda n: [(rng.choice("ab"), i, a, a + rng.choice([-1, 0, 1, 3, 8, 30])) for i, a in enumerate(rng.randrange(60) for _ in range(n))]
    own, taken = some(25), some(9)
    shape = "key string, s int, start long, stop long"
    covered = {k: {x for h, _, a, z in taken if h == k for x in range(a, z + 1)} for k in "ab"}
    left = V.subtracted(spark.createDataFrame(own, shape), spark.createDataFrame(taken, shape), ["key"], "start", "stop").collect()
    wanted = []
    for k, s, a, z in own:
        run = None
        for x in [*range(a, z + 1), None]:
            inside = x is not None and x not in covered[k]
            if inside and run is None:
                run = x
            elif not inside and run is not None:
                wanted.append((k, s, run, (z if x is None else x - 1)))
                run = None
    assert sorted(map(tuple, left)) == sorted(wanted)
    joined = V.merged(spark.createDataFrame(taken, shape), ["key"], "start", "stop").collect()
    assert {k: sorted(x for h, a, z in map(tuple, joined) if h == k for x in range(a, z + 1)) for k in "ab"} == {k: sorted(v) for k, v in covered.items()}


def test_times_are_places(spark):
    points = spark.sql("SELECT 1 AS key, timestamp'2026-01-01 00:00:01.5' AS at, date'2026-01-02' AS day")
    spans = spark.sql("SELECT 1 AS key, timestamp'2026-01-01 00:00:01' AS start, timestamp'2026-01-01 00:00:01.5' AS stop, date'2026-01-03' AS a, date'2026-01-09' AS z")
    assert V.contained(points, spans, ["key"], "at", "start", "stop").count() == 1 and V.contained(points, spans, ["key"], "day", "a", "z").count() == 0
    with pytest.raises(TypeError):
        V.contained(points.withColumn("at", F.lit(1.5)), spans, ["key"], "at", "start", "stop")


def test_intervals_never_go_through_the_driver(spark):
    """Files that look small unfold to many rows: neither side of an interval join is broadcast, and a long span costs no more than its pieces."""
    n = 50_000
    spans = spark.range(n).selectExpr("CAST(id % 50 AS STRING) AS key", "id AS s", "id * 10 AS start", "id * 10 AS stop")
    long_ones = spark.range(50).selectExpr("CAST(id AS STRING) AS key", "-1 - id AS s", "-5L AS start", "5000000L AS stop")
    taken = spark.range(n).selectExpr("CAST(id % 50 AS STRING) AS key", "id * 10 - 4 AS start", "id * 10 + (id % 3) - 3 AS stop")
    left = V.subtracted(spans.unionByName(long_ones), taken, ["key"], "start", "stop")
    points = spark.range(n).selectExpr("CAST(id % 50 AS STRING) AS key", "id * 10 AS at")
    for rows in (left, V.contained(points, taken, ["key"], "at", "start", "stop")):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert (left.where("s >= 0").count(), left.where("s < 0").count()) == (n, n + 50)
    assert V.subtracted(spark.createDataFrame([(None, 1, 0, 9), ("a", 2, 0, 9)], "key string, s int, start long, stop long"), spark.createDataFrame([(None, 0, 5), ("a", 9, 9)], "key string, start long, stop long"), ["key"], "start", "stop").orderBy("s").collect() == [(None, 1, 0, 9), ("a", 2, 0, 8)]


def test_closures_send_no_table_through_the_driver(spark, monkeypatch):
    """Neither the rounds nor the result of reached items over a graph broadcast a table that grows with it; the places of items may be."""
    plans = []
    monkeypatch.setattr(G, "stored", lambda df, name, keep=G.stored: (plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()), keep(df, name))[1])
    e = spark.createDataFrame([(0, 1), (1, 0), (1, 2)], "src long, dst long")
    items = spark.createDataFrame([(0, "a"), (2, "b")], "node long, item string")
    sets, _ = G.reached_items(e, items, spark.range(3).withColumnRenamed("id", "root"))
    assert {r.root: r.n for r in G.item_counts(sets).collect()} == {0: 2, 1: 2, 2: 1}
    sent = [p for p in [*plans, sets._jdf.queryExecution().executedPlan().toString()] if "BroadcastExchange" in p]
    assert len(sent) <= 1  # that of the places
