import hashlib

from pyspark.sql import functions as F

from tarnwell.functions import scalars as S
from tarnwell.operators import graph as G
from tarnwell.operators import ledger as L
from tarnwell.operators import relational as R


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_names(spark):
    assert one(spark, S.slug(F.col("a")), a="  Billing Agent (v2)!") == "billing-agent-v2"
    assert one(spark, S.slug(F.col("a")), a="!!") == "unnamed"
    assert one(spark, S.package_name(F.col("a")), a="Llama-Index.core") == "llama_index_core"
    assert one(spark, S.bundle_name(F.col("a")), a="https://host/own/repo.git") == "own__repo"
    assert one(spark, S.evidence_path(F.col("a")), a="src/a.py:10-12") == "src/a.py"
    assert one(spark, S.deployment_of(F.col("a")), a="https://x/openai/deployments/gpt/chat") == "gpt"


def test_paths(spark):
    cases = {"tests/a.py": "test", "src/test_a.py": "test", "src/a_test.py": "test", "conftest.py": "test", "web/a.spec.ts": "test", "examples/a.py": "example", "src/testing.py": "production"}
    for path, location in cases.items():
        assert one(spark, S.path_location(F.col("a")), a=path) == location, path
    assert [one(spark, S.path_language(F.col("a")), a=p) for p in ("a.py", "a.TSX", "a.mjs")] == ["python", "typescript", "javascript"]


def test_hosts(spark):
    cases = {
        None: "vendor_external", "not a url": "unknown", "https://api.openai.com/v1": "vendor_external", "https://x.openai.azure.com/": "vendor_external", "http://10.1.2.3:8080/": "self_hosted", "http://172.32.0.1/": "unknown",
        "https://GW.corp/x": "internal_gateway", "http://localhost/": "self_hosted", "https://elsewhere.net": "unknown", "https://bedrock-runtime.eu-1.amazonaws.com/m": "vendor_external",
    }
    for url, kind in cases.items():
        assert one(spark, S.provider_class(F.col("a"), ["gw.corp"]), a=url) == kind, url


def test_secrets_and_severity(spark):
    assert one(spark, S.first_kind(F.col("a"), S.SECRET_PATTERNS), a="key AKIA" + "A" * 16) == "aws_access_key"
    assert one(spark, S.redact(F.col("a")), a="x sk-" + "a" * 24 + " y") == "x <redacted:openai_key> y"
    assert one(spark, S.severity(F.col("a")), a="unapproved_gateway") == "high"
    assert one(spark, S.severity(F.col("a"), F.col("b")), a="unapproved_gateway", b="low") == "low"
    assert one(spark, S.severity(F.col("a")), a="other") is None


def test_shape_score(spark):
    no = F.lit(False)
    score = lambda keys, path=no: S.shape_score(path=path, chain=no, keys=F.col("k"), response=no, auth=no, stream=no)
    assert one(spark, score(None), k=["model", "messages"]) == 3
    assert one(spark, score(None, F.lit(True)), k=["model", "file"]) == 5
    assert one(spark, score(None), k=["messages", "temperature", "top_p", "max_tokens"]) == 4
    assert one(spark, score(None), k=[]) == 0


def test_closures_with_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src long, dst long")
    seeds = spark.createDataFrame([(2,)], "node long")
    assert {(r.node, r.hops) for r in G.reached(seeds, edges).collect()} == {(2, 0), (3, 1), (1, 2), (4, 2)}
    assert {r.node for r in G.affected(spark.createDataFrame([(4,)], "node long"), edges).collect()} == {1, 2, 3, 4}
    pairs = G.closure(edges, spark.createDataFrame([(4,), (5,), (1,)], "root long")).collect()
    assert {(r.root, r.node) for r in pairs} == {(4, 4), (5, 5), (1, 1), (1, 2), (1, 3), (1, 4)}
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "node long")
    assert {r.node: r.liveness for r in G.liveness(nodes, seeds, edges).collect()} == {1: "reachable", 2: "invoked", 3: "reachable", 4: "reachable", 5: "defined", 6: "defined"}


def test_edges_need_both_ends(spark):
    part = spark.createDataFrame([("f", "t", "a", "b"), ("f", "t", "a", "b"), ("f", "t", "a", "z")], "family string, type string, src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    found = G.edges([part], nodes)
    assert [(r.src, r.dst, r.seen) for r in found.collect()] == [("a", "b", 2)]
    assert {(r.node, r.neighbour) for r in G.neighbours(found, direction="both").collect()} == {("a", "b"), ("b", "a")}
    assert G.neighbours(found, type_="other").count() == 0


def test_roles(spark):
    edges = spark.createDataFrame([("handoff", "a", "b"), ("route", "a", "c"), ("route", "c", "b")], "type string, src string, dst string")
    agents = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    assert {r.node: r.role for r in G.roles(agents, edges).collect()} == {"a": "supervisor", "b": "worker", "c": "router", "d": "solo"}


def chain_by_hand(rows):
    previous, out = L.GENESIS, []
    for seq, fields in enumerate(rows, 1):
        digest = hashlib.sha256("|".join([str(seq), *("None" if f is None else f for f in fields), previous]).encode()).hexdigest()
        out.append((seq, previous, digest))
        previous = digest
    return out


def test_ledger(spark):
    rows = [("b", i, f"x{i}", None if i == 3 else "y") for i in range(1, 6)]
    entries = spark.createDataFrame(rows, "bundle string, at int, x string, y string")
    ledger = L.hash_chain(entries, "bundle", ["at"], ["x", "y"])
    assert [(r.seq, r.prev_hash, r.entry_hash) for r in ledger.orderBy("seq").collect()] == chain_by_hand([r[2:] for r in rows])
    good = L.verify(ledger, "bundle", ["x", "y"]).first()
    assert (good.entries, good.ok, good.first_bad_seq) == (5, True, None)
    edited = L.verify(ledger.withColumn("x", F.when(F.col("seq") == 2, "no").otherwise(F.col("x"))), "bundle", ["x", "y"]).first()
    assert (edited.ok, edited.first_bad_seq) == (False, 2) and edited.tip_hash == chain_by_hand([r[2:] for r in rows])[0][2]
    deleted = L.verify(ledger.where("seq <> 3"), "bundle", ["x", "y"]).first()
    assert (deleted.ok, deleted.first_bad_seq) == (False, 4)
    more = L.append(ledger, spark.createDataFrame([("b", 6, "z", "z"), ("c", 1, "n", "n")], entries.schema), "bundle", ["at"], ["x", "y"])
    whole = L.verify(ledger.unionByName(more), "bundle", ["x", "y"])
    assert {(r.bundle, r.entries, r.ok) for r in whole.collect()} == {("b", 6, True), ("c", 1, True)}


def test_segments(spark):
    entries = spark.createDataFrame([("b", i) for i in range(7)], "bundle string, at int")
    ledger = L.hash_chain(entries, "bundle", ["at"], ["at"], segment=3)
    assert ledger.where(F.col("prev_hash") == L.GENESIS).count() == 3
    assert L.verify(ledger, "bundle", ["at"], segment=3).first().ok


def test_long_chains_are_whole(spark):
    rows = [("a", i, f"x{i}") for i in range(3500)] + [("b", i, f"y{i}") for i in range(40)] + [(None, 1, "z")]
    entries = spark.createDataFrame(rows, "bundle string, at int, x string")
    ledger = L.hash_chain(entries, "bundle", ["at"], ["x"]).cache()
    for bundle in ("a", "b", None):
        found = ledger.where(F.col("bundle").eqNullSafe(F.lit(bundle))).orderBy("seq").collect()
        assert [(r.seq, r.prev_hash, r.entry_hash) for r in found] == chain_by_hand([r[2:] for r in rows if r[0] == bundle])
    assert {(r.bundle, r.entries, r.ok) for r in L.verify(ledger, "bundle", ["x"]).collect()} == {("a", 3500, True), ("b", 40, True), (None, 1, True)}
    # The first 1000 entries rewritten and hashed again are noticed by the entry after them.
    first = L.hash_chain(entries.where("bundle = 'a' and at < 1000").withColumn("x", F.lit("no")), "bundle", ["at"], ["x"])
    forged = L.verify(first.unionByName(ledger.where("bundle = 'a' and seq > 1000")), "bundle", ["x"]).first()
    assert (forged.ok, forged.first_bad_seq) == (False, 1001)
    more = L.append(ledger.where("seq <= 1500"), entries.where("at >= 1500"), "bundle", ["at"], ["x"])
    whole = ledger.where("bundle = 'a'").orderBy("seq").collect()
    assert sorted((r.seq, r.prev_hash, r.entry_hash) for r in more.collect()) == [(r.seq, r.prev_hash, r.entry_hash) for r in whole[1500:]]


def test_hot_customer_equals_sql(spark, tmp_path):
    import duckdb

    from tarnwell.plans import driver

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumn("o_custkey", F.when(F.col("o_orderkey") % 25 == 0, F.col("o_custkey")).otherwise(F.lit(7)).cast("long"))
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert con.sql("SELECT max(n) FROM (SELECT count(*) n FROM orders GROUP BY o_custkey)").fetchall()[0][0] > 1000
    for name in ("hash_chain", "verify_chain"):
        found = driver.QUERIES[name](spark, str(tmp_path))
        wanted = con.sql(driver.ORACLE_SQL[name])
        assert sorted(map(str, (tuple(r) for r in found.select(*wanted.columns).collect()))) == sorted(map(str, wanted.fetchall()))


def test_upsert_diff_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    assert {tuple(r) for r in R.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, None)}
    assert {tuple(r) for r in R.set_diff(old, new).collect()} == {(1, "a", "removed"), (2, "b", "removed"), (2, "c", "added"), (3, None, "added")}
    assert [tuple(r) for r in R.changes(old, new, "k", ["v"]).collect()] == [(2, 1, "v", "b", "c")]
    assert {tuple(r) for r in R.unattested(old.select("k"), new, "k", "v", "c").collect()} == {(1, None)}
    counts = R.counts_of(old, new, ["k"]).first()
    assert (counts.tp, counts.fp, counts.fn) == (1, 1, 1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, v string")
    assert R.upsert(none, none, ["k"]).count() == 0
    assert G.reached(spark.createDataFrame([], "node long"), spark.createDataFrame([], "src long, dst long")).count() == 0
    assert L.hash_chain(spark.createDataFrame([], "bundle string, at int"), "bundle", ["at"], ["at"]).count() == 0
