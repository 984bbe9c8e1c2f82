import json

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import derive as D
from tarnwell.operators import ledger as L
from tarnwell.plans import estate
from tarnwell.sources import outputs, records, settings, store, trees
from tarnwell.streaming import feeds


def record(bundle, verdict, **more):
    return {"bundle_id": bundle, "name": bundle, "ai_verdict": verdict, "scanned_commit": "c1", "inventory_provenance": {"scanned_at": "2026-01-01T00:00:00Z", "scanner": "1"}, **more}


AGENT = {
    "agent_id": "a1", "location": "production", "tools": ["t1", "t2"], "is_entrypoint": True, "model": {"value": "m-1", "endpoint": {"unresolved": "x"}, "api_style": "chat"}, "detection": {"method": "Bespoke loop", "confidence": "high"},
    "autonomy_level": {"value": "autonomous"}, "capability_flags": {"value": {"moves_money": True}}, "reachable_tools": {"value": ["t1", "t2", "t3"]},
}
RECORDS = [
    record("full", "ai_detected", agents=[AGENT, {"agent_id": "a2"}], tools=[{"tool_id": "t1", "side_effects": ["Admin_Mutation", "read"]}, {"tool_id": "t2", "side_effects": ["read"]}],
           findings=[{"kind": "unapproved_gateway", "severity": "high", "subject_ref": "a1", "detail": "d"}, {"kind": "x", "severity": "low"}], model_usages=[{"model": {"value": ["m", 1]}, "evidence": ["f:1"], "task": "chat"}],
           derived={"models_used": {"value": [{"model": "m-1", "display": "M", "task": "chat", "provider_class": "vendor_external"}]}, "has_dynamic_prompts": {"value": True}, "has_unapproved_endpoint": {"value": True}, "capability_flags": {"value": {"executes_code": True}}}),
    record("signals", "ai_signals_only"), record("clean", "no_ai", agents=[]),
]


@pytest.fixture
def tables(spark):
    rows = spark.createDataFrame([(str(i), json.dumps(r)) for i, r in enumerate(RECORDS)] + [("bad", "no json"), ("list", "[1]")], "path string, value string")
    return estate.flatten(records.from_json(rows))


def test_flatten(tables):
    assert {n: t.count() for n, t in tables.items()} == {"systems": 3, "agents": 2, "agent_tools": 2, "tools": 2, "models": 1, "findings": 2, "mcp_servers": 0, "model_usages": 1}
    first = tables["agents"].where("agent_id = 'a1'").first()
    assert (first.model_value, first.model_endpoint, first.tool_count, first.reachable_tool_count, first.moves_money, first.sends_external) == ("m-1", '{"unresolved":"x"}', 2, 3, True, False)
    assert tables["findings"].where("severity = 'high'").first().finding_id.endswith("-0000")


def test_named_queries(spark, tables):
    found = {name: [tuple(r) for r in estate.named_query(spark, tables, name).collect()] for name in estate.NAMED}
    assert found == {
        "agents_move_money": [("full", "a1", "m-1", '{"unresolved":"x"}')], "models_by_provider_class": [("vendor_external", "m-1", None, 1)], "systems_unapproved_endpoint": [("full", "full", "ai_detected")],
        "agent_kinds_by_repo": [("full", 1, 0)], "admin_tools_without_approval": [("full", "t1")], "dynamic_prompt_high_privilege": [("full", "full")], "dormant_ai_repos": [("signals", "signals")], "high_findings": [("full", "unapproved_gateway", "a1", "d")],
    }


def test_rebuild_and_upsert(spark, tmp_path):
    def read(some):
        for i, r in enumerate(some):
            (p := tmp_path / "in" / str(len(some)) / str(i)).mkdir(parents=True)
            (p / "record.json").write_text(json.dumps(r, indent=2))
        return records.read_records(spark, str(tmp_path / "in" / str(len(some))))

    estate.rebuild(read(RECORDS), str(tmp_path / "a"))
    again = dict(RECORDS[0], inventory_provenance={"scanned_at": "later"})
    estate.upserted(spark, str(tmp_path / "a"), read([again]), str(tmp_path / "b"))
    for name in estate.KEYS:
        assert spark.read.parquet(str(tmp_path / "a" / name)).count() == spark.read.parquet(str(tmp_path / "b" / name)).count(), name
    assert spark.read.parquet(str(tmp_path / "b" / "systems")).where("scanned_at = 'later'").count() == 1


def test_records_upserted_in_place(spark, tmp_path):
    """A scan of the same commit replaces its rows in all eight tables in one version; one of another commit adds to them."""

    def read(*some):
        rows = records.from_json(spark.createDataFrame([(str(i), json.dumps(r)) for i, r in enumerate(some)], "path string, value string"))
        return rows.withColumn("scan_id", F.variant_get("record", "$.scanned_commit", "string"))

    kept = store.Store(spark, str(tmp_path), buckets=4)
    estate.upsert_records(kept, read(*RECORDS))
    before = {name: kept.table(name).count() for name in estate.KEYS}
    assert before == {"systems": 3, "agents": 2, "agent_tools": 2, "tools": 2, "models": 1, "findings": 2, "mcp_servers": 0, "model_usages": 1}
    fewer = dict(RECORDS[0], agents=[AGENT], findings=[])
    assert [estate.upsert_records(kept, read(fewer)), estate.upsert_records(kept, read(fewer))] == [2, 3]
    after = {name: kept.table(name).count() for name in estate.KEYS}
    assert after == before | {"agents": 1, "findings": 0}
    later = dict(fewer, scanned_commit="c2", inventory_provenance={"scanned_at": "2026-02-01T00:00:00Z"})
    estate.upsert_records(kept, read(later))
    assert kept.table("systems").count() == 4 and kept.table("agents").count() == 2 and kept.table("agents", 1).count() == 2
    found = {name: [tuple(r) for r in estate.named_query(spark, {n: kept.table(n) for n in estate.KEYS}, name).collect()] for name in ("agents_move_money", "high_findings")}
    assert len(found["agents_move_money"]) == 2 and found["high_findings"] == []


FILES = {
    "requirements.txt": "OpenAI==1.2.3\nrequests==2.0 # x\nopenai==1.3\nlangchain-community==0.2\n", "src/app.py": "import openai\nkey = 'x'\n", "src/.hidden/a.py": "x", "node_modules/x.js": "import openai", "web/a.d.ts": "x",
    "web/a.ts": "fetch('/v1/messages')", "web/b.ts": "import x from '@openai/agents'\n", "config/.env": "export LLM_MODEL='m-1' \n# no\nNAME=a b # c\nKEY=sk-" + "a" * 30 + "\n", "tests/test_a.py": "pass",
    "src/lc.py": "from langchain_openai import ChatOpenAI\n", "src/gg.py": "  import google.genai as g\n", "src/none.py": "import openaix\n", "src/post.py": "requests.post(u, json={'model': 'm', 'messages': []})", "src/far.py": "requests.post\n'model'" + " " * 400 + "'messages'",
    "src/host.py": "u = 'https://api.openai.com/v1/chat/completions'", "src/wrap.py": "import corp_llm.client\n", "src/gate.py": "x = 'llm.corp.example'", "package.json": json.dumps({"name": "root", "dependencies": {"ai": "1", "left-pad": "1"}, "devDependencies": {"@langchain/core": "2"}}),
    "packages/ui/package.json": json.dumps({"name": "@org/ui"}), "prompts/agents/billing-bot/system.md": "---\nname: 'billing'\nmodel: m-1\n---\nYou bill.", "prompts/agents/empty/readme.md": "x", "skills/SKILL.md": "x",
    "poetry.lock": '[[package]]\nname = "Requests"\nversion = "2.9"\n\n[[package]]\nname = "x.y"\nversion = "1"\n', "package-lock.json": json.dumps({"packages": {"": {}, "node_modules/ai": {"version": "1.1"}, "node_modules/a/node_modules/b": {"version": "3"}}}),
    "pnpm-lock.yaml": "packages:\n  '@scope/p@1.2.3':\n  /ai@9.9.9:\n  q@0.1.0(react@1):\n", "tsconfig.json": '{ // paths\n "compilerOptions": {"baseUrl": "./web", "paths": {"@app/*": ["./lib/*"], "none": []}}}',
    "docker-compose.yml": "services:\n  a:\n    environment:\n      MODEL: m-2\n      TOKEN: ghp_" + "b" * 24 + "\n    ports: [1]\n  b:\n    environment:\n      - HOST=h:1\n      - EMPTY\n", "k8s/d.yaml": "env:\n  - name: TEMP\n    value: \"0.1\"\n  - name: FROM\n    valueFrom: x\nother: 1\n", "deploy.yaml": "env:\n  - name: NOT\n    value: a\n",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return trees.read_tree(spark, str(root)).cache()


def test_trees(tree):
    assert {r.path for r in tree.collect()} == set(FILES) - {"node_modules/x.js"}
    assert {r.path for r in trees.analysable(tree.where("path LIKE 'web/%' OR path LIKE 'tests/%'")).collect()} == {"web/a.ts", "web/b.ts", "tests/test_a.py"}
    assert {(r.ext, r.n_files) for r in trees.census(tree).collect()} >= {("ts", 3)}


def test_triage(tree, spark):
    found = {(r.signal, r.evidence) for r in trees.triage(tree, gateways=["llm.corp.example"], wrappers=["corp_llm"]).collect()}
    assert found == {
        ("manifest_ai_package", "requirements.txt:langchain"), ("manifest_ai_package_js", "package.json:ai"), ("manifest_ai_package_js", "package.json:@langchain/core"),
        ("prompt_artefact", "prompts/agents/billing-bot/system.md"), ("prompt_artefact", "prompts/agents/empty/readme.md"), ("prompt_artefact", "skills/SKILL.md"), ("sdk_import", "src/app.py:openai"), ("sdk_import", "src/lc.py:langchain_openai"),
        ("sdk_import", "src/gg.py:google.genai"), ("sdk_import", "web/b.ts:@openai/agents"), ("org_wrapper_import", "src/wrap.py:corp_llm"), ("llm_host", "src/host.py:api.openai.com"), ("llm_host", "src/gate.py:llm.corp.example"),
        ("chat_path_fragment", "src/host.py:/chat/completions"), ("chat_path_fragment", "web/a.ts:/v1/messages"), ("model_near_messages", "src/post.py"),
        ("manifest_ai_package", "requirements.txt:openai"),
    }
    many = spark.createDataFrame([(f"p{i:02d}.py", "import openai\n", "py") for i in range(30)], "path string, text string, ext string")
    assert [r.evidence for r in trees.triage(many).orderBy("evidence").collect()] == [f"p{i:02d}.py:openai" for i in range(10)]
    assert trees.triage(many.where("false")).count() == 0


def test_versions_and_environment(tree):
    assert {(r.package, r.version) for r in trees.declared_versions(tree).collect()} == {("openai", "1.3"), ("requests", "2.9"), ("langchain_community", "0.2"), ("x_y", "1")}
    assert {(r.package, r.version) for r in trees.npm_versions(tree).collect()} == {("ai", "1.1"), ("a/node_modules/b", "3"), ("@scope/p", "1.2.3"), ("q", "0.1.0")}
    assert [tuple(r) for r in trees.script_aliases(tree).collect()] == [("@app", "web/lib")] and [tuple(r) for r in trees.workspaces(tree).collect()] == [("@org/ui", "packages/ui")]
    found = {(r.key, r.value, r.form) for r in trees.environment_defaults(tree).collect()}
    assert found == {("LLM_MODEL", "m-1", "pinned"), ("NAME", "a b", "pinned"), ("KEY", "[redacted]", "pinned"), ("MODEL", "m-2", "pinned"), ("TOKEN", "[redacted]", "pinned"), ("HOST", "h:1", "pinned"), ("TEMP", "0.1", "pinned")}


def test_configs_and_rosters(tree):
    assert {(r["rule"], r.path) for r in trees.matched_configs(tree, {"packages": "**/package.json", "top": "*.lock", "skill": "skills/*.md"}).collect()} == {("packages", "package.json"), ("packages", "packages/ui/package.json"), ("top", "poetry.lock"), ("skill", "skills/SKILL.md")}
    assert [(r.name, r.prompts) for r in trees.declared_agents(tree).collect()] == [("billing-bot", ["prompts/agents/billing-bot/system.md"])]
    matter = tree.where("path LIKE '%system.md'").select(trees.front_matter(F.col("text")).alias("m")).first().m
    assert matter == {"name": "billing", "model": "m-1"} and tree.where("path = 'tests/test_a.py'").select(trees.front_matter(F.col("text")).alias("m")).first().m is None


def test_changed_paths(tree, spark, tmp_path):
    changed = trees.changed_paths(tree, tree.where("path <> 'config/.env'"))
    assert [tuple(r) for r in changed.collect()] == [("config/.env", "removed")]
    for name, end in (("a", "1"), ("b", "2")):  # beyond the size that is read as text
        (tmp_path / name).mkdir()
        (tmp_path / name / "big.py").write_text("x" * 1_200_000 + end)
    a, b = (trees.read_tree(spark, str(tmp_path / n)) for n in "ab")
    assert [tuple(r) for r in trees.changed_paths(a, b).collect()] == [("big.py", "changed")] and trees.changed_paths(a, a).count() == 0


def test_outputs(spark, tmp_path):
    facts = spark.createDataFrame([("b", 2, None), ("a", 1, ["y", "x"]), ("b", 2, None)], "name string, id int, marks array<string>")
    assert [r.line for r in outputs.fact_lines(facts).collect()] == ['{"id":1,"marks":["y","x"],"name":"a"}', '{"id":2,"marks":null,"name":"b"}']
    row = F.struct(F.lit(1).alias("b"), F.struct(F.lit("é").alias("z"), F.lit(None).cast("string").alias("y")).alias("a"))
    assert spark.range(1).select(outputs.canonical_line(row).alias("l"), outputs.canonical_json(row).alias("j")).first() == ('{"a":{"y":null,"z":"é"},"b":1}', '{\n  "a": {\n    "y": null,\n    "z": "é"\n  },\n  "b": 1\n}\n')
    outputs.write_artifacts(str(tmp_path / "out"), facts, facts.limit(1), facts.where("false"))
    shapes = {n: facts.schema for n in ("facts", "findings", "marks")}
    back = outputs.read_artifacts(spark, str(tmp_path / "out"), shapes)
    assert sorted(map(str, back["facts"].collect())) == sorted(map(str, facts.distinct().collect())) and back["marks"].count() == 0
    (tmp_path / "out" / "findings" / "part-bad.txt").write_text("{broken")
    assert outputs.read_artifacts(spark, str(tmp_path / "out"), shapes) is None and outputs.read_artifacts(spark, str(tmp_path / "none"), shapes) is None
    scans = spark.createDataFrame([("x", "abcdef0123", 1), ("y", "abcdef0123", 2)], "bundle_id string, commit string, v int")
    outputs.store_scans(scans, str(tmp_path / "store"), F.col("commit"))
    outputs.store_scans(scans.where("bundle_id = 'x'").withColumn("v", F.lit(3)), str(tmp_path / "store"), F.col("commit"))
    assert [outputs.stored_scan(spark, str(tmp_path / "store"), b, "abcdef01").first().v for b in "xy"] == [3, 2]
    nodes, edges = spark.createDataFrame([("g", "n2"), ("g", "n1")], "bundle_id string, id string"), spark.createDataFrame([("g", "n1", "n2")], "bundle_id string, src string, dst string")
    assert [r.line for r in outputs.graph_lines(nodes, edges).collect()] == ['{"id":"n1"}', '{"id":"n2"}', '{"dst":"n2","src":"n1"}']


def test_repo_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# all\nhttps://h/a/b  # one\n\n./c\n")
    assert [r.target for r in records.read_repo_list(spark, str(tmp_path / "list.txt")).collect()] == ["https://h/a/b", "./c"]


def test_streams(spark, tmp_path):
    from tarnwell.operators.ledger import hash_chain

    ledger = hash_chain(spark.createDataFrame([("b", i) for i in range(5)], "bundle string, at int"), "bundle", ["at"], ["at"])
    ledger.selectExpr("bundle", "if(seq = 4, 99, at) at", "seq", "prev_hash", "entry_hash").write.parquet(str(tmp_path / "ledger"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "ledger")).schema).parquet(str(tmp_path / "ledger"))
    feeds.append_to(feeds.broken_entries(stream, ["at"]), str(tmp_path / "out"), str(tmp_path / "check")).start().awaitTermination()
    assert [r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [4]
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events.parquet*")
    query = feeds.event_rates(events).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM rates").first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_settings(spark, tmp_path):
    (tmp_path / "org.yaml").write_text("# ours\ngateway_hosts:\n  - llm.corp.example\n  - 'b.example' # old\nknown_wrapper_packages:\n  - fqname: corp_llm.client\n    note: x\nsensitive_hosts: []\n")
    pack = settings.read_org_pack(spark, str(tmp_path / "org.yaml"))
    assert settings.members(pack, "gateway_hosts") == ["b.example", "llm.corp.example"] and settings.members(pack, "known_wrapper_packages") == ["corp_llm.client"] and settings.members(pack, "sensitive_hosts") == []
    with pytest.raises(ValueError):
        settings.members(pack, "gateway_hosts", most=1)
    assert settings.Settings.from_environment({"TARNWELL_HOPS": "7"}).hops == 7 and settings.Settings.from_environment({}).most_files == 100_000


def test_bill_of_packages(tree, spark):
    """Declared packages with their versions and whether they are imported; wrappers that are imported but not declared."""
    found = trees.signals(tree)
    imported = spark.createDataFrame([("openai",), ("corp_llm",), ("ai",), ("other",)], "root string")
    wrappers = spark.createDataFrame([("corp_llm.client",), ("openai.Client",), ("unused_wrapper",)], "fqname string")
    rows = D.ai_bill(found, trees.declared_versions(tree), imported, wrappers, trees.npm_versions(tree))
    assert sorted(map(tuple, rows.collect())) == [
        ("@langchain/core", None, "package.json", False, "npm", 1), ("ai", "1.1", "package.json", True, "npm", 1), ("corp_llm", None, None, True, "pypi", 0),
        ("langchain", None, "requirements.txt", False, "pypi", 1), ("openai", "1.3", "requirements.txt", True, "pypi", 1),
    ]


def test_tip_over_all_bundles(spark):
    rows = L.hash_chain(spark.range(40).selectExpr("id % 5 AS bundle", "id", "concat('v', id) AS v"), "bundle", ["id"], ["v"])
    tip = L.ledger_tip(rows, "bundle")
    assert tip == L.ledger_tip(rows.orderBy("v").repartition(7), "bundle") != L.ledger_tip(rows.where("NOT (bundle = 3 AND seq = 8)"), "bundle")
