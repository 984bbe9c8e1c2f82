"""Derivation, bills of materials, named queries, module graph and incremental scans on the driver's tables, with the SQL that each query equals.

The star schema is read as an estate: nations are bundles, every third customer is an agent, the suppliers of its orders are its tools, brands are tool servers, every tenth
order is a call outside or inside an agent.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import displays as S
from ..operators import derive as D
from ..operators import digests as X
from ..operators import graph as G
from ..operators import incremental as I
from ..operators import intervals as V
from ..operators import ledger as L
from ..operators import modules as M
from ..operators import relational as R
from ..session import shared_folder, stored, table
from ..sources.store import Store
from ..streaming import ledger_stream as T
from ..streaming.rescan import Rescan
from .driver import LEDGER_FIELDS, ORACLE_SQL, chained_orders, query
from .estate import NAMED, named_query

GATEWAYS, PAYMENT, SENSITIVE = ("llm.corp.example",), ("pay.example",), ("hr.example",)
_ENDPOINT = (
    "CASE CAST({key} AS INT) % 7 WHEN 0 THEN NULL WHEN 1 THEN 'https://api.openai.com/v1' WHEN 2 THEN 'https://llm.corp.example/v1' WHEN 3 THEN 'http://10.0.0.8:8000/v1' "
    "WHEN 4 THEN 'https://rogue.example/v1' ELSE 'https://eu.openai.azure.com/openai' END"
)
_AGENT = (
    "c_nationkey AS bundle_id, c_custkey AS agent_id, CASE CAST(c_custkey AS INT) % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'example' ELSE 'production' END AS location, "
    "CASE WHEN c_custkey % 4 = 0 THEN 'typescript' ELSE 'python' END AS language, " + _ENDPOINT.format(key="c_custkey") + " AS endpoint, c_custkey % 11 = 0 AS unresolved, c_custkey % 4 = 1 AS dynamic, "
    "CASE WHEN c_custkey % 2 = 0 THEN 'bespoke_shape' ELSE 'framework_rule' END AS method"
)
_USAGE = (
    "c_nationkey AS bundle_id, o_orderkey AS usage_id, " + _ENDPOINT.format(key="o_orderkey") + " AS endpoint, CASE WHEN o_orderkey % 3 = 0 THEN 'embedding' ELSE 'chat' END AS task, "
    "o_orderstatus = 'F' AS in_agent, o_orderkey % 13 = 0 AS unresolved"
)
_TARGET = "CASE CAST(s_suppkey AS INT) % 4 WHEN 0 THEN 'pay.example' WHEN 1 THEN 'hr.example' WHEN 2 THEN 'mail.example' END"
_PLACE = "CASE CAST(s_suppkey AS INT) % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'example' ELSE 'production' END"
_CALL_PROOF = "CASE WHEN o_orderkey % 8 = 0 THEN 'jobs/u' ELSE 'app/u' END"


def facts(spark, sf_dir):
    """The star schema as facts of an inventory."""
    customers, orders, lines = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    proof = lambda prefix, key, line: F.array(F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(line)))
    agents = spark.sql(f"SELECT {_AGENT} FROM {{c}} WHERE c_custkey % 3 = 0", c=customers).withColumns({
        "evidence": proof("src/a", "agent_id", ".py:7"), "prompt_evidence": F.when(F.col("agent_id") % 2 == 0, proof("prompts/p", "agent_id", ".md:1")).otherwise(F.array().cast("array<string>")),
    })
    bought = lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    held = bought.join(agents.select("bundle_id", "agent_id"), F.col("o_custkey") == F.col("agent_id"))
    agent_tools = held.select("bundle_id", "agent_id", F.col("l_suppkey").alias("tool_id")).distinct()
    suppliers = table(spark, sf_dir, "supplier")
    effects = F.array_compact(F.array(F.when(F.col("s_suppkey") % 2 == 0, "external_send"), F.when(F.col("s_suppkey") % 3 == 0, "read"), F.when(F.col("s_suppkey") % 50 == 7, "code_exec"), F.when(F.col("s_suppkey") % 70 == 11, "admin_mutation")))
    kinds = suppliers.select(F.col("s_suppkey").alias("tool_id"), effects.alias("side_effects"), F.expr(_TARGET).alias("external_target"), F.expr(_PLACE).alias("location"), proof("tools/t", "s_suppkey", ".py:3").alias("evidence"))
    tools = agent_tools.select("bundle_id", "tool_id").distinct().join(kinds, "tool_id")
    branded = held.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    servers = branded.select("bundle_id", F.col("p_brand").alias("server_id")).distinct()
    number = F.regexp_extract("server_id", "[0-9]+", 0).cast("int")
    servers = servers.withColumns({
        "transport": F.when(number % 3 == 0, "stdio").otherwise("http"), "server": F.when(number % 2 == 0, "http://10.1.2.3/mcp").otherwise("https://tools.example/mcp"), "approval_policy": F.when(number % 5 == 0, "always"),
        "evidence": F.array(F.concat(F.lit("mcp/"), F.col("server_id"), F.lit(".json:1"))),
    })
    agent_servers = branded.where("l_linenumber = 7 AND l_returnflag = 'A'").select("bundle_id", "agent_id", F.col("p_brand").alias("server_id")).distinct()
    calls = orders.where("o_orderkey % 10 = 1").join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    usages = spark.sql(f"SELECT {_USAGE}, o_orderkey FROM {{o}}", o=calls).withColumn("evidence", F.array(F.concat(F.expr(_CALL_PROOF), F.col("o_orderkey").cast("string"), F.lit(".py:5")))).drop("o_orderkey")
    return {
        "agents": agents, "tools": tools, "agent_tools": agent_tools, "policies": agents.where("agent_id % 9 = 0").select("bundle_id", "agent_id", F.lit("approval").alias("kind"), proof("policy/", "agent_id", ".py:2").alias("evidence")),
        "servers": servers, "agent_servers": agent_servers, "usages": usages, "state": agents.where("agent_id % 40 = 9").select("bundle_id", "agent_id", F.lit("vectorstore").alias("kind")),
        "census": orders.join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("bundle_id"), F.expr("CASE left(o_orderpriority, 1) WHEN '1' THEN 'go' WHEN '2' THEN 'rs' WHEN '3' THEN 'py' ELSE 'ts' END").alias("ext")).agg(F.count("*").alias("n_files")),
        "triage": table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("bundle_id"), F.lit("sdk_import").alias("signal")),
    }


def derived(spark, sf_dir):
    return D.derive({name: stored(rows, f"facts-{name}") for name, rows in facts(spark, sf_dir).items()}, gateways=GATEWAYS, payment=PAYMENT, sensitive=SENSITIVE)


_HOST = "lower(regexp_extract(endpoint, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1))"
FACTS_SQL = f"""
agents AS (SELECT {_AGENT}, 'src/a' || c_custkey || '.py:7' AS proof, CASE WHEN c_custkey % 2 = 0 THEN 'prompts/p' || c_custkey || '.md:1' ELSE 'src/a' || c_custkey || '.py:7' END AS prompt_proof FROM customer WHERE c_custkey % 3 = 0),
held AS (SELECT bundle_id, agent_id, l_suppkey, l_partkey, l_linenumber, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN agents ON o_custkey = agent_id),
agent_tools AS (SELECT DISTINCT bundle_id, agent_id, l_suppkey AS tool_id FROM held),
tools AS (SELECT bundle_id, tool_id, {_TARGET} AS external_target, {_PLACE} AS location, s_suppkey % 2 = 0 AS sends, s_suppkey % 3 = 0 AS reads, s_suppkey % 50 = 7 AS runs, s_suppkey % 70 = 11 AS administers, 'tools/t' || s_suppkey || '.py:3' AS proof
          FROM (SELECT DISTINCT bundle_id, tool_id FROM agent_tools) JOIN supplier ON s_suppkey = tool_id),
branded AS (SELECT held.*, p_brand FROM held JOIN part ON l_partkey = p_partkey),
agent_servers AS (SELECT DISTINCT bundle_id, agent_id, p_brand AS server_id FROM branded WHERE l_linenumber = 7 AND l_returnflag = 'A'),
servers AS (SELECT s.bundle_id, s.server_id, CASE WHEN n % 3 = 0 THEN 'low' WHEN n % 2 = 0 THEN 'medium' ELSE 'high' END AS transport_risk, n % 5 = 0 AS approval_required, coalesce(k, 0) AS attached_agent_count
            FROM (SELECT DISTINCT bundle_id, p_brand AS server_id, CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS n FROM branded) s
            LEFT JOIN (SELECT bundle_id, server_id, count(*) AS k FROM agent_servers GROUP BY ALL) a ON a.bundle_id = s.bundle_id AND a.server_id = s.server_id),
usages AS (SELECT {_USAGE}, {_CALL_PROOF} || o_orderkey || '.py:5' AS proof FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 = 1),
census AS (SELECT c_nationkey AS bundle_id, CASE left(o_orderpriority, 1) WHEN '1' THEN 'go' WHEN '2' THEN 'rs' WHEN '3' THEN 'py' ELSE 'ts' END AS ext, count(*) AS n_files FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
flags AS (SELECT a.bundle_id, a.agent_id, coalesce(bool_or(sends AND external_target = 'pay.example'), false) AS moves_money, coalesce(bool_or(runs), false) AS executes_code, coalesce(bool_or(administers), false) AS mutates_identities,
                 coalesce(bool_or(sends), false) AS sends_external, coalesce(bool_or(reads AND external_target = 'hr.example'), false) AS reads_sensitive,
                 coalesce(string_agg(DISTINCT t.proof, ',' ORDER BY t.proof) FILTER (WHERE sends OR runs OR administers OR (reads AND external_target = 'hr.example')), '') AS flag_evidence
          FROM agents a LEFT JOIN agent_tools b ON a.bundle_id = b.bundle_id AND a.agent_id = b.agent_id LEFT JOIN tools t ON b.bundle_id = t.bundle_id AND b.tool_id = t.tool_id GROUP BY ALL),
autonomy AS (SELECT bundle_id, agent_id, CASE WHEN agent_id % 9 = 0 THEN 'approval_gated' ELSE 'autonomous' END AS autonomy, CASE WHEN agent_id % 9 = 0 THEN 'policy/' || agent_id || '.py:2' ELSE proof END AS evidence FROM agents),
profile AS (SELECT a.bundle_id, CASE WHEN bool_or(autonomy = 'approval_gated') FILTER (WHERE location = 'production') THEN 'approval_gated' WHEN count(*) FILTER (WHERE location = 'production') > 0 THEN 'autonomous' END AS autonomy_profile
            FROM agents a JOIN autonomy u ON a.bundle_id = u.bundle_id AND a.agent_id = u.agent_id GROUP BY a.bundle_id)
"""
_OUTSIDE = f"(coalesce({_HOST}, '') NOT IN ('', 'api.openai.com', 'llm.corp.example') AND coalesce({_HOST}, '') NOT LIKE '%.openai.azure.com')"


@query(f"WITH {FACTS_SQL} SELECT bundle_id, tool_id, coalesce(external_target = 'hr.example', false) OR runs OR administers AS is_sensitive FROM tools")
def tool_sensitivity(spark, sf_dir):
    return D.tool_sensitivity(facts(spark, sf_dir)["tools"], SENSITIVE).select("bundle_id", "tool_id", "is_sensitive")


@query(f"WITH {FACTS_SQL} SELECT * FROM servers")
def server_attachments(spark, sf_dir):
    f = facts(spark, sf_dir)
    return D.attached_servers(f["servers"], f["agent_servers"]).select("bundle_id", "server_id", "transport_risk", "approval_required", "attached_agent_count")


@query(f"WITH {FACTS_SQL} SELECT * FROM autonomy")
def agent_autonomy(spark, sf_dir):
    f = facts(spark, sf_dir)
    return D.autonomy(f["agents"], f["policies"]).withColumn("evidence", F.array_join("evidence", ","))


@query(f"WITH {FACTS_SQL} SELECT * FROM profile")
def autonomy_profile(spark, sf_dir):
    f = facts(spark, sf_dir)
    return D.autonomy_profile(f["agents"], D.autonomy(f["agents"], f["policies"]))


@query(f"WITH {FACTS_SQL} SELECT bundle_id, usage_id, endpoint, {_OUTSIDE} AS unapproved FROM usages")
def unapproved_endpoints(spark, sf_dir):
    return facts(spark, sf_dir)["usages"].select("bundle_id", "usage_id", "endpoint", D.is_unapproved(F.col("endpoint"), GATEWAYS).alias("unapproved"))


@query(f"WITH {FACTS_SQL} SELECT * FROM flags")
def agent_flags(spark, sf_dir):
    f = facts(spark, sf_dir)
    return D.agent_flags(f["agents"], f["agent_tools"], f["tools"], PAYMENT, SENSITIVE).withColumn("flag_evidence", F.array_join("flag_evidence", ","))


_SYSTEM_FLAGS = """
estate AS (SELECT f.* FROM flags f JOIN agents a ON a.bundle_id = f.bundle_id AND a.agent_id = f.agent_id WHERE location <> 'test'),
firsts AS (""" + " UNION ALL ".join(f"SELECT bundle_id, arg_min(flag_evidence, agent_id) AS e FROM estate WHERE {f} GROUP BY bundle_id" for f in D.FLAGS) + """),
first_evidence AS (SELECT bundle_id, string_agg(DISTINCT p, ',' ORDER BY p) AS e FROM (SELECT bundle_id, unnest(string_split(e, ',')) AS p FROM firsts) GROUP BY bundle_id),
system_flags AS (SELECT b.bundle_id, """ + ", ".join(f"coalesce(bool_or({f}), false) AS {f}" for f in D.FLAGS) + """, coalesce(any_value(e), '') AS flag_evidence
                 FROM (SELECT DISTINCT bundle_id FROM agents) b LEFT JOIN estate s ON s.bundle_id = b.bundle_id LEFT JOIN first_evidence x ON x.bundle_id = b.bundle_id GROUP BY b.bundle_id)
"""


@query(f"WITH {FACTS_SQL}, {_SYSTEM_FLAGS} SELECT * FROM system_flags")
def system_flags(spark, sf_dir):
    out = derived(spark, sf_dir)
    return out["system_flags"].withColumn("flag_evidence", F.array_join("flag_evidence", ","))


_TYPE = """
system_type AS (SELECT coalesce(a.bundle_id, u.bundle_id) AS bundle_id, CASE WHEN n > 0 THEN 'agentic' ELSE 'genai' END AS system_type,
                       concat_ws(',', CASE WHEN n > 1 THEN 'multi-agent' END, CASE WHEN embeds AND s.bundle_id IS NOT NULL THEN 'rag' WHEN embeds THEN 'embeddings' END, CASE WHEN batch THEN 'batch-llm' END) AS components
                FROM (SELECT bundle_id, count(*) AS n FROM agents GROUP BY bundle_id) a
                FULL JOIN (SELECT bundle_id, bool_or(task = 'embedding') AS embeds, bool_or(NOT in_agent AND starts_with(proof, 'jobs/')) AS batch FROM usages GROUP BY bundle_id) u ON a.bundle_id = u.bundle_id
                LEFT JOIN (SELECT DISTINCT bundle_id FROM agents WHERE agent_id % 40 = 9) s ON s.bundle_id = coalesce(a.bundle_id, u.bundle_id))
"""


@query(f"WITH {FACTS_SQL}, {_TYPE} SELECT * FROM system_type")
def system_types(spark, sf_dir):
    f = facts(spark, sf_dir)
    return D.system_type(f["agents"], f["usages"], f["state"]).withColumn("components", F.array_join("components", ","))


@query(
    f"""WITH {FACTS_SQL} SELECT DISTINCT bundle_id, CASE WHEN external_target = 'hr.example' OR runs OR administers THEN 'touches org-flagged sensitive host ' || external_target ELSE 'sends data to ' || external_target END AS signal
FROM tools WHERE external_target IS NOT NULL AND (external_target = 'hr.example' OR runs OR administers OR sends)
UNION SELECT u.bundle_id, CASE WHEN s.bundle_id IS NOT NULL THEN 'indexes documents for semantic search (RAG)' ELSE 'computes embeddings over repository content' END
FROM (SELECT DISTINCT bundle_id FROM usages WHERE task = 'embedding') u LEFT JOIN (SELECT DISTINCT bundle_id FROM agents WHERE agent_id % 40 = 9) s ON s.bundle_id = u.bundle_id"""
)
def data_signals(spark, sf_dir):
    return derived(spark, sf_dir)["signals"]


_EXTERNAL = "(endpoint IS NULL OR endpoint LIKE 'https://api.openai.com/%' OR endpoint LIKE '%.openai.azure.com/%')"
FINDINGS_SQL = f"""
known AS (SELECT a.*, moves_money, executes_code, mutates_identities, sends_external FROM agents a JOIN flags f ON a.bundle_id = f.bundle_id AND a.agent_id = f.agent_id),
findings AS (
SELECT bundle_id, 'unapproved_gateway' AS kind, 'high' AS severity, 'agent:' || agent_id AS subject_ref, 'LLM endpoint host not in approved host list: ' || {_HOST} AS detail, proof AS evidence FROM known WHERE {_OUTSIDE}
UNION ALL SELECT bundle_id, 'high_privilege_agent', 'high', 'agent:' || agent_id,
       'agent capability flags: ' || concat_ws(', ', CASE WHEN executes_code THEN 'executes_code' END, CASE WHEN moves_money THEN 'moves_money' END, CASE WHEN mutates_identities THEN 'mutates_identities' END), proof
       FROM known WHERE (executes_code OR moves_money OR mutates_identities) AND location <> 'test'
UNION ALL SELECT bundle_id, 'unresolved_model', 'medium', 'agent:' || agent_id, 'agent model could not be resolved statically', proof FROM known WHERE unresolved
UNION ALL SELECT bundle_id, 'dynamic_prompt', 'medium', 'agent:' || agent_id, 'dynamic system prompt on an agent with external-send tools', prompt_proof FROM known WHERE dynamic AND (sends_external OR moves_money)
UNION ALL SELECT bundle_id, 'unapproved_gateway', 'high', 'model_usage', 'LLM endpoint host not in approved host list: ' || {_HOST}, proof FROM usages WHERE {_OUTSIDE}
UNION ALL SELECT bundle_id, 'orphan_model_usage', CASE WHEN {_EXTERNAL} THEN 'medium' ELSE 'info' END, 'model_usage', CASE WHEN {_EXTERNAL} THEN 'external LLM call site outside any detected agent' ELSE 'LLM call site outside any detected agent' END, proof
       FROM usages WHERE NOT in_agent AND task <> 'embedding'
UNION ALL SELECT bundle_id, 'unresolved_model', 'medium', 'model_usage', 'call-site model could not be resolved statically', proof FROM usages WHERE unresolved
UNION ALL SELECT bundle_id, 'orphan_mcp_server', 'medium', server_id, 'MCP server declared but attached to no agent (unwired remote tooling)', 'mcp/' || server_id || '.json:1' FROM servers WHERE attached_agent_count = 0
UNION ALL SELECT bundle_id, 'unanalysed_language_code', CASE WHEN bundle_id % 2 = 0 THEN 'medium' ELSE 'info' END, 'system',
       CAST(sum(n_files) AS BIGINT) || ' source files in unsupported languages not analysed: ' || string_agg(n_files || ' .' || ext, ', ' ORDER BY ext), '' FROM census WHERE ext NOT IN ('py', 'ts') GROUP BY bundle_id)
"""


@query(f"WITH {FACTS_SQL}, {FINDINGS_SQL} SELECT * FROM findings")
def derived_findings(spark, sf_dir):
    return derived(spark, sf_dir)["findings"].withColumn("evidence", F.array_join("evidence", ","))


SYSTEMS_SQL = f"""
systems AS (
SELECT a.*, coalesce(tool_count, 0) AS tool_count, coalesce(tools_production, 0) AS tools_production, coalesce(tools_example, 0) AS tools_example, coalesce(tools_test, 0) AS tools_test, coalesce(mcp_count, 0) AS mcp_count,
       {", ".join(D.FLAGS)}, autonomy_profile, coalesce(greatest(agent_outside, call_outside), false) AS has_unapproved_endpoint, coalesce(greatest(agent_unresolved, call_unresolved), false) AS has_unresolved_models, system_type, components
FROM (SELECT bundle_id, count(*) AS agent_count, count(*) FILTER (WHERE method = 'bespoke_shape') AS bespoke_agent_count, count(*) FILTER (WHERE method <> 'bespoke_shape') AS framework_agent_count,
             {", ".join(f"count(*) FILTER (WHERE location = '{x}') AS agents_{x}" for x in D.LOCATIONS)}, {", ".join(f"count(*) FILTER (WHERE language = '{x}') AS agents_{x}" for x in ("python", "typescript", "javascript"))},
             bool_or(dynamic) AS has_dynamic_prompts FROM agents GROUP BY bundle_id) a
LEFT JOIN (SELECT bundle_id AS b, bool_or({_OUTSIDE}) AS agent_outside, bool_or(unresolved) AS agent_unresolved FROM agents GROUP BY bundle_id) o ON o.b = a.bundle_id
LEFT JOIN (SELECT bundle_id AS b, count(*) AS tool_count, {", ".join(f"count(*) FILTER (WHERE location = '{x}') AS tools_{x}" for x in D.LOCATIONS)} FROM tools GROUP BY bundle_id) t ON t.b = a.bundle_id
LEFT JOIN (SELECT bundle_id AS b, count(*) AS mcp_count FROM servers GROUP BY bundle_id) m ON m.b = a.bundle_id
LEFT JOIN (SELECT bundle_id AS b, bool_or({_OUTSIDE}) AS call_outside, bool_or(unresolved) AS call_unresolved FROM usages GROUP BY bundle_id) u ON u.b = a.bundle_id
LEFT JOIN (SELECT bundle_id AS b, {", ".join(D.FLAGS)} FROM system_flags) f ON f.b = a.bundle_id LEFT JOIN (SELECT bundle_id AS b, autonomy_profile FROM profile) p ON p.b = a.bundle_id
LEFT JOIN (SELECT bundle_id AS b, system_type, components FROM system_type) y ON y.b = a.bundle_id)
"""


@query(f"WITH {FACTS_SQL}, {_SYSTEM_FLAGS}, {_TYPE}, {SYSTEMS_SQL} SELECT * FROM systems")
def system_block(spark, sf_dir):
    return derived(spark, sf_dir)["systems"]


@query(
    f"""WITH {FACTS_SQL}, e AS (SELECT bundle_id, 'has_unapproved_endpoint' AS indicator, proof AS evidence FROM agents WHERE {_OUTSIDE} UNION SELECT bundle_id, 'has_unapproved_endpoint', proof FROM usages WHERE {_OUTSIDE}
UNION SELECT bundle_id, 'has_unresolved_models', proof FROM agents WHERE unresolved UNION SELECT bundle_id, 'has_unresolved_models', proof FROM usages WHERE unresolved UNION SELECT bundle_id, 'has_dynamic_prompts', prompt_proof FROM agents WHERE dynamic)
SELECT * FROM e"""
)
def system_evidence(spark, sf_dir):
    f = facts(spark, sf_dir)
    return D.system_evidence(f["agents"], f["usages"], GATEWAYS)


@query(
    f"""WITH {FACTS_SQL}, edges AS (SELECT bundle_id, agent_id, 'tool' AS part, CAST(tool_id AS VARCHAR) AS item FROM agent_tools UNION SELECT bundle_id, agent_id, 'server', server_id FROM agent_servers
UNION SELECT bundle_id, agent_id, 'model', endpoint FROM agents WHERE endpoint IS NOT NULL UNION SELECT bundle_id, agent_id, 'policy', 'approval' FROM agents WHERE agent_id % 9 = 0
UNION SELECT bundle_id, agent_id, 'state', 'vectorstore' FROM agents WHERE agent_id % 40 = 9 UNION SELECT bundle_id, agent_id, 'prompt', 'prompts/p' || agent_id || '.md:1' FROM agents WHERE agent_id % 2 = 0
UNION SELECT a.bundle_id, a.agent_id, 'transfer', CAST(b.agent_id AS VARCHAR) FROM agents a JOIN agents b ON b.bundle_id = a.bundle_id AND b.agent_id <> a.agent_id AND b.agent_id = a.agent_id // 6 * 3)
SELECT bundle_id, agent_id, part, string_agg(item, ',' ORDER BY item) AS items FROM edges GROUP BY ALL"""
)
def agent_bill(spark, sf_dir):
    f = facts(spark, sf_dir)
    of = lambda rows, part, item: rows.select("bundle_id", "agent_id", F.lit(part).alias("part"), item.cast("string").alias("item"))
    edges = of(f["agent_tools"], "tool", F.col("tool_id")).unionByName(of(f["agent_servers"], "server", F.col("server_id"))).unionByName(of(f["agents"].where("endpoint IS NOT NULL"), "model", F.col("endpoint")))
    edges = edges.unionByName(of(f["policies"], "policy", F.col("kind"))).unionByName(of(f["state"], "state", F.col("kind")))
    edges = edges.unionByName(f["agents"].select("bundle_id", "agent_id", F.lit("prompt").alias("part"), F.explode("prompt_evidence").alias("item")))
    to = f["agents"].select("bundle_id", F.col("agent_id").alias("_to"))
    handed = f["agents"].select("bundle_id", "agent_id", (F.floor(F.col("agent_id") / 6) * 3).alias("_to")).where("_to <> agent_id").join(to, ["bundle_id", "_to"])
    edges = edges.unionByName(of(handed, "transfer", F.col("_to")))
    return D.bill_of_materials(edges).withColumn("items", F.array_join("items", ","))


@query(
    f"""WITH {FACTS_SQL} SELECT c_nationkey AS bundle_id, c_custkey AS agent_id, c_name AS name FROM customer WHERE c_custkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM agents WHERE bundle_id = c_nationkey AND agent_id = c_custkey)"""
)
def undetected_agents(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    roster = customers.where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("bundle_id"), F.col("c_custkey").alias("agent_id"), F.col("c_name").alias("name"))
    detected = customers.where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("bundle_id"), F.upper(F.replace("c_name", F.lit("#"), F.lit("-_"))).alias("name"))
    return D.undetected(roster, detected)


@query(
    f"""WITH {FACTS_SQL} SELECT bundle_id, usage_id, CASE WHEN usage_id % 5 = 0 THEN 'cached' WHEN row_number() OVER (PARTITION BY bundle_id, usage_id % 5 = 0 ORDER BY task, proof) <= 20 THEN 'called' ELSE 'over_budget' END AS status FROM usages"""
)
def adjudication_budget(spark, sf_dir):
    rows = facts(spark, sf_dir)["usages"].select("bundle_id", "usage_id", F.col("task").alias("kind"), F.col("evidence")[0].alias("evidence"), (F.col("usage_id") % 5 == 0).alias("cached"))
    return D.budgeted(rows, 20).select("bundle_id", "usage_id", "status")


# The eight named queries over the derived estate.

_ESTATE_SQL = f"""
WITH {FACTS_SQL}, {_SYSTEM_FLAGS}, {_TYPE}, {FINDINGS_SQL}, {SYSTEMS_SQL},
t_agents AS (SELECT a.bundle_id, a.bundle_id AS scan_id, a.agent_id, endpoint AS model_endpoint, CASE WHEN unresolved THEN NULL ELSE 'model-' || (a.agent_id % 7) END AS model_value, moves_money, method AS detection_method, autonomy AS autonomy_level
             FROM agents a JOIN flags f ON a.bundle_id = f.bundle_id AND a.agent_id = f.agent_id JOIN autonomy u ON a.bundle_id = u.bundle_id AND a.agent_id = u.agent_id),
t_models AS (SELECT bundle_id, CASE WHEN {_EXTERNAL} THEN 'vendor_external' WHEN endpoint LIKE '%llm.corp%' THEN 'internal_gateway' WHEN endpoint LIKE 'http://10.%' THEN 'self_hosted' ELSE 'unknown' END AS provider_class, task AS model_value, endpoint FROM usages),
t_systems AS (SELECT s.*, n_name AS name, CASE WHEN agent_count > 20 THEN 'ai_system' ELSE 'ai_signals_only' END AS ai_verdict FROM systems s JOIN nation ON n_nationkey = bundle_id),
t_tools AS (SELECT bundle_id, bundle_id AS scan_id, tool_id, administers FROM tools)
"""
_NAMED_SQL = {
    "agents_move_money": "SELECT bundle_id, agent_id, model_value, model_endpoint FROM t_agents WHERE moves_money",
    "models_by_provider_class": "SELECT provider_class, model_value, endpoint, count(*) AS uses FROM t_models GROUP BY ALL",
    "systems_unapproved_endpoint": "SELECT bundle_id, name, ai_verdict FROM t_systems WHERE has_unapproved_endpoint",
    "agent_kinds_by_repo": "SELECT bundle_id, count(*) FILTER (WHERE detection_method LIKE '%bespoke%') AS bespoke, count(*) FILTER (WHERE detection_method NOT LIKE '%bespoke%') AS framework FROM t_agents GROUP BY bundle_id",
    "admin_tools_without_approval": "SELECT bundle_id, tool_id FROM t_tools t WHERE administers AND NOT EXISTS (SELECT 1 FROM t_agents a WHERE a.bundle_id = t.bundle_id AND a.scan_id = t.scan_id AND autonomy_level = 'approval_gated')",
    "dynamic_prompt_high_privilege": "SELECT bundle_id, name FROM t_systems WHERE has_dynamic_prompts AND (moves_money OR executes_code OR mutates_identities)",
    "dormant_ai_repos": "SELECT bundle_id, name FROM t_systems WHERE ai_verdict = 'ai_signals_only'",
    "high_findings": "SELECT bundle_id, kind, subject_ref, detail FROM findings WHERE severity = 'high'",
}


def estate_tables(spark, sf_dir):
    """The derived facts as the tables that the named queries read."""
    from ..functions.scalars import provider_class

    out = derived(spark, sf_dir)
    agents = out["agents"].join(out["flags"].select("bundle_id", "agent_id", "moves_money"), ["bundle_id", "agent_id"]).join(out["autonomy"].select("bundle_id", "agent_id", F.col("autonomy").alias("autonomy_level")), ["bundle_id", "agent_id"])
    agents = agents.select("bundle_id", F.col("bundle_id").alias("scan_id"), "agent_id", F.col("endpoint").alias("model_endpoint"), F.when(~F.col("unresolved"), F.concat(F.lit("model-"), (F.col("agent_id") % 7).cast("string"))).alias("model_value"), "moves_money", F.col("method").alias("detection_method"), "autonomy_level")
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("bundle_id"), F.col("n_name").alias("name"))
    systems = out["systems"].join(names, "bundle_id").withColumn("ai_verdict", F.when(F.col("agent_count") > 20, "ai_system").otherwise("ai_signals_only"))
    return {
        "agents": agents, "systems": systems, "findings": out["findings"].withColumn("finding_id", F.concat_ws("-", "kind", "subject_ref")),
        "models": out["usages"].select("bundle_id", provider_class(F.col("endpoint"), GATEWAYS).alias("provider_class"), F.col("task").alias("model_value"), "endpoint"),
        "tools": out["tools"].select("bundle_id", F.col("bundle_id").alias("scan_id"), "tool_id", F.array_join("side_effects", ",").alias("side_effects")),
    }


def _register(name: str) -> None:
    def run(spark, sf_dir):
        return named_query(spark, estate_tables(spark, sf_dir), name)

    run.__name__ = f"named_{name}"
    query(f"{_ESTATE_SQL} {_NAMED_SQL[name]}")(run)


for _name in NAMED:
    _register(_name)


# The module graph: parts are files of four repositories, neighbouring lines of an order import each other.

_PATH = (
    "CASE WHEN p_partkey < 80 THEN 'src/pkg' || p_partkey % 20 || '/__init__.py' WHEN p_partkey % 10 = 3 THEN 'web/c' || p_partkey % 20 || '/m' || p_partkey || '/index.ts' "
    "WHEN p_partkey % 10 = 7 THEN 'web/c' || p_partkey % 20 || '/view' || p_partkey || '.tsx' ELSE 'src/pkg' || p_partkey % 20 || '/mod' || p_partkey || '.py' END"
)
_NAME = "CASE WHEN p_partkey < 80 THEN 'pkg' || p_partkey % 20 WHEN p_partkey % 10 = 3 THEN 'web/c' || p_partkey % 20 || '/m' || p_partkey || '/index' WHEN p_partkey % 10 = 7 THEN 'web/c' || p_partkey % 20 || '/view' || p_partkey ELSE 'pkg' || p_partkey % 20 || '.mod' || p_partkey END"
_SCRIPT = "p_partkey >= 80 AND p_partkey % 10 IN (3, 7)"
FILES_SQL = f"""
files AS (SELECT p_partkey, p_partkey % 4 AS bundle_id, {_PATH} AS path, {_NAME} AS module, p_partkey < 80 AS is_package, {_SCRIPT} AS script FROM part),
modules AS (SELECT bundle_id, min(path) AS path, module, bool_or(is_package) AS is_package FROM files GROUP BY bundle_id, module),
near AS (SELECT DISTINCT a, b, kind FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b, l_linenumber % 3 AS kind FROM lineitem) WHERE b IS NOT NULL AND a <> b),
imports AS (SELECT DISTINCT x.bundle_id, x.module AS importer, CASE WHEN kind = 1 THEN 1 ELSE 0 END AS level,
                   CASE WHEN kind = 0 THEN 'pkg' || b % 20 || '.mod' || b WHEN kind = 1 THEN 'mod' || b ELSE 'pkg' || b % 20 END AS target, CASE WHEN kind = 2 THEN 'mod' || b END AS name,
                   CASE WHEN kind = 0 THEN 'pkg' || b % 20 || '.mod' || b WHEN kind = 1 THEN 'pkg' || a % 20 || '.mod' || b ELSE 'pkg' || b % 20 END AS absolute FROM near JOIN files x ON x.p_partkey = a WHERE NOT x.script),
bound AS (SELECT i.*, coalesce(s.module, o.module) AS bound FROM imports i LEFT JOIN modules s ON s.bundle_id = i.bundle_id AND s.module = i.absolute || '.' || i.name LEFT JOIN modules o ON o.bundle_id = i.bundle_id AND o.module = i.absolute),
edges AS (SELECT DISTINCT i.bundle_id, importer AS src, m.module AS dst FROM imports i JOIN modules m ON m.bundle_id = i.bundle_id AND m.module <> i.importer
          AND (m.module = i.absolute OR contains(i.absolute, '.') AND starts_with(i.absolute, m.module || '.') AND contains(m.module, '.') OR contains(m.module, '.') AND regexp_replace(m.module, '\\.[^.]+$', '') = i.absolute))
"""


def source_tree(spark, sf_dir):
    """files (bundle_id, path), imports and script imports of the parts."""
    parts = table(spark, sf_dir, "part")
    files = spark.sql(f"SELECT p_partkey, p_partkey % 4 AS bundle_id, {_PATH} AS path, {_NAME} AS module, {_SCRIPT} AS script FROM {{p}}", p=parts)
    near = spark.sql(
        "SELECT DISTINCT a, b, kind FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b, l_linenumber % 3 AS kind FROM {l}) WHERE b IS NOT NULL AND a <> b",
        l=table(spark, sf_dir, "lineitem"),
    )
    own = near.join(files, F.col("a") == F.col("p_partkey"))
    imports = own.where("NOT script").selectExpr(
        "bundle_id", "module AS importer", "CASE WHEN kind = 1 THEN 1 ELSE 0 END AS level", "CASE WHEN kind = 0 THEN 'pkg' || b % 20 || '.mod' || b WHEN kind = 1 THEN 'mod' || b ELSE 'pkg' || b % 20 END AS target", "CASE WHEN kind = 2 THEN 'mod' || b END AS name"
    ).distinct()
    scripts = own.where("script").selectExpr("bundle_id", "path", "CASE WHEN kind = 0 THEN '../../c' || b % 20 || '/view' || b WHEN kind = 1 THEN '@web/c' || b % 20 || '/m' || b ELSE 'ui-kit/c' || b % 20 || '/view' || b || '.tsx' END AS spec").distinct()
    return files.select("bundle_id", "path"), imports, scripts


@query(f"WITH {FILES_SQL} SELECT * FROM modules")
def module_names(spark, sf_dir):
    return M.module_names(source_tree(spark, sf_dir)[0])


@query(f"WITH {FILES_SQL} SELECT bundle_id, importer, level, target, name, absolute, bound AS module, CASE WHEN bound IS NULL THEN regexp_extract(absolute, '^[^.]+') END AS package FROM bound")
def bound_imports(spark, sf_dir):
    files, imports, _ = source_tree(spark, sf_dir)
    return M.bound_imports(imports, M.module_names(files))


@query(f"WITH {FILES_SQL} SELECT * FROM edges")
def dependency_edges(spark, sf_dir):
    files, imports, _ = source_tree(spark, sf_dir)
    modules = M.module_names(files)
    return M.dependency_edges(M.bound_imports(imports, modules), modules)


@query(
    f"""WITH RECURSIVE {FILES_SQL}, changed AS (SELECT bundle_id, module FROM modules WHERE module = 'pkg3' OR module LIKE '%.mod%5'),
seen AS (SELECT bundle_id, module FROM changed UNION SELECT e.bundle_id, e.src FROM seen s JOIN edges e ON e.bundle_id = s.bundle_id AND e.dst = s.module)
SELECT * FROM seen UNION SELECT i.bundle_id, i.importer FROM imports i JOIN changed c ON c.bundle_id = i.bundle_id AND c.module = 'pkg3' WHERE i.absolute = 'pkg3' OR starts_with(i.absolute, 'pkg3.')"""
)
def widened_affected(spark, sf_dir):
    files, imports, _ = source_tree(spark, sf_dir)
    modules = stored(M.module_names(files), "modules")
    bound = stored(M.bound_imports(imports, modules), "bound")
    changed = modules.where("module = 'pkg3' OR module LIKE '%.mod%5'").select("bundle_id", "module")
    return M.affected_modules(changed, stored(M.dependency_ways(bound, modules), "ways"), bound, modules.where("module = 'pkg3'"))


@query(
    f"""WITH {FILES_SQL}, s AS (SELECT DISTINCT x.bundle_id, x.path, kind, b % 20 AS c, b,
    CASE WHEN kind = 0 THEN '../../c' || b % 20 || '/view' || b WHEN kind = 1 THEN '@web/c' || b % 20 || '/m' || b ELSE 'ui-kit/c' || b % 20 || '/view' || b || '.tsx' END AS spec FROM near JOIN files x ON x.p_partkey = a WHERE x.script),
t AS (SELECT *, CASE WHEN kind = 0 THEN CASE WHEN path LIKE '%/index.ts' THEN 'web/c' ELSE 'c' END || c || '/view' || b WHEN kind = 1 THEN 'web/c' || c || '/m' || b || '/index' ELSE 'web/c' || c || '/view' || b END AS meant FROM s)
SELECT t.bundle_id, t.path, t.spec, coalesce(m.module, t.spec) AS module FROM t LEFT JOIN modules m ON m.bundle_id = t.bundle_id AND m.module = t.meant"""
)
def script_imports(spark, sf_dir):
    files, _, scripts = source_tree(spark, sf_dir)
    bundles = files.select("bundle_id").distinct()
    return M.script_imports(scripts, M.module_names(files), bundles.selectExpr("bundle_id", "'@web' AS prefix", "'web' AS folder"), bundles.selectExpr("bundle_id", "'ui-kit' AS prefix", "'./web' AS folder"))


@query(
    """WITH RECURSIVE e AS (SELECT p_partkey % 4 AS bundle_id, p_partkey AS k, p_partkey - 4 AS t FROM part WHERE p_partkey % 20 IN (4, 8, 12, 16) OR p_partkey % 40 = 0 AND p_partkey > 0),
w AS (SELECT p_partkey % 4 AS bundle_id, p_partkey AS k, p_partkey AS here, 0 AS n FROM part UNION ALL SELECT w.bundle_id, w.k, e.t, n + 1 FROM w JOIN e ON e.k = w.here WHERE n < 4)
SELECT bundle_id, 'm' || k AS module, 'X' || k % 3 AS name, 'm' || arg_max(here, n) AS canonical_module, 'X' || k % 3 AS canonical_name FROM w GROUP BY bundle_id, k"""
)
def canonical_names(spark, sf_dir):
    """Names followed through chains of re-exports, four steps at most."""
    parts = table(spark, sf_dir, "part")
    names = parts.selectExpr("p_partkey % 4 AS bundle_id", "'m' || p_partkey AS module", "'X' || p_partkey % 3 AS name")
    chained = parts.where("p_partkey % 20 IN (4, 8, 12, 16) OR p_partkey % 40 = 0 AND p_partkey > 0")
    exports = chained.selectExpr("p_partkey % 4 AS bundle_id", "'m' || p_partkey AS module", "explode(array('X0', 'X1', 'X2')) AS name", "'m' || (p_partkey - 4) AS to_module").withColumn("to_name", F.col("name"))
    return M.canonical_names(names, exports, most=4).drop("cyclic")


@query(
    """WITH RECURSIVE e AS (SELECT p_partkey AS k, CASE p_partkey WHEN 4 THEN 12 ELSE p_partkey - 4 END AS t FROM part WHERE p_partkey >= 4), r AS (SELECT k, t FROM e UNION SELECT r.k, e.t FROM r JOIN e ON e.k = r.t),
c AS (SELECT k FROM r WHERE k = t), i AS (SELECT r.k, min('m' || r.t) AS least FROM r JOIN c ON c.k = r.t GROUP BY r.k), f AS (SELECT r.k, min(r.t) AS t FROM r LEFT JOIN e ON e.k = r.t WHERE e.k IS NULL GROUP BY r.k)
SELECT p_partkey % 4 AS bundle_id, 'm' || p_partkey AS module, coalesce(least, 'm' || coalesce(f.t, p_partkey)) AS canonical_module, least IS NOT NULL AS cyclic FROM part LEFT JOIN f ON f.k = p_partkey LEFT JOIN i ON i.k = p_partkey"""
)
def canonical_chains(spark, sf_dir):
    """Re-exports in chains as long as a quarter of all parts, some of which run into a cycle of three."""
    parts = table(spark, sf_dir, "part")
    names = parts.selectExpr("p_partkey % 4 AS bundle_id", "'m' || p_partkey AS module", "'X' AS name")
    exports = parts.where("p_partkey >= 4").selectExpr("p_partkey % 4 AS bundle_id", "'m' || p_partkey AS module", "'X' AS name", "'m' || CASE p_partkey WHEN 4 THEN 12 ELSE p_partkey - 4 END AS to_module", "'X' AS to_name")
    return M.canonical_names(names, exports).select("bundle_id", "module", "canonical_module", "cyclic")


@query(
    f"""WITH {FILES_SQL}, ev AS (SELECT f.bundle_id, l_orderkey AS fact_id, l_linenumber AS pos, f.path FROM lineitem JOIN files f ON f.p_partkey = l_partkey)
SELECT e.bundle_id, e.fact_id, first(m.module ORDER BY e.pos, m.module) AS module FROM (SELECT bundle_id, fact_id, path, min(pos) AS pos FROM ev GROUP BY ALL) e JOIN modules m ON m.bundle_id = e.bundle_id AND m.path = e.path GROUP BY e.bundle_id, e.fact_id"""
)
def evidence_modules(spark, sf_dir):
    files = source_tree(spark, sf_dir)[0]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    paths = spark.sql(f"SELECT p_partkey, p_partkey % 4 AS bundle_id, {_PATH} AS path FROM {{p}}", p=table(spark, sf_dir, "part"))
    evidence = lines.join(paths, F.col("l_partkey") == F.col("p_partkey")).select("bundle_id", F.col("l_orderkey").alias("fact_id"), F.col("l_linenumber").alias("pos"), "path")
    return M.modules_of_evidence(evidence, M.module_names(files))


@query(
    """WITH r AS (SELECT s_nationkey AS bundle_id, 'supplier ' || right(s_name, 9) AS f, 'SUPPLIER_' || lpad(CAST(s_suppkey + 1 AS VARCHAR), 9, '0') AS t FROM supplier)
SELECT DISTINCT a.s_nationkey AS bundle_id, a.s_suppkey AS src, b.s_suppkey AS dst FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_suppkey = a.s_suppkey + 1"""
)
def named_routes(spark, sf_dir):
    """Suppliers of a nation route to the next one of the same nation, by names that are written in other ways."""
    suppliers = table(spark, sf_dir, "supplier")
    agents = suppliers.selectExpr("s_nationkey AS bundle_id", "s_suppkey AS agent_id", "s_name AS name")
    routes = suppliers.selectExpr("s_nationkey AS bundle_id", "'supplier ' || right(s_name, 9) AS from_name", "'SUPPLIER_' || lpad(CAST(s_suppkey + 1 AS STRING), 9, '0') AS to_name")
    return M.routes_by_name(routes, agents, F.regexp_replace(F.lower("name"), "[^a-z0-9]+", ""))


# Incremental scans: customers are repositories, their orders are what changed.

_GLOBAL = "CASE o_orderkey % 97 WHEN 0 THEN 'web/package.json' WHEN 1 THEN 'deps/requirements-dev.txt' ELSE 'src/f' || o_orderkey || '.py' END"
_CURRENT = (
    "c_custkey AS bundle_id, c_custkey % 13 <> 0 AS base_available, CASE WHEN c_custkey % 17 = 0 THEN '2' ELSE '1' END AS scanner_version, '7' AS analysis_version, CASE WHEN c_custkey % 19 = 0 THEN 'b' ELSE 'a' END AS rulepacks, "
    "'d' || c_custkey AS deps_hash, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 't' END AS tsconfig_hash, 'o' AS org_pack_hash, CASE WHEN c_custkey % 29 = 0 THEN ',src' ELSE ',' END AS source_roots"
)
_MANIFEST = "c_custkey AS bundle_id, 'c' || c_custkey % 3 AS last_commit, '1' AS scanner_version, '7' AS analysis_version, 'a' AS rulepacks, 'd' || c_custkey AS deps_hash, 't' AS tsconfig_hash, 'o' AS org_pack_hash, ',' AS source_roots"


def _manifests(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return spark.sql(f"SELECT {_MANIFEST} FROM {{c}} WHERE c_custkey % 11 <> 0", c=customers), spark.sql(f"SELECT {_CURRENT}, 'c' || c_custkey % 2 AS head_commit, c_custkey % 5 <> 0 AS record_present FROM {{c}}", c=customers)


@query(f"SELECT o_orderkey, {_GLOBAL} AS path, o_orderkey % 97 < 2 AS global FROM orders")
def global_signals(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_GLOBAL} AS path")
    return rows.withColumn("global", I.is_global_signal(F.col("path")))


@query(
    f"""WITH c AS (SELECT {_CURRENT} FROM customer), f AS (SELECT o_custkey, count(*) AS n, bool_or(o_orderkey % 97 < 2) AS g FROM orders GROUP BY o_custkey),
r AS (SELECT c.*, n, CASE WHEN bundle_id % 11 = 0 THEN 'no prior scan for this bundle' WHEN NOT base_available THEN 'base commit unavailable for diff' WHEN scanner_version <> '1' THEN 'scanner version changed' WHEN rulepacks <> 'a' THEN 'rulepack versions changed'
             WHEN tsconfig_hash IS NULL THEN 'tsconfig changed' WHEN source_roots <> ',' THEN 'source-root layout changed' WHEN g THEN 'diff touches a global resolution input' END AS reason FROM c LEFT JOIN f ON o_custkey = bundle_id)
SELECT bundle_id, CASE WHEN reason IS NULL THEN 'incremental' ELSE 'full' END AS mode, coalesce(reason, coalesce(n, 0) || ' file(s) changed') AS reason FROM r"""
)
def scan_decisions(spark, sf_dir):
    manifests, current = _manifests(spark, sf_dir)
    changed = table(spark, sf_dir, "orders").selectExpr("o_custkey AS bundle_id", f"{_GLOBAL} AS path")
    return I.decisions(manifests, current, changed)


@query("SELECT c_custkey AS bundle_id, 'c' || c_custkey % 2 AS head_commit, c_custkey % 11 <> 0 AND c_custkey % 3 = c_custkey % 2 AND c_custkey % 5 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 AS skip FROM customer")
def scan_skips(spark, sf_dir):
    return I.skipped(*_manifests(spark, sf_dir))


@query(
    f"""SELECT * FROM (SELECT {_MANIFEST} FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 4 <> 0)
UNION ALL SELECT * FROM (SELECT c_custkey AS bundle_id, 'new' AS last_commit, '2' AS scanner_version, '7' AS analysis_version, 'a' AS rulepacks, 'd' AS deps_hash, 't' AS tsconfig_hash, 'o' AS org_pack_hash, ',' AS source_roots FROM customer WHERE c_custkey % 4 = 0)"""
)
def manifest_upsert(spark, sf_dir):
    new = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").selectExpr("c_custkey AS bundle_id", "'new' AS last_commit", "'2' AS scanner_version", "'7' AS analysis_version", "'a' AS rulepacks", "'d' AS deps_hash", "'t' AS tsconfig_hash", "'o' AS org_pack_hash", "',' AS source_roots")
    return I.updated_manifests(_manifests(spark, sf_dir)[0], new)


@query(
    """WITH f AS (SELECT c_nationkey AS bundle_id, sha256('f' || c_custkey || chr(0) || sha256(c_name)) AS h FROM customer),
h AS (SELECT bundle_id, count(*) AS n, """ + ", ".join(f"CAST(sum(CAST(('0x' || h[{a + 1} : {a + 15}])::BIGINT AS HUGEINT)) AS VARCHAR) AS s{a}" for a in (0, 15, 30, 45)) + """ FROM f GROUP BY bundle_id)
SELECT bundle_id, sha256(n || '|' || s0 || '|' || s15 || '|' || s30 || '|' || s45) AS files_hash FROM h"""
)
def bundle_hashes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("bundle_id"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("path"), F.sha2("c_name", 256).alias("content_hash"))
    return I.files_hash(rows)


@query(
    """WITH v AS (SELECT o_orderkey AS fact_id, o_custkey % 25 AS bundle_id, unnest([1, 2, 3]) AS pos, unnest(['K' || o_orderkey % 9, 'K' || o_orderkey % 5, 'Z' || o_orderkey % 4]) AS key FROM orders),
d AS (SELECT DISTINCT bundle_id, fact_id, key, min(pos) OVER (PARTITION BY bundle_id, fact_id, key) AS pos FROM v WHERE key NOT IN ('K7', 'Z1', 'Z2', 'Z3')),
r AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, fact_id ORDER BY pos) AS n FROM d)
SELECT bundle_id, fact_id, string_agg(key || '=v' || right(key, 1), ',' ORDER BY pos) AS chips FROM r WHERE n <= 2 GROUP BY bundle_id, fact_id"""
)
def environment_chips(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    values = orders.selectExpr("o_custkey % 25 AS bundle_id", "o_orderkey AS fact_id", "'https://env:K' || o_orderkey % 9 || '/env:K' || o_orderkey % 5 || '/env:Z' || o_orderkey % 4 AS value")
    defaults = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS bundle_id", "explode(array('K0', 'K1', 'K2', 'K3', 'K4', 'K5', 'K6', 'K8', 'Z0')) AS key").withColumn("value", F.concat(F.lit("v"), F.right("key", F.lit(1))))
    return I.used_defaults(defaults, values).withColumn("chips", F.array_join("chips", ","))


@query("SELECT o_custkey % 25 AS bundle_id, o_orderpriority AS reason, count(*) AS n FROM orders GROUP BY ALL")
def health_counters(spark, sf_dir):
    return I.health(table(spark, sf_dir, "orders").selectExpr("o_custkey % 25 AS bundle_id", "o_orderpriority AS reason"))


# Displays, budgets, slices and commits.

_CHAIN = "CASE o_orderkey % 5 WHEN 0 THEN 'embeddings.create' WHEN 1 THEN 'audio.transcriptions.create' WHEN 2 THEN 'audio.speech.create' WHEN 3 THEN NULL ELSE 'chat.completions.create' END"
_URL = "CASE WHEN o_orderkey % 11 = 0 THEN 'https://h/v1/embeddings' END"


@query(
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 5 = 0 THEN 'embedding' WHEN o_orderkey % 5 = 1 THEN 'stt' WHEN o_orderkey % 5 = 2 THEN 'tts' ELSE 'chat' END AS task FROM orders"
)
def call_tasks(spark, sf_dir):
    rows = spark.sql(f"SELECT o_orderkey, {_URL} AS url, {_CHAIN} AS chain FROM {{o}}", o=table(spark, sf_dir, "orders"))
    return rows.select("o_orderkey", S.task_of(F.col("url"), F.col("chain")).alias("task"))


_MODEL = """CASE p_partkey % 9 WHEN 0 THEN '"m-' || p_size || '"' WHEN 1 THEN 'null' WHEN 2 THEN '{"union":["m-' || p_size || '",{"symbolic":"env:MODEL"},""]}' WHEN 3 THEN '{"union":["b","a",{"unresolved":"x"}]}'
WHEN 4 THEN '{"symbolic":"wrapper_default:lib.make' || p_size || '"}' WHEN 5 THEN '{"unresolved":"depth"}' WHEN 6 THEN '{"instance":"lib.models.Big@f.py:3"}' WHEN 7 THEN '{"union":[{"symbolic":"env:B"},{"symbolic":"env:A"}]}' ELSE '{"symbolic":"external:azure:deployment:d' || p_size || '"}' END"""


@query(
    """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'm-' || p_size WHEN 1 THEN 'not determined' WHEN 2 THEN 'm-' || p_size WHEN 3 THEN 'a | b' WHEN 4 THEN 'via make' || p_size || ' (wrapper)' WHEN 5 THEN 'not determined' WHEN 6 THEN 'Big'
 WHEN 7 THEN 'set via env A, B' ELSE 'azure deployment d' || p_size END AS display,
 CASE p_partkey % 9 WHEN 1 THEN 'no value' WHEN 2 THEN 'code default;env-configurable: MODEL' WHEN 3 THEN '+unknown' WHEN 4 THEN 'model chosen by calling code' WHEN 5 THEN 'depth' WHEN 6 THEN 'model class (lib.models.Big)' ELSE '' END AS qualifiers FROM part"""
)
def model_displays(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.parse_json(F.expr(_MODEL)).alias("v")).withColumn("m", S.canonical_model(F.col("v")))
    return rows.select("p_partkey", "m.display", F.array_join("m.qualifiers", ";").alias("qualifiers"))


@query(
    f"WITH {FACTS_SQL}, {_TYPE} SELECT bundle_id, CASE WHEN components = '' THEN system_type ELSE system_type || ' (' || replace(components, ',', ', ') || ')' END AS shown FROM system_type"
)
def system_type_texts(spark, sf_dir):
    f = facts(spark, sf_dir)
    return D.system_type(f["agents"], f["usages"], f["state"]).select("bundle_id", S.system_type_text(F.col("system_type"), F.col("components")).alias("shown"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'api' || p_size || '.example' END AS host FROM part")
def template_hosts(spark, sf_dir):
    url = "CASE p_size % 3 WHEN 0 THEN 'https://u@API' || p_size || '.example:8443/v1/{id}' WHEN 1 THEN 'https://api{n}.example/v1' ELSE 'https://api' || p_size || '.exam{x}' END"
    return table(spark, sf_dir, "part").select("p_partkey", S.template_host(F.expr(url)).alias("host"))


@query("SELECT o_custkey, count(*) AS files, CAST(sum(o_orderkey % 1000) AS BIGINT) AS lines, 12 AS most_files, 6000 AS most_lines FROM orders GROUP BY o_custkey HAVING count(*) > 12 OR sum(o_orderkey % 1000) > 6000")
def size_budget(spark, sf_dir):
    files = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey % 1000 AS loc")
    return R.over_budget(files, "o_custkey", "loc", 12, 6000)


@query(
    """WITH o AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, line AS start FROM o WHERE regexp_matches(text, 'https?://')),
l AS (SELECT doc_id, line, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9_-]{20,}', '<redacted:openai_key>', 'g'), 'AKIA[0-9A-Z]{16}', '<redacted:aws_access_key>', 'g'), 'ghp_[A-Za-z0-9]{20,}', '<redacted:github_token>', 'g'),
 '-----BEGIN [A-Z ]*PRIVATE KEY-----', '<redacted:pem_private_key>', 'g') AS text FROM o),
w AS (SELECT DISTINCT s.doc_id, s.start, l.line, l.text FROM s JOIN l ON l.doc_id = s.doc_id AND l.line BETWEEN s.start - 3 AND s.start + 3)
SELECT doc_id, CAST(start AS INT) AS start, 'window' AS part, CAST(line AS INT) AS line, sha256(text) AS text_sha256 FROM w
UNION ALL SELECT s.doc_id, CAST(s.start AS INT), 'imports', CAST(l.line AS INT), sha256(l.text) FROM s JOIN l ON l.doc_id = s.doc_id AND l.line <= 80 AND regexp_matches(l.text, '^(The|Der|Le|El) ')"""
)
def evidence_slices(spark, sf_dir):
    """Lines around every address in a text, and the lines of its head that start with an article."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("line"), "text")
    spans = lines.where(F.col("text").rlike("https?://")).select("doc_id", F.col("line").alias("start"), F.col("line").alias("stop"))
    found = R.slices(lines, spans, "doc_id", context=3, imports="^(The|Der|Le|El) ")
    return found.select("doc_id", "start", "part", "line", F.sha2("text", 256).alias("text_sha256"))


_COMMITS = "SELECT c_nationkey AS bundle_id, c_custkey AS scan_id, 'c' || c_custkey % 2 AS commit FROM customer WHERE c_custkey % 5 = 0"


@query(
    f"""WITH systems AS ({_COMMITS}), e AS (SELECT 'order' AS kind, c_nationkey AS bundle_id, o_custkey AS scan_id, CAST(o_orderkey % 50 AS VARCHAR) AS id FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'priority', c_nationkey, o_custkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT DISTINCT kind, e.bundle_id, id FROM e JOIN systems s ON s.bundle_id = e.bundle_id AND s.scan_id = e.scan_id WHERE commit = 'c0'),
h AS (SELECT DISTINCT kind, e.bundle_id, id FROM e JOIN systems s ON s.bundle_id = e.bundle_id AND s.scan_id = e.scan_id WHERE commit = 'c1')
SELECT *, 'added' AS change FROM (SELECT * FROM h EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM h)"""
)
def commit_diff(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    systems = spark.sql(_COMMITS.replace("customer", "{c}"), c=customers)
    rows = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("bundle_id"), F.col("o_custkey").alias("scan_id"), (F.col("o_orderkey") % 50).alias("order_id"), "o_orderpriority")
    return R.commit_diff({"order": (rows, "order_id"), "priority": (rows, "o_orderpriority")}, systems, "c0", "c1")


@query(
    """WITH RECURSIVE e AS (SELECT o_orderpriority AS bundle, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS INT) AS seq FROM orders),
c AS (SELECT bundle, seq, sha256(seq || '|' || o_orderkey || '|' || repeat('0', 64)) AS h FROM e WHERE seq = 1 UNION ALL SELECT e.bundle, e.seq, sha256(e.seq || '|' || e.o_orderkey || '|' || c.h) FROM c JOIN e ON e.bundle = c.bundle AND e.seq = c.seq + 1)
SELECT bundle, count(*) AS entries, true AS ok, CAST(NULL AS INT) AS first_bad_seq, arg_max(h, seq) AS tip_hash FROM c GROUP BY bundle"""
)
def long_chains(spark, sf_dir):
    """Chains of thousands of entries: each tip covers all of them."""
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("bundle"), "o_orderkey")
    return L.verify(L.hash_chain(entries, "bundle", ["o_orderkey"], ["o_orderkey"]), "bundle", ["o_orderkey"])


# Records assembled from the derived facts and flattened again; an audited upsert; sets of merged facts.


def _flattened(spark, sf_dir):
    from ..sources.records import from_json
    from .estate import flatten, parsed_once

    signals = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("bundle_id"))
    return flatten(parsed_once(from_json(D.assembled(derived(spark, sf_dir), signals))))


@query(
    f"""WITH {FACTS_SQL}, {_SYSTEM_FLAGS}, {_TYPE}, {SYSTEMS_SQL} SELECT CAST(n_nationkey AS VARCHAR) AS bundle_id, CASE WHEN a.bundle_id IS NULL AND u.bundle_id IS NULL THEN 'ai_signals_only' ELSE 'ai_detected' END AS ai_verdict,
 s.agent_count, s.tool_count, s.autonomy_profile, {", ".join(f"coalesce({f}, false) AS {f}" for f in D.FLAGS)}, has_unapproved_endpoint, has_dynamic_prompts, has_unresolved_models
FROM nation LEFT JOIN systems s ON s.bundle_id = n_nationkey LEFT JOIN (SELECT DISTINCT bundle_id FROM agents) a ON a.bundle_id = n_nationkey LEFT JOIN (SELECT DISTINCT bundle_id FROM usages) u ON u.bundle_id = n_nationkey"""
)
def assembled_systems(spark, sf_dir):
    return _flattened(spark, sf_dir)["systems"].select("bundle_id", "ai_verdict", "agent_count", "tool_count", "autonomy_profile", *D.FLAGS, "has_unapproved_endpoint", "has_dynamic_prompts", "has_unresolved_models")


@query(f"WITH {FACTS_SQL}, {FINDINGS_SQL} SELECT CAST(bundle_id AS VARCHAR) AS bundle_id, kind, severity, subject_ref, detail FROM findings")
def assembled_findings(spark, sf_dir):
    return _flattened(spark, sf_dir)["findings"].select("bundle_id", "kind", "severity", "subject_ref", "detail")


@query(
    """WITH old AS (SELECT c_custkey AS k, c_mktsegment AS tier, 'draft' AS status FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'HIGH' END AS tier, CASE WHEN c_custkey % 2 = 0 THEN 'approved' ELSE 'draft' END AS status FROM customer WHERE c_custkey % 5 < 2),
c AS (SELECT n.k, f.i, f.field, f.o AS old_value, f.v AS new_value FROM new n LEFT JOIN old ON old.k = n.k, LATERAL (VALUES (0, 'tier', old.tier, n.tier), (1, 'status', old.status, n.status)) AS f(i, field, o, v) WHERE f.v IS NOT NULL AND f.v IS DISTINCT FROM f.o)
SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY i) + CASE WHEN k % 7 = 0 THEN 3 ELSE 0 END AS INT) AS seq, field, old_value, new_value FROM c"""
)
def audited_changes(spark, sf_dir):
    """Audit entries of an upsert that go on from each customer's last one."""
    return _governed(spark, sf_dir)[1]


@query(
    """WITH old AS (SELECT c_custkey AS k, c_mktsegment AS tier, 'draft' AS status FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'HIGH' END AS tier, CASE WHEN c_custkey % 2 = 0 THEN 'approved' ELSE 'draft' END AS status FROM customer WHERE c_custkey % 5 < 2)
SELECT coalesce(n.k, o.k) AS k, coalesce(n.tier, o.tier) AS tier, coalesce(n.status, o.status) AS status FROM new n FULL JOIN old o ON n.k = o.k"""
)
def audited_upsert(spark, sf_dir):
    return _governed(spark, sf_dir)[0]


def _governed(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    old = customers.where("c_custkey % 3 <> 0").selectExpr("c_custkey AS k", "c_mktsegment AS tier", "'draft' AS status")
    new = customers.where("c_custkey % 5 < 2").selectExpr("c_custkey AS k", "CASE WHEN c_custkey % 4 = 0 THEN 'HIGH' END AS tier", "CASE WHEN c_custkey % 2 = 0 THEN 'approved' ELSE 'draft' END AS status")
    audit = customers.where("c_custkey % 7 = 0").selectExpr("c_custkey AS k", "explode(array(1, 2, 3)) AS seq")
    return R.governed(old, new, audit, "k", ["tier", "status"])


@query(
    """SELECT DISTINCT o_custkey AS id, 'method' AS field, o_orderpriority AS value FROM orders UNION SELECT DISTINCT o_custkey, 'files', unnest(['f' || o_orderkey % 4, 'g' || o_orderkey % 3]) FROM orders"""
)
def merged_fact_sets(spark, sf_dir):
    facts_ = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderpriority AS method", "array('f' || o_orderkey % 4, 'g' || o_orderkey % 3) AS files")
    return G.merged_sets(facts_, "o_custkey", ["method", "files"])


# The state store: two scans of every bundle, the second of the same commit for some


@query(
    """SELECT o_custkey AS bundle_id, 'c1' AS scan_id, o_orderkey AS entity, o_orderpriority AS value FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
UNION ALL SELECT o_custkey, 'c1', o_orderkey, 'rescanned' FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus <> 'F'
UNION ALL SELECT o_custkey, 'c2', o_orderkey, 'later' FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY'"""
)
def store_upserts(spark, sf_dir):
    """Entities in a versioned store: all bundles once, then one segment's again under the same scan (fewer entities replace them) with another's under a new scan."""
    scope = ["bundle_id", "scan_id"]
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    kept = Store(spark, f"{shared_folder(spark)}/tarnwell/store-{uuid.uuid4().hex}", buckets=16)
    first = orders.selectExpr("o_custkey AS bundle_id", "'c1' AS scan_id", "o_orderkey AS entity", "o_orderpriority AS value")
    kept.upsert({"entities": first}, first.select(*scope), scope, {"entities": [*scope, "entity"]})
    again = orders.where("c_mktsegment IN ('BUILDING', 'MACHINERY')").selectExpr("o_custkey AS bundle_id", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'c1' ELSE 'c2' END AS scan_id", "o_orderkey AS entity", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'rescanned' ELSE 'later' END AS value", "o_orderstatus")
    kept.upsert({"entities": again.where("scan_id = 'c2' OR o_orderstatus <> 'F'").drop("o_orderstatus")}, again.select(*scope), scope, {"entities": [*scope, "entity"]})
    return kept.table("entities").select("bundle_id", "scan_id", "entity", "value")


# Streams and rescans


@query(ORACLE_SQL["verify_chain"])
def streamed_chain(spark, sf_dir):
    """The edited ledger as a stream in three runs of one query, each of which goes on from the checkpoint of the one before."""
    edited = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), "F").otherwise(F.col("o_orderstatus"))
    ledger = stored(chained_orders(spark, sf_dir).withColumn("o_orderstatus", edited), "ledger")
    folder, key = f"{shared_folder(spark)}/tarnwell/stream-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, T.PROVIDER)
    try:
        for low, high in ((1, 5), (6, 10), (11, 1 << 30)):
            ledger.where(F.col("seq").between(low, high)).write.mode("append").parquet(f"{folder}/in")
            results = T.checked_chains(spark.readStream.schema(ledger.schema).parquet(f"{folder}/in"), "o_custkey", LEDGER_FIELDS)
            each = lambda batch, _: batch.write.mode("append").parquet(f"{folder}/out")
            results.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", f"{folder}/marks").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    last = T.latest(spark.read.parquet(f"{folder}/out"), "o_custkey")
    return last.select("o_custkey", "entries", "ok", F.col("first_bad_seq").cast("int").alias("first_bad_seq"), "tip_hash")


@query(
    """WITH v AS (SELECT c_custkey AS k, 2 * (c_custkey // 4) + c_custkey % 2 AS p, CASE WHEN c_acctbal < 0 THEN 'overdrawn' ELSE c_mktsegment END AS v FROM customer)
SELECT 'b' || (a.k % 2) AS bundle_id, 'c' || a.k AS module, a.v || coalesce('<' || b.v, '') AS value FROM v a LEFT JOIN v b ON b.k = a.p AND a.p <> a.k"""
)
def rescanned_facts(spark, sf_dir):
    """Customers as modules that import the one of half their number: facts after all files, and then those of overdrawn customers, changed."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "2 * (c_custkey div 4) + c_custkey % 2 AS p", "c_acctbal", "c_mktsegment")
    text = lambda value: F.concat(F.when(F.col("p") != F.col("k"), F.concat(F.lit("from c"), F.col("p").cast("string"), F.lit(" import x\n"))).otherwise(""), F.lit("v = '"), value, F.lit("'\n"))
    files = lambda rows, value, at: rows.select(F.concat(F.lit("b"), F.col("k") % 2).alias("bundle_id"), F.concat(F.lit("c"), F.col("k"), F.lit(".py")).alias("path"), text(value).alias("text"), F.lit(at).cast("long").alias("at"))

    def scan(tree, edges, targets):
        own = tree.select("bundle_id", "module", F.regexp_extract("text", r"(?m)^v = '(.*)'$", 1).alias("v"))
        over = edges.select("bundle_id", F.col("src").alias("module"), "dst").join(own.select("bundle_id", F.col("module").alias("dst"), F.col("v").alias("_v")).hint("merge"), ["bundle_id", "dst"])
        return targets.join(own.hint("merge"), ["bundle_id", "module"]).join(over.hint("merge"), ["bundle_id", "module"], "left").select("bundle_id", "module", F.concat("v", F.coalesce(F.concat(F.lit("<"), "_v"), F.lit(""))).alias("value"))

    kept = Store(spark, f"{shared_folder(spark)}/tarnwell/rescan-{uuid.uuid4().hex}", buckets=4)
    rescan = Rescan(kept, scan)
    rescan.apply(files(c, F.col("c_mktsegment"), 0), 0)
    rescan.apply(files(c.where("c_acctbal < 0"), F.lit("overdrawn"), 1), 1)
    return kept.table("facts").select("bundle_id", "module", "value")


@query(
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_totalprice > 300000 OR o_orderstatus = 'P' AND o_orderpriority = '5-LOW'
UNION ALL SELECT -c_custkey, 'added' FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey > 0"""
)
def digest_changes(spark, sf_dir):
    """Orders against a later state of them: the rows of the ranges in which their digest trees differ."""
    orders = table(spark, sf_dir, "orders")
    low = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    more = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' AND c_custkey > 0").select((-F.col("c_custkey")).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"))
    later = orders.where("o_totalprice <= 300000").withColumn("o_orderstatus", F.when(low, "F").otherwise(F.col("o_orderstatus"))).unionByName(more, allowMissingColumns=True)
    ranges = X.differing_ranges(X.digest_tree(orders, ["o_orderkey"]), X.digest_tree(later, ["o_orderkey"]))
    return X.row_changes(orders, later, ["o_orderkey"], ranges)


@query(
    """WITH RECURSIVE e AS (SELECT c_custkey AS src, CASE WHEN c_custkey = 1 THEN 3 ELSE c_custkey // 2 END AS dst FROM customer WHERE c_custkey > 0), r AS (SELECT src AS root, src AS node FROM e UNION SELECT r.root, e.dst FROM r JOIN e ON r.node = e.src)
SELECT root, count(DISTINCT o_orderpriority || o_orderstatus) AS n FROM r JOIN orders ON o_custkey = node GROUP BY root"""
)
def reachable_tools(spark, sf_dir):
    """How many kinds of orders a customer and all whom it hands off to have, as sets of bits over the condensed graph; customers 1 and 3 are a cycle."""
    c = table(spark, sf_dir, "customer").where("c_custkey > 0").selectExpr("c_custkey AS src", "CASE WHEN c_custkey = 1 THEN 3 ELSE c_custkey div 2 END AS dst")
    items = table(spark, sf_dir, "orders").selectExpr("o_custkey AS node", "o_orderpriority || o_orderstatus AS item").distinct()
    sets, _ = G.reached_items(c, items, c.select(F.col("src").alias("root")))
    return G.item_counts(sets)


@query(
    """WITH s AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + 3600000000 AS z FROM events WHERE event_type = 'signup'), p AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click')
SELECT event_id FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = p.user_id AND p.t BETWEEN s.a AND s.z)"""
)
def unconsumed_spans(spark, sf_dir):
    """Clicks, as spans of one microsecond, that no hour after a signup of their user consumes."""
    events = table(spark, sf_dir, "events")
    of = lambda kind, length: events.where(F.col("event_type") == kind).select("event_id", "user_id", V.whole_number(events, "ts").alias("a"), (V.whole_number(events, "ts") + length).alias("z"))
    return V.subtracted(of("click", 0), of("signup", 3_600_000_000), ["user_id"], "a", "z").select("event_id")
