"""The estate dataset: records flattened to eight tables, rebuilt or upserted, and its named queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import upsert
from ..session import stored
from ..sources.store import Store

FLAGS = ("moves_money", "executes_code", "mutates_identities", "sends_external", "reads_sensitive")
KEYS = {
    "systems": ("bundle_id", "scan_id"),
    "agents": ("bundle_id", "scan_id", "agent_id"),
    "agent_tools": ("bundle_id", "scan_id", "agent_id", "tool_id"),
    "tools": ("bundle_id", "scan_id", "tool_id"),
    "models": ("bundle_id", "scan_id", "model_key"),
    "findings": ("bundle_id", "scan_id", "finding_id"),
    "mcp_servers": ("bundle_id", "scan_id", "server_id"),
    "model_usages": ("bundle_id", "scan_id", "usage_id"),
}


def _get(v: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _text(v: str, path: str) -> Column:
    """A string as it is, null for null, any other value as JSON."""
    found = F.try_variant_get(v, f"$.{path}", "variant")
    kind = F.schema_of_variant(found)
    return F.when(found.isNull() | (kind == "VOID"), None).when(kind == "STRING", F.variant_get(found, "$", "string")).otherwise(F.to_json(found))


def _flag(v: str, path: str) -> Column:
    return F.coalesce(_get(v, path, "boolean"), F.lit(False))


def flatten(records: DataFrame) -> dict[str, DataFrame]:
    """Records (record variant, bundle_id, scan_id) as eight tables. Fields that a record lacks are null."""
    r, key = records, ["bundle_id", "scan_id"]

    def each(path: str, outer: str = "record") -> DataFrame:
        return r.select(*key, F.posexplode(F.try_variant_get(outer, f"$.{path}", "array<variant>")).alias("at", "x"))

    d = lambda f: f"derived.{f}.value"
    systems = r.select(
        *key, _get("record", "name").alias("name"), _get("record", "repo_url").alias("repo_url"), _get("record", "scanned_commit").alias("commit"), _get("record", "ai_verdict").alias("ai_verdict"),
        _get("record", d("agent_count"), "long").alias("agent_count"), _get("record", d("tool_count"), "long").alias("tool_count"),
        *[_get("record", f"{d('agents_by_location')}.{x}", "long").alias(f"loc_{x}") for x in ("production", "example", "test")],
        _get("record", d("autonomy_profile")).alias("autonomy_profile"), *[_flag("record", f"{d('capability_flags')}.{f}").alias(f) for f in FLAGS],
        *[_get("record", d(f), "boolean").alias(f) for f in ("has_unapproved_endpoint", "has_dynamic_prompts", "has_unresolved_models")],
        *[_text("record", f"{f}.value").alias(f) for f in ("suggested_aia_risk_category", "system_summary")], _text("record", "owner.value").alias("owner_value"), _text("record", "owner.candidate").alias("owner_candidate"),
        *[_text("record", f"{f}.value").alias(f) for f in ("risk_tier", "lifecycle_status", "approval_status")],
        _get("record", "inventory_provenance.scanned_at").alias("scanned_at"), _get("record", "inventory_provenance.scanner").alias("scanner_ver"),
    )
    agents = each("agents").select(
        *key, _get("x", "agent_id").alias("agent_id"), _get("x", "location").alias("location"), _get("x", "language").alias("language"), *[_get("x", f"{f}.value").alias(f) for f in ("role_class", "autonomy_level", "liveness")],
        _flag("x", "is_entrypoint").alias("is_entrypoint"), _text("x", "model.value").alias("model_value"), _text("x", "model.endpoint").alias("model_endpoint"), _get("x", "model.api_style").alias("api_style"),
        _get("x", "model.provider_class").alias("model_provider_class"), _flag("x", "has_additional_models").alias("has_additional_models"), _flag("x", "system_prompt.dynamic").alias("prompt_dynamic"),
        F.coalesce(F.size(_get("x", "tools", "array<variant>")), F.lit(0)).alias("tool_count"), F.size(_get("x", "reachable_tools.value", "array<variant>")).alias("reachable_tool_count"),
        *[_flag("x", f"capability_flags.value.{f}").alias(f) for f in FLAGS], _get("x", "detection.method").alias("detection_method"), _get("x", "detection.confidence").alias("confidence"), _text("x", "agent_summary.value").alias("agent_summary"),
    )
    bridge = each("agents").select(*key, _get("x", "agent_id").alias("agent_id"), F.explode(_get("x", "tools", "array<string>")).alias("tool_id"))
    tools = each("tools").select(
        *key, _get("x", "tool_id").alias("tool_id"), _get("x", "kind").alias("kind"), _get("x", "location").alias("location"), _text("x", "side_effects").alias("side_effects"), _text("x", "external_target").alias("external_target"),
        _get("x", "is_sensitive.value", "boolean").alias("is_sensitive"), _text("x", "declared_authorisation.value").alias("declared_authorisation"), _text("x", "credential_ref").alias("credential_ref"),
        _text("x", "capability_class.value").alias("capability_class"), _text("x", "tool_summary.value").alias("tool_summary"),
    )
    used = each("derived.models_used.value")
    models = used.select(
        *key, F.left(F.sha2(F.to_json("x"), 256), F.lit(16)).alias("model_key"), _text("x", "model").alias("model_value"), _get("x", "display").alias("display"), _get("x", "task").alias("task"), _text("x", "endpoint").alias("endpoint"),
        _get("x", "api_style").alias("api_style"), _get("x", "provider_class").alias("provider_class"),
    )
    findings = each("findings").select(*key, F.format_string("%s-%04d", "scan_id", "at").alias("finding_id"), *[_get("x", f).alias(f) for f in ("kind", "severity", "subject_ref", "detail")])
    servers = each("mcp_servers").select(
        *key, _get("x", "server_id").alias("server_id"), _text("x", "server").alias("server"), _get("x", "transport").alias("transport"), _text("x", "declared_tools").alias("declared_tools"), _text("x", "approval_policy").alias("approval_policy"),
        _get("x", "attached_agent_count", "long").alias("attached_agent_count"),
    )
    usages = each("model_usages").select(
        *key, F.left(F.sha2(F.to_json(F.try_variant_get("x", "$.evidence", "variant")), 256), F.lit(12)).alias("usage_id"), _text("x", "model.value").alias("model_value"), _get("x", "model.method").alias("method"),
        _get("x", "model.confidence").alias("confidence"), _get("x", "task").alias("task"), _text("x", "endpoint").alias("endpoint"), _get("x", "in_agent").alias("in_agent"),
    )
    return {"systems": systems, "agents": agents, "agent_tools": bridge, "tools": tools, "models": models, "findings": findings, "mcp_servers": servers, "model_usages": usages}


def parsed_once(records: DataFrame) -> DataFrame:
    """Records whose parsed form is stored, so that eight tables do not parse every document eight times."""
    return stored(records.select("bundle_id", "scan_id", "record"), "records")


def rebuild(records: DataFrame, folder: str) -> None:
    """Write all tables anew."""
    for name, rows in flatten(parsed_once(records)).items():
        rows.dropDuplicates(list(KEYS[name])).write.mode("overwrite").parquet(f"{folder}/{name}")


def upserted(spark: SparkSession, folder: str, records: DataFrame, target: str) -> None:
    """Write to ``target`` the tables of ``folder`` with all rows of the records' scans replaced by theirs."""
    records = parsed_once(records)
    scans = records.select("bundle_id", "scan_id").distinct()
    for name, rows in flatten(records).items():
        old = spark.read.parquet(f"{folder}/{name}").join(scans, ["bundle_id", "scan_id"], "left_anti")
        upsert(old, rows.dropDuplicates(list(KEYS[name])), KEYS[name]).write.mode("overwrite").parquet(f"{target}/{name}")


def upsert_records(store: Store, records: DataFrame) -> int:
    """Replace in place, in one version of the store, all rows of the records' scans in all eight tables. Returns the version."""
    records = parsed_once(records)
    return store.upsert(flatten(records), records.select("bundle_id", "scan_id").distinct(), ["bundle_id", "scan_id"], KEYS)


NAMED: dict[str, str] = {
    "agents_move_money": "SELECT bundle_id, agent_id, model_value, model_endpoint FROM {agents} WHERE moves_money ORDER BY bundle_id, agent_id",
    "models_by_provider_class": "SELECT provider_class, model_value, endpoint, count(*) AS uses FROM {models} GROUP BY ALL ORDER BY provider_class, model_value, endpoint",
    "systems_unapproved_endpoint": "SELECT bundle_id, name, ai_verdict FROM {systems} WHERE has_unapproved_endpoint ORDER BY bundle_id",
    "agent_kinds_by_repo": "SELECT bundle_id, count_if(detection_method ILIKE '%bespoke%') AS bespoke, count_if(detection_method NOT ILIKE '%bespoke%') AS framework FROM {agents} GROUP BY bundle_id ORDER BY bundle_id",
    "admin_tools_without_approval": "SELECT t.bundle_id, t.tool_id FROM {tools} t LEFT ANTI JOIN (SELECT bundle_id, scan_id FROM {agents} WHERE autonomy_level = 'approval_gated') a "
    "ON a.bundle_id = t.bundle_id AND a.scan_id = t.scan_id WHERE t.side_effects ILIKE '%admin_mutation%' ORDER BY t.bundle_id, t.tool_id",
    "dynamic_prompt_high_privilege": "SELECT bundle_id, name FROM {systems} WHERE has_dynamic_prompts AND (moves_money OR executes_code OR mutates_identities) ORDER BY bundle_id",
    "dormant_ai_repos": "SELECT bundle_id, name FROM {systems} WHERE ai_verdict = 'ai_signals_only' ORDER BY bundle_id",
    "high_findings": "SELECT bundle_id, kind, subject_ref, detail FROM {findings} WHERE severity = 'high' ORDER BY bundle_id, kind, finding_id",
}


def named_query(spark: SparkSession, tables: dict[str, DataFrame], name: str) -> DataFrame:
    sql = NAMED[name]
    return spark.sql(sql, **{t: df for t, df in tables.items() if "{" + t + "}" in sql})


def write_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """One folder of CSV files with header per table; booleans are 0 or 1."""
    for name, rows in tables.items():
        flags = {c: F.col(c).cast("int") for c, kind in rows.dtypes if kind == "boolean"}
        rows.withColumns(flags).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
