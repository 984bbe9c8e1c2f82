"""What is derived from the facts of an inventory: autonomy, flags, sensitivity, findings and the system's indicators.

Facts are flat tables with a ``bundle_id``: agents (agent_id, location, language, endpoint, unresolved, dynamic, method, evidence, prompt_evidence), tools (tool_id, location,
side_effects, external_target, evidence), agent_tools (agent_id, tool_id), policies (agent_id, kind, evidence), servers (server_id, transport, server, approval_policy, evidence),
agent_servers (agent_id, server_id), usages (usage_id, endpoint, task, in_agent, unresolved, evidence), state (agent_id, kind), census (ext, n_files) and triage (signal).
Evidence is an array of ``file:line``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import evidence_path, host_of, is_private_host, is_test_path, package_name, provider_class, provider_of, severity

FLAGS = ("moves_money", "executes_code", "mutates_identities", "sends_external", "reads_sensitive")
PRIVILEGES = ("executes_code", "moves_money", "mutates_identities")
#: Extensions that a scan can analyse.
ANALYSED = ("py", "ts", "tsx", "js", "jsx", "mjs", "cjs")
LOCATIONS = ("production", "example", "test")
# Folders whose code runs in batches.
BATCH_FOLDERS = ("worker", "job", "jobs", "batch", "cron", "tasks", "pipeline")


def is_unapproved(endpoint: Column, gateways: Sequence[str] = ()) -> Column:
    """Whether an endpoint has a host that is neither a provider's nor one of the organisation's gateways."""
    host = host_of(endpoint)
    return F.coalesce(host.isNotNull() & provider_of(host).isNull() & ~(host.isin(*gateways) if gateways else F.lit(False)), F.lit(False))


def autonomy(agents: DataFrame, policies: DataFrame) -> DataFrame:
    """(bundle_id, agent_id, autonomy, evidence): approval_gated with a policy of kind approval, on its evidence; else autonomous, on the agent's own."""
    gated = policies.where(F.col("kind") == "approval").groupBy("bundle_id", "agent_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("_gate"))
    found = agents.join(gated, ["bundle_id", "agent_id"], "left")
    return found.select("bundle_id", "agent_id", F.when(F.col("_gate").isNull(), "autonomous").otherwise("approval_gated").alias("autonomy"), F.when(F.size("_gate") > 0, F.col("_gate")).otherwise(F.col("evidence")).alias("evidence"))


def autonomy_profile(agents: DataFrame, levels: DataFrame) -> DataFrame:
    """Per bundle: approval_gated if any production agent is; null without production agents."""
    joined = agents.join(levels.select("bundle_id", "agent_id", "autonomy"), ["bundle_id", "agent_id"])
    gated = F.bool_or(F.when(F.col("location") == "production", F.col("autonomy") == "approval_gated"))
    return joined.groupBy("bundle_id").agg(F.when(gated, "approval_gated").when(~gated, "autonomous").alias("autonomy_profile"))


def tool_sensitivity(tools: DataFrame, sensitive: Sequence[str]) -> DataFrame:
    """``tools`` with is_sensitive: a sensitive target, or code execution or administration among the side effects."""
    risky = F.arrays_overlap("side_effects", F.array(F.lit("admin_mutation"), F.lit("code_exec")))
    return tools.withColumn("is_sensitive", F.coalesce(F.col("external_target").isin(*sensitive), F.lit(False)) | F.coalesce(risky, F.lit(False)))


def attached_servers(servers: DataFrame, agent_servers: DataFrame) -> DataFrame:
    """``servers`` with attached_agent_count, transport_risk (low for stdio, medium for a private host, else high) and approval_required."""
    counts = agent_servers.groupBy("bundle_id", "server_id").agg(F.count("*").alias("_n"))
    private = F.coalesce(is_private_host(host_of(F.col("server"))), F.lit(False))
    found = servers.join(counts, ["bundle_id", "server_id"], "left")
    return found.withColumns({
        "attached_agent_count": F.coalesce("_n", F.lit(0)), "transport_risk": F.when(F.col("transport") == "stdio", "low").when(private, "medium").otherwise("high"), "approval_required": F.col("approval_policy").isNotNull(),
    }).drop("_n")


def agent_flags(agents: DataFrame, agent_tools: DataFrame, tools: DataFrame, payment: Sequence[str], sensitive: Sequence[str]) -> DataFrame:
    """(bundle_id, agent_id, flags ..., flag_evidence): what an agent can do by its tools, and the evidence of the tools that say so."""
    has = lambda effect: F.array_contains("side_effects", effect)
    target = F.col("external_target")
    signs = {
        "moves_money": has("external_send") & F.coalesce(target.isin(*payment), F.lit(False)), "executes_code": has("code_exec"), "mutates_identities": has("admin_mutation"),
        "sends_external": has("external_send"), "reads_sensitive": has("read") & F.coalesce(target.isin(*sensitive), F.lit(False)),
    }
    rows = agent_tools.join(tools.select("bundle_id", "tool_id", F.col("evidence").alias("_proof"), *[F.coalesce(c, F.lit(False)).alias(f) for f, c in signs.items()]), ["bundle_id", "tool_id"])
    hit = reduce(Column.__or__, [F.col(f) for f in FLAGS])
    found = rows.groupBy("bundle_id", "agent_id").agg(*[F.bool_or(f).alias(f) for f in FLAGS], F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(hit, F.col("_proof")))))).alias("flag_evidence"))
    joined = agents.select("bundle_id", "agent_id").join(found, ["bundle_id", "agent_id"], "left")
    return joined.select("bundle_id", "agent_id", *[F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS], F.coalesce("flag_evidence", F.array().cast("array<string>")).alias("flag_evidence"))


def system_flags(agents: DataFrame, flags: DataFrame) -> DataFrame:
    """Per bundle: each flag over its production and example agents, and the evidence of the first agent (by id) that sets each."""
    estate = agents.where(F.col("location").isin("production", "example")).select("bundle_id", "agent_id").join(flags, ["bundle_id", "agent_id"])
    first = [F.min(F.when(F.col(f), F.struct("agent_id", "flag_evidence")))["flag_evidence"] for f in FLAGS]
    found = estate.groupBy("bundle_id").agg(*[F.bool_or(f).alias(f) for f in FLAGS], F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*first))))).alias("flag_evidence"))
    return agents.select("bundle_id").distinct().join(found, "bundle_id", "left").select("bundle_id", *[F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS], F.coalesce("flag_evidence", F.array().cast("array<string>")).alias("flag_evidence"))


def graded(findings: DataFrame) -> DataFrame:
    """``findings`` with severity: the given one, else that of the kind; a secret all of whose evidence lies in tests is low."""
    level = severity(F.col("kind"), F.col("severity"))
    tests = (F.size("evidence") > 0) & F.forall("evidence", lambda e: is_test_path(evidence_path(e)))
    return findings.withColumn("severity", F.when((F.col("kind") == "secret_literal_redacted") & (level == "high") & F.coalesce(tests, F.lit(False)), "low").otherwise(level))


def findings(agents: DataFrame, flags: DataFrame, usages: DataFrame, servers: DataFrame, census: DataFrame, triage: DataFrame, gateways: Sequence[str] = ()) -> DataFrame:
    """(bundle_id, kind, severity, subject_ref, detail, evidence), graded: what agents, calls outside agents, servers and unanalysed languages give rise to."""

    def of(rows: DataFrame, kind: str, subject: Column, detail: Column, evidence: Column, level: Column | None = None) -> DataFrame:
        return rows.select("bundle_id", F.lit(kind).alias("kind"), (level if level is not None else F.lit(None).cast("string")).alias("severity"), subject.alias("subject_ref"), detail.alias("detail"), evidence.alias("evidence"))

    known = agents.join(flags.drop("flag_evidence"), ["bundle_id", "agent_id"])
    agent, call = F.concat(F.lit("agent:"), F.col("agent_id").cast("string")), F.lit("model_usage")
    outside = F.concat(F.lit("LLM endpoint host not in approved host list: "), host_of(F.col("endpoint")))
    held = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in PRIVILEGES]))
    external = provider_class(F.col("endpoint"), gateways) == "vendor_external"
    own = F.when(F.size("prompt_evidence") > 0, F.col("prompt_evidence")).otherwise(F.col("evidence"))
    unanalysed = census.where(~F.col("ext").isin(*ANALYSED) & (F.col("n_files") > 0)).groupBy("bundle_id").agg(F.sum("n_files").alias("n"), F.array_sort(F.collect_list(F.struct("ext", "n_files"))).alias("each"))
    unanalysed = unanalysed.join(triage.select("bundle_id", F.lit(True).alias("_signs")).distinct(), "bundle_id", "left")
    parts = F.array_join(F.transform("each", lambda e: F.concat(e["n_files"].cast("string"), F.lit(" ."), e["ext"])), ", ")
    none = F.array().cast("array<string>")
    rows = [
        of(known.where(is_unapproved(F.col("endpoint"), gateways)), "unapproved_gateway", agent, outside, F.col("evidence")),
        of(known.where((F.size(held) > 0) & F.col("location").isin("production", "example")), "high_privilege_agent", agent, F.concat(F.lit("agent capability flags: "), F.array_join(held, ", ")), F.col("evidence")),
        of(known.where("unresolved"), "unresolved_model", agent, F.lit("agent model could not be resolved statically"), F.col("evidence")),
        of(known.where("dynamic AND (sends_external OR moves_money)"), "dynamic_prompt", agent, F.lit("dynamic system prompt on an agent with external-send tools"), own),
        of(usages.where(is_unapproved(F.col("endpoint"), gateways)), "unapproved_gateway", call, outside, F.col("evidence")),
        of(usages.where(~F.col("in_agent") & (F.col("task") != "embedding")), "orphan_model_usage", call, F.when(external, "external LLM call site outside any detected agent").otherwise("LLM call site outside any detected agent"), F.col("evidence"), F.when(external, "medium").otherwise("info")),
        of(usages.where("unresolved"), "unresolved_model", call, F.lit("call-site model could not be resolved statically"), F.col("evidence")),
        of(servers.where("attached_agent_count = 0"), "orphan_mcp_server", F.col("server_id").cast("string"), F.lit("MCP server declared but attached to no agent (unwired remote tooling)"), F.col("evidence")),
        of(unanalysed, "unanalysed_language_code", F.lit("system"), F.concat(F.col("n").cast("string"), F.lit(" source files in unsupported languages not analysed: "), parts), none, F.when(F.col("_signs"), "medium").otherwise("info")),
    ]
    return graded(reduce(DataFrame.unionByName, rows))


def system_type(agents: DataFrame, usages: DataFrame, state: DataFrame) -> DataFrame:
    """Per bundle of agents or usages: system_type (agentic, genai) and components."""
    a = agents.groupBy("bundle_id").agg(F.count("*").alias("n_agents"))
    batch = F.exists(F.split(F.lower(evidence_path(F.get("evidence", 0))), "/"), lambda p: p.isin(*BATCH_FOLDERS))
    u = usages.groupBy("bundle_id").agg(F.bool_or(F.col("task") == "embedding").alias("embeds"), F.bool_or(~F.col("in_agent") & F.coalesce(batch, F.lit(False))).alias("batch"))
    s = state.where(F.col("kind") == "vectorstore").select("bundle_id", F.lit(True).alias("stores")).distinct()
    found = a.join(u, "bundle_id", "full_outer").join(s, "bundle_id", "left")
    parts = [F.when(F.col("n_agents") > 1, "multi-agent"), F.when(F.col("embeds") & F.col("stores"), "rag").when(F.col("embeds"), "embeddings"), F.when(F.col("batch"), "batch-llm")]
    return found.select("bundle_id", F.when(F.col("n_agents") > 0, "agentic").otherwise("genai").alias("system_type"), F.array_compact(F.array(*parts)).alias("components"))


def data_signals(tools: DataFrame, usages: DataFrame, state: DataFrame) -> DataFrame:
    """(bundle_id, signal), distinct: hosts that tools touch or send to, and what embeddings are computed for. ``tools`` have is_sensitive."""
    target = F.col("external_target")
    said = F.when(F.col("is_sensitive"), F.concat(F.lit("touches org-flagged sensitive host "), target)).when(F.array_contains("side_effects", "external_send"), F.concat(F.lit("sends data to "), target))
    touched = tools.where(target.isNotNull() & (target != "")).select("bundle_id", said.alias("signal")).where(F.col("signal").isNotNull())
    stores = state.where(F.col("kind") == "vectorstore").select("bundle_id", F.lit(True).alias("_stores")).distinct()
    embeds = usages.where(F.col("task") == "embedding").select("bundle_id").distinct().join(stores, "bundle_id", "left")
    why = F.when(F.col("_stores"), "indexes documents for semantic search (RAG)").otherwise("computes embeddings over repository content")
    return touched.unionByName(embeds.select("bundle_id", why.alias("signal"))).distinct()


def system_block(facts: Mapping[str, DataFrame], gateways: Sequence[str] = ()) -> DataFrame:
    """One row per bundle with an agent: the system's counts by kind, place and language, and its yes-or-no indicators. ``facts`` are those of :func:`derive`."""
    agents, usages = facts["agents"], facts["usages"]
    count = lambda c, name: F.count_if(c).alias(name)
    base = agents.groupBy("bundle_id").agg(
        F.count("*").alias("agent_count"), count(F.col("method").contains("bespoke"), "bespoke_agent_count"), count(~F.col("method").contains("bespoke"), "framework_agent_count"),
        *[count(F.col("location") == x, f"agents_{x}") for x in LOCATIONS], *[count(F.col("language") == x, f"agents_{x}") for x in ("python", "typescript", "javascript")],
        F.bool_or(is_unapproved(F.col("endpoint"), gateways)).alias("_agent_outside"), F.coalesce(F.bool_or("dynamic"), F.lit(False)).alias("has_dynamic_prompts"), F.bool_or("unresolved").alias("_agent_unresolved"),
    )
    tools = facts["tools"].groupBy("bundle_id").agg(F.count("*").alias("_tools"), *[count(F.col("location") == x, f"_tools_{x}") for x in LOCATIONS])
    servers = facts["servers"].groupBy("bundle_id").agg(F.count("*").alias("_servers"))
    calls = usages.groupBy("bundle_id").agg(F.bool_or(is_unapproved(F.col("endpoint"), gateways)).alias("_call_outside"), F.bool_or("unresolved").alias("_call_unresolved"))
    found = reduce(lambda a, b: a.join(b, "bundle_id", "left"), [tools, servers, calls, facts["system_flags"].drop("flag_evidence"), facts["autonomy_profile"], facts["system_type"]], base)
    zero, no = (lambda c: F.coalesce(c, F.lit(0))), (lambda *c: F.coalesce(F.greatest(*c), F.lit(False)))
    return found.select(
        *[c for c in base.columns if not c.startswith("_")], zero("_tools").alias("tool_count"), *[zero(f"_tools_{x}").alias(f"tools_{x}") for x in LOCATIONS], zero("_servers").alias("mcp_count"), *FLAGS, "autonomy_profile",
        no("_agent_outside", "_call_outside").alias("has_unapproved_endpoint"), no("_agent_unresolved", "_call_unresolved").alias("has_unresolved_models"), "system_type", F.array_join("components", ",").alias("components"),
    )


def system_evidence(agents: DataFrame, usages: DataFrame, gateways: Sequence[str] = ()) -> DataFrame:
    """(bundle_id, indicator, evidence), distinct: the places behind unapproved endpoints, dynamic prompts and unresolved models. Evidence stays rows."""

    def of(rows: DataFrame, name: str, evidence: Column) -> DataFrame:
        return rows.select("bundle_id", F.lit(name).alias("indicator"), F.explode(evidence).alias("evidence"))

    own = F.when(F.size("prompt_evidence") > 0, F.col("prompt_evidence")).otherwise(F.col("evidence"))
    both = [of(t.where(is_unapproved(F.col("endpoint"), gateways)), "has_unapproved_endpoint", F.col("evidence")) for t in (agents, usages)] + [of(t.where("unresolved"), "has_unresolved_models", F.col("evidence")) for t in (agents, usages)]
    return reduce(DataFrame.unionByName, [*both, of(agents.where("dynamic"), "has_dynamic_prompts", own)]).distinct()


def derive(facts: Mapping[str, DataFrame], *, gateways: Sequence[str] = (), payment: Sequence[str] = (), sensitive: Sequence[str] = ()) -> dict[str, DataFrame]:
    """All derived tables of an estate: the facts, and autonomy, flags, system_flags, autonomy_profile, system_type, signals, findings and systems."""
    out = dict(facts)
    out["tools"] = tool_sensitivity(facts["tools"], sensitive)
    out["servers"] = attached_servers(facts["servers"], facts["agent_servers"])
    out["autonomy"] = autonomy(facts["agents"], facts["policies"])
    out["flags"] = agent_flags(facts["agents"], facts["agent_tools"], out["tools"], payment, sensitive)
    out["system_flags"] = system_flags(facts["agents"], out["flags"])
    out["autonomy_profile"] = autonomy_profile(facts["agents"], out["autonomy"])
    out["system_type"] = system_type(facts["agents"], facts["usages"], facts["state"])
    out["signals"] = data_signals(out["tools"], facts["usages"], facts["state"])
    out["findings"] = findings(facts["agents"], out["flags"], facts["usages"], out["servers"], facts["census"], facts["triage"], gateways)
    out["systems"] = system_block(out, gateways)
    return out


def bill_of_materials(edges: DataFrame) -> DataFrame:
    """(bundle_id, agent_id, part, items): per agent and part of its bill (model, prompt, tool, server, state, policy, transfer) the sorted distinct items.

    ``edges`` are (bundle_id, agent_id, part, item); an agent's own items are few, so that they may stand in one array.
    """
    return edges.distinct().groupBy("bundle_id", "agent_id", "part").agg(F.array_sort(F.collect_list("item")).alias("items"))


def undetected(roster: DataFrame, detected: DataFrame, name: str = "name") -> DataFrame:
    """Declared agents whose name, as letters and digits only, no detected agent has."""
    plain = F.regexp_replace(F.lower(F.col(name)), "[^a-z0-9]+", "")
    return roster.withColumn("_plain", plain).join(detected.select("bundle_id", plain.alias("_plain")).distinct(), ["bundle_id", "_plain"], "left_anti").drop("_plain")


def budgeted(candidates: DataFrame, most: int) -> DataFrame:
    """``candidates`` (bundle_id, kind, evidence, cached) with status: cached, called for the first ``most`` others of a bundle by kind and evidence, else over_budget."""
    from pyspark.sql import Window

    order = Window.partitionBy("bundle_id", "cached").orderBy("kind", "evidence")
    place = F.row_number().over(order)
    return candidates.withColumn("status", F.when(F.col("cached"), "cached").when(place <= most, "called").otherwise("over_budget"))


def assembled(derived: Mapping[str, DataFrame], signals: DataFrame) -> DataFrame:
    """(path, value): one record of JSON per bundle, its agents, tools, servers, calls and findings nested in order, with the three-way verdict.

    ``signals`` (bundle_id) are bundles with signs of model use: without agents and calls these give ai_signals_only, all others no_ai. A record is one value by its nature; the flat tables are there for what has
    no bound.
    """

    def nested(name: str, order: Column, **columns: Column) -> DataFrame:
        row = F.struct(order.alias("_o"), F.struct(*[c.alias(k) for k, c in columns.items()]).alias("r"))
        return derived[name].groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias(name))

    text = lambda c: F.col(c).cast("string")
    agents = nested("agents", F.col("agent_id"), agent_id=text("agent_id"), location=F.col("location"), language=F.col("language"), model=F.struct(F.col("endpoint")), detection=F.struct(F.col("method")))
    tools = nested("tools", F.col("tool_id"), tool_id=text("tool_id"), location=F.col("location"), side_effects=F.col("side_effects"), external_target=F.col("external_target"), is_sensitive=F.struct(F.col("is_sensitive").alias("value")))
    servers = nested("servers", F.col("server_id"), server_id=text("server_id"), transport=F.col("transport"), server=F.col("server"), approval_policy=F.col("approval_policy"), attached_agent_count=F.col("attached_agent_count"))
    calls = nested("usages", F.col("usage_id"), task=F.col("task"), endpoint=F.col("endpoint"), in_agent=F.col("in_agent").cast("string"), evidence=F.col("evidence"))
    found = nested("findings", F.struct("kind", "subject_ref", "evidence"), kind=F.col("kind"), severity=F.col("severity"), subject_ref=F.col("subject_ref"), detail=F.col("detail"))
    value = lambda c: F.struct(F.col(c).alias("value"))
    block = F.struct(value("agent_count").alias("agent_count"), value("tool_count").alias("tool_count"), value("autonomy_profile").alias("autonomy_profile"), F.struct(F.struct(*FLAGS).alias("value")).alias("capability_flags"), *[value(c).alias(c) for c in ("has_unapproved_endpoint", "has_dynamic_prompts", "has_unresolved_models")])
    systems = derived["systems"].select("bundle_id", block.alias("derived"))
    ids = reduce(DataFrame.unionByName, [t.select("bundle_id") for t in (agents, calls, signals)]).distinct()
    rows = reduce(lambda a, b: a.join(b, "bundle_id", "left"), [systems, agents, tools, servers.withColumnRenamed("servers", "mcp_servers"), calls.withColumnRenamed("usages", "model_usages"), found], ids)
    verdict = F.when(F.col("agents").isNotNull() | F.col("model_usages").isNotNull(), "ai_detected").otherwise("ai_signals_only")
    parts = ["derived", "agents", "tools", "mcp_servers", "model_usages", "findings"]
    return rows.select(text("bundle_id").alias("path"), F.to_json(F.struct(text("bundle_id").alias("bundle_id"), text("bundle_id").alias("name"), verdict.alias("ai_verdict"), *parts)).alias("value"))


def ai_bill(signals: DataFrame, versions: DataFrame, imported: DataFrame, wrappers: DataFrame, npm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by.., package, version, source, used, ecosystem, n_evidence): what a tree declares of packages around models, and the organisation's wrappers that it imports without declaring them.

    ``signals`` are (by.., signal, path, token), ``versions`` and ``npm`` (by.., package, version) of Python and of scripts, ``imported`` (by.., root) the outermost names that code imports, ``wrappers`` (fqname). Python
    names are compared in their normal form, those of scripts as they are; a package's spelling and source are those of its first path. Evidence is counted, as a package may be declared in any number of files.
    """
    of = lambda signal: signals.where((F.col("signal") == signal) & (F.col("token") != "")).select(*by, "path", "token").distinct()
    first = [F.min(F.struct("path", "token")).alias("f"), F.count_distinct("path").alias("n_evidence")]
    python = of("manifest_ai_package").groupBy(*by, package_name(F.col("token")).alias("_key")).agg(*first).select(*by, "_key", F.col("f.token").alias("package"), F.col("f.path").alias("source"), "n_evidence")
    roots = imported.select(*by, package_name(F.col("root")).alias("_key")).distinct()
    outer = F.regexp_extract("fqname", r"^([^.]+)", 1)
    known = wrappers.select(package_name(outer).alias("_key"), outer.alias("package")).where("_key <> ''").groupBy("_key").agg(F.min("package").alias("package"))
    bare = roots.join(known, "_key").join(python.select(*by, "_key"), [*by, "_key"], "left_anti").select(*by, "_key", "package", F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("n_evidence"))
    pinned = versions.select(*by, package_name(F.col("package")).alias("_key"), "version").groupBy(*by, "_key").agg(F.min("version").alias("version"))
    rows = python.unionByName(bare).join(roots.withColumn("_used", F.lit(True)), [*by, "_key"], "left").join(pinned, [*by, "_key"], "left")
    script = of("manifest_ai_package_js").groupBy(*by, F.col("token").alias("package")).agg(*first).select(*by, "package", F.col("f.path").alias("source"), "n_evidence")
    script = script.join(imported.select(*by, F.col("root").alias("package"), F.lit(True).alias("_used")).distinct(), [*by, "package"], "left").join(npm.select(*by, "package", "version"), [*by, "package"], "left")
    done = lambda rows, ecosystem: rows.select(*by, "package", "version", "source", F.coalesce("_used", F.lit(False)).alias("used"), F.lit(ecosystem).alias("ecosystem"), "n_evidence")
    return done(rows, "pypi").unionByName(done(script, "npm"))
