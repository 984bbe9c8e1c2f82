"""Source trees as a table of files, and what their manifests and environment files declare."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import PROVIDER_HOSTS, PROVIDER_WILDCARDS, SECRET_PATTERNS, package_name, path_language, path_location
from ..operators.relational import top_per_key
from . import tree_source, yaml_text
from .tree_source import MAX_BYTES  # noqa: F401

SKIPPED = r"(^|/)(\.git|node_modules|__pycache__|venv)(/|$)"
HIDDEN = r"(^|/)\.[^/]+/"
# Folders whose YAML files deploy a tree, and folders that declare nothing.
MANIFEST_FOLDERS = ("infra", "k8s", "kubernetes", "deploy", "manifests")
UNDECLARED_FOLDERS = (".git", "node_modules", ".venv", "venv", "dist", "build")
SOURCE_EXTENSIONS = ("py", "ts", "tsx", "js", "jsx", "mjs", "cjs")

# Packages that mark the use of language models, as manifests name them.
AI_PACKAGES = (
    "openai", "anthropic", "langchain", "langgraph", "crewai", "llama-index", "llama_index", "litellm", "google-genai", "google-generativeai", "mistralai", "cohere", "groq", "together", "boto3",
    "semantic-kernel", "semantic_kernel", "autogen", "autogen-agentchat", "autogen-ext", "pydantic-ai", "pydantic_ai", "mcp",
)
# The same as Python code imports them (patterns), and as JavaScript does.
AI_MODULES = ("openai", "anthropic", r"langchain\w*", "langgraph", "crewai", "llama_index", "litellm", r"google\.genai", r"google\.generativeai", "mistralai", "cohere", "groq", "together", "boto3", "semantic_kernel", r"autogen\w*", "pydantic_ai", "mcp")
AI_SCRIPTS = ("openai", "ai", "langchain", "llamaindex", r"@openai/[\w-]+", "@anthropic-ai/sdk", r"@langchain/[\w-]+", r"@ai-sdk/[\w-]+", "@azure/openai", r"@google/gen[\w-]+", "@mistralai/mistralai", "@aws-sdk/client-bedrock-runtime", "@modelcontextprotocol/sdk")
# Npm packages, exact and by prefix.
NPM_PACKAGES = (
    "openai", "ai", "langchain", "llamaindex", "cohere-ai", "groq-sdk", "together-ai", "@openai/agents", "@openai/agents-core", "@anthropic-ai/sdk", "@azure/openai", "@azure-rest/ai-inference", "@google/generative-ai",
    "@google/genai", "@mistralai/mistralai", "@aws-sdk/client-bedrock-runtime", "@modelcontextprotocol/sdk", "crewai-ts",
)
NPM_PREFIXES = ("@langchain/", "@ai-sdk/", "@openai/")
# Manifests, prompt files, paths of chat calls, signs of HTTP clients.
MANIFESTS = ("pyproject.toml", "poetry.lock", "Pipfile", "setup.py", "setup.cfg")
PROMPT_FILES = (".mcp.json", "mcp.json", "SKILL.md")
CHAT_PATHS = ("/chat/completions", "/v1/messages", ":generateContent", "/converse")
HTTP_SIGNS = ("requests.", "httpx.", "aiohttp.", "urllib", "fetch(", "axios", "got.", ".post(")
TEXT_FILES = r"\.(py|md|txt|json|yaml|yml|toml|cfg|ts|tsx|js|jsx|mjs|cjs)$"
SIGNALS = ("manifest_ai_package", "manifest_ai_package_js", "prompt_artefact", "sdk_import", "org_wrapper_import", "llm_host", "chat_path_fragment", "model_near_messages")


def read_tree(spark: SparkSession, root: str, *, trees: bool = False, archives: bool = False, pieces: int = 64) -> DataFrame:
    """Files below ``root``: tree, path (relative), text (UTF-8, invalid bytes replaced; empty over ``MAX_BYTES``), content_hash (of all bytes), n_bytes, ext, language, location.

    Files whose name begins with a dot and empty ones are listed. ``root`` may be a tar or zip archive. With ``trees`` every folder and archive right below it is a tree; with
    ``archives`` those within a tree are opened. At least ``pieces`` tasks read, if there are so many folders.
    """
    tree_source.register(spark)
    rows = spark.read.format("tree").options(path=root, trees=str(trees).lower(), archives=str(archives).lower(), pieces=str(pieces)).load()
    return rows.withColumns({"ext": F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)), "language": path_language(F.col("path")), "location": path_location(F.col("path"))})


def analysable(files: DataFrame) -> DataFrame:
    """Files to parse: source extensions, no dot-folders, no declaration files."""
    return files.where(F.col("ext").isin(*SOURCE_EXTENSIONS) & ~F.col("path").rlike(HIDDEN) & ~F.col("path").endswith(".d.ts"))


def census(files: DataFrame) -> DataFrame:
    return files.groupBy("ext").agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"))


def _base(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def _first(text: Column, needles: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(n)), F.lit(n)) for n in needles])


def _near(name: str, others: Sequence[str], reach: int) -> str:
    """A pattern: ``name`` in quotes, and one of the others, in quotes and whole, within ``reach`` characters before or behind the place where it begins."""
    quoted = lambda w: f"['\"]{w}['\"]"
    behind = "|".join(f".{{0,{reach - len(w) - 2}}}{quoted(w)}" for w in others)
    before = "|".join(f"{quoted(w)}.{{0,{reach - len(w) - 2}}}" for w in others)
    return f"(?s)(?={quoted(name)})(?:{behind})|(?:{before})(?={quoted(name)})"


def signals(files: DataFrame, gateways: Sequence[str] = (), wrappers: Sequence[str] = ()) -> DataFrame:
    """(signal, path, token): every sign of model use in every file. ``gateways`` are the organisation's hosts, ``wrappers`` its packages around models."""
    path, text = F.col("path"), F.col("text")
    base = _base(path)
    manifest = base.isin(*MANIFESTS) | (base.startswith("requirements") & base.endswith(".txt"))
    named = F.array(*[F.when(text.rlike(rf"(?<![A-Za-z0-9_-]){re.escape(p)}(?![A-Za-z0-9])"), p) for p in AI_PACKAGES])
    parsed = F.from_json(text, "struct<dependencies:map<string,string>,devDependencies:map<string,string>>")
    keys = F.array_union(*[F.coalesce(F.map_keys(parsed[c]), F.array().cast("array<string>")) for c in ("dependencies", "devDependencies")])
    npm = F.filter(keys, lambda k: k.isin(*NPM_PACKAGES) | reduce(Column.__or__, [k.startswith(p) for p in NPM_PREFIXES]))
    prompt = base.isin(*PROMPT_FILES) | base.endswith(".prompt") | (base.startswith("system") & base.endswith(".md")) | F.contains(F.concat(F.lit("/"), path), F.lit("/prompts/"))
    readable, python, script = path.rlike(TEXT_FILES), path.endswith(".py"), path.rlike(r"\.(ts|tsx|js|jsx|mjs|cjs)$")
    imported = F.when(python, F.regexp_extract(text, rf"(?m)^\s*(?:from|import)\s+({'|'.join(AI_MODULES)})\b", 1)).when(script, F.regexp_extract(text, rf"(?:from|require\(\s*)\s*['\"]({'|'.join(AI_SCRIPTS)})['\"]", 1))
    wrapped = F.array(*[F.when(python & text.rlike(rf"(?m)^\s*(?:from|import)\s+{re.escape(w)}\b"), w) for w in wrappers])
    needles = (*PROVIDER_HOSTS, *(w.replace("*.", ".").replace(".*", ".") for w in PROVIDER_WILDCARDS), *gateways)
    near = text.rlike(_near("model", ("messages", "prompt", "input"), 300)) & _first(text, HTTP_SIGNS).isNotNull()
    found = {
        "manifest_ai_package": F.when(manifest, named), "manifest_ai_package_js": F.when(base == "package.json", npm), "prompt_artefact": F.array(F.when(prompt, "")), "sdk_import": F.when(readable, F.array(F.nullif(imported, F.lit("")))),
        "org_wrapper_import": wrapped if wrappers else None, "llm_host": F.when(readable, F.array(_first(text, needles))), "chat_path_fragment": F.when(readable, F.array(_first(text, CHAT_PATHS))),
        "model_near_messages": F.when(readable & near, F.array(F.lit(""))),
    }
    none = F.array().cast("array<string>")

    def of(signal: str, tokens: Column) -> Column:
        return F.transform(F.coalesce(F.array_compact(tokens), none), lambda t: F.struct(F.lit(signal).alias("signal"), t.alias("token")))

    rows = F.flatten(F.array(*[of(signal, tokens) for signal, tokens in found.items() if tokens is not None]))
    return files.select("path", F.explode(rows).alias("s")).select("s.signal", "path", "s.token")


def triage(files: DataFrame, most: int = 10, gateways: Sequence[str] = (), wrappers: Sequence[str] = ()) -> DataFrame:
    """(signal, evidence): of each sign of model use the first ``most`` pieces of evidence, ``path`` or ``path:token``. None means that a scan can stop."""
    rows = signals(files, gateways, wrappers).distinct()
    first = top_per_key(rows, ["signal"], [F.col("path"), F.col("token")], most)
    return first.select("signal", F.when(F.col("token") == "", F.col("path")).otherwise(F.concat_ws(":", "path", "token")).alias("evidence"))


def declared_versions(files: DataFrame) -> DataFrame:
    """(package, version, path): ``name==version`` lines of requirement files at the root, then poetry.lock, then uv.lock; the last one of a package wins."""
    base, root = _base(F.col("path")), ~F.contains(F.col("path"), F.lit("/"))
    wanted = files.where(root & base.startswith("requirements") & base.endswith(".txt"))
    pattern = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*==\s*([^\s;#]+)"
    lines = wanted.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line")).select(F.lit(0).alias("rank"), "path", "at", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("version"))
    block = r'(?m)^\[\[package\]\]\s*\nname = "([^"]+)"\s*\nversion = "([^"]+)"'
    locks = files.where(F.col("path").isin("poetry.lock", "uv.lock"))
    each = F.arrays_zip(F.regexp_extract_all("text", F.lit(block), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(block), F.lit(2)).alias("version"))
    locked = locks.select("path", F.posexplode(each).alias("at", "p")).select(F.when(F.col("path") == "poetry.lock", 1).otherwise(2).alias("rank"), "path", "at", "p.name", "p.version")
    found = lines.where(F.col("name") != "").unionByName(locked).withColumn("package", package_name(F.col("name")))
    return found.groupBy("package").agg(F.max(F.struct("rank", "path", "at", "version")).alias("m")).select("package", "m.version", "m.path")


def npm_versions(files: DataFrame) -> DataFrame:
    """(package, version) of package-lock.json at the root, and of pnpm-lock.yaml for packages that it lacks."""
    lock = files.where("path = 'package-lock.json'").select(F.explode(F.from_json("text", "struct<packages:map<string,struct<version:string>>>")["packages"]).alias("key", "meta"))
    first = lock.where(F.col("key").startswith("node_modules/") & F.col("meta.version").isNotNull()).select(F.lit(0).alias("rank"), F.substring("key", 14, 1 << 20).alias("package"), F.col("meta.version").alias("version"), F.lit(0).alias("at"))
    line = r"^\s*['\"]?/?((?:@[^/@\s]+/)?[^@/\s'\"]+)[@/](\d[^:()'\"\s]*)(?:\([^)]*\))*['\"]?:\s*$"
    pnpm = files.where("path = 'pnpm-lock.yaml'").select(F.posexplode(F.split("text", "\n")).alias("at", "line"))
    second = pnpm.select(F.lit(1).alias("rank"), F.regexp_extract("line", line, 1).alias("package"), F.regexp_extract("line", line, 2).alias("version"), "at").where(F.col("package") != "")
    return first.unionByName(second).groupBy("package").agg(F.min(F.struct("rank", "at", "version"))["version"].alias("version"))


def script_aliases(files: DataFrame) -> DataFrame:
    """(prefix, folder) of the path aliases of all tsconfig.json files (comments are allowed); the first target of each counts."""
    shape = "struct<compilerOptions:struct<baseUrl:string,paths:map<string,array<string>>>>"
    rows = files.where(_base(F.col("path")) == "tsconfig.json").select(F.regexp_replace("path", r"/?[^/]+$", "").alias("at"), F.from_json("text", shape, {"allowComments": "true"})["compilerOptions"].alias("o"))
    each = rows.select("at", F.col("o.baseUrl").alias("base"), F.explode("o.paths").alias("alias", "targets")).where(F.size("targets") > 0)
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"[*]+$", ""), r"/+$", "")
    step = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^[./]+", "")
    folder = F.array_join(F.filter(F.array(F.col("at"), step(F.col("base")), step(F.get("targets", 0))), lambda p: p != ""), "/")
    return each.select(bare(F.col("alias")).alias("prefix"), bare(folder).alias("folder"))


def workspaces(files: DataFrame) -> DataFrame:
    """(prefix, folder): names of the packages that lie below the root, and where."""
    inner = files.where((_base(F.col("path")) == "package.json") & F.contains(F.col("path"), F.lit("/")) & ~F.col("path").rlike(SKIPPED))
    return inner.select(F.from_json("text", "struct<name:string>")["name"].alias("prefix"), F.regexp_replace("path", r"/[^/]+$", "").alias("folder")).where(F.col("prefix").isNotNull())


def environment_defaults(files: DataFrame, most_files: int = 200, most_bytes: int = 256 << 10, by: Sequence[str] = ("tree",)) -> DataFrame:
    """(by.., key, value, path, form) of dotenv files, compose files and deployment manifests: of each tree (``by``) the first ``most_files`` by path that have at most ``most_bytes``.

    A value with a secret in it is ``[redacted]``; form is example for files that are called so, else pinned. A YAML file that does not parse declares nothing.
    """
    base, folders = F.lower(_base(F.col("path"))), F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    within = lambda names: F.arrays_overlap(folders, F.array(*map(F.lit, names)))
    dotenv = (base == ".env") | base.startswith(".env.") | base.endswith("env.example") | base.endswith(".env.sample")
    yaml = base.rlike(r"\.ya?ml$")
    wanted = files.where((dotenv | (yaml & (base.startswith("docker-compose") | within(MANIFEST_FOLDERS)))) & ~F.coalesce(within(UNDECLARED_FOLDERS), F.lit(False)))
    wanted = top_per_key(wanted, by, [F.split("path", "/")], most_files, "_place").where(F.col("n_bytes") <= most_bytes)
    line = r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$"
    lines = wanted.where(~yaml).select(*by, "path", F.explode(F.split("text", r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]")).alias("line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    raw = F.regexp_extract("line", line, 2)
    value = F.when(raw.rlike(r"""^(['"]).*\1$""") & (F.length(raw) > 1), F.regexp_extract(raw, r"""^(['"])(.*)\1$""", 2)).otherwise(F.regexp_replace(raw, r" #.*$", ""))
    plain = lines.select(*by, F.regexp_extract("line", line, 1).alias("key"), value.alias("value"), "path")

    def walk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pair = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
        for texts in batches:
            yield pa.array([[{"key": k, "value": v} for k, v in yaml_text.environment(t or "")] for t in texts.to_pylist()], type=pair)

    nested = wanted.where(yaml).select(*by, "path", F.explode(F.arrow_udf(walk, "array<struct<key:string,value:string>>")("text")).alias("e")).select(*by, "e.key", "e.value", "path")
    rows = plain.unionByName(nested).withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", "")).where("key <> '' AND value <> ''")
    secret = reduce(Column.__or__, [F.col("value").rlike(pattern) for _, pattern in SECRET_PATTERNS])
    form = F.when(F.lower(_base(F.col("path"))).rlike("example|sample"), "example").otherwise("pinned")
    return rows.select(*by, "key", F.when(secret, "[redacted]").otherwise(F.col("value")).alias("value"), "path", form.alias("form")).distinct()


def matched_configs(files: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """(rule, path): files whose path matches a rule's pattern (``*`` within a folder, ``**`` across folders)."""
    step = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    patterns = {rule: "^" + "".join(step.get(part, re.escape(part)) for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob)) + "$" for rule, glob in rules.items()}
    hits = F.array_compact(F.array(*[F.when(F.col("path").rlike(p), F.lit(rule)) for rule, p in patterns.items()]))
    return files.select(F.explode(hits).alias("rule"), "path")


def declared_agents(files: DataFrame) -> DataFrame:
    """(name, prompts): folders ``prompts/agents/<name>`` that hold system, task or prompt files, and these files in order."""
    pattern = r"(?:^|/)prompts/agents/([^/]+)/(?i:system|task|prompt)[^/]*\.(?i:md|txt|prompt)$"
    named = files.select(F.regexp_extract("path", pattern, 1).alias("name"), "path").where(F.col("name") != "")
    return named.groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("prompts"))


def front_matter(text: Column) -> Column:
    """Scalar keys of YAML front matter as a map; null without any."""
    block = F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    pairs = F.filter(F.transform(F.split(block, r"\r?\n"), lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z_][\w-]*):", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), r"""^(['"])(.*)\1$""", "$2").alias("value"))), lambda p: p["key"] != "")
    return F.when(block != "", F.map_from_entries(pairs))


def changed_paths(base: DataFrame, head: DataFrame) -> DataFrame:
    """Paths that were added, removed or whose bytes differ between two trees (path, content_hash; by their text without one)."""
    a, b = (t.select("path", (F.col("content_hash") if "content_hash" in t.columns else F.sha2("text", 256)).alias(c)) for t, c in ((base, "a"), (head, "b")))
    both = a.join(b, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))
