"""How model values, systems and endpoints are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def task_of(url: Column, hint: Column) -> Column:
    """Task of a call from its URL and the suffix of its call chain: embedding, stt, tts or chat."""
    hint = F.coalesce(hint, F.lit(""))
    embeds = F.contains(F.coalesce(url, F.lit("")), F.lit("/embeddings")) | hint.startswith("embeddings")
    return F.when(embeds, "embedding").when(F.contains(hint, F.lit("transcriptions")), "stt").when(F.contains(hint, F.lit("audio.speech")), "tts").otherwise("chat")


def template_host(template: Column) -> Column:
    """Host of a URL with ``{...}`` parts: only if the host is complete, a slash behind it, before the first of them."""
    prefix = F.regexp_extract(template, r"^([^{]*)", 1)
    found = F.regexp_extract(prefix, r"^[^:]*://(?:[^/@]*@)?([^/:@]+)(?::[^/]*)?/", 1)
    return F.nullif(F.lower(found), F.lit(""))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _symbol(symbol: Column) -> Column:
    """(display, qualifiers) of a symbolic value ``kind:key``."""
    kind, key = F.regexp_extract(symbol, r"^([^:]*)", 1), F.regexp_replace(symbol, r"^[^:]*:?", "")
    last = F.regexp_extract(key, r"([^.]*)$", 1)
    azure = (kind == "external") & key.startswith("azure:deployment:")
    shown = (
        F.when(kind == "env", F.concat(F.lit("set via env "), key))
        .when(kind == "wrapper_default", F.concat(F.lit("via "), last, F.lit(" (wrapper)")))
        .when(azure, F.concat(F.lit("azure deployment "), F.regexp_extract(key, r"([^:]*)$", 1)))
        .when(kind == "config", F.concat(F.lit("set via config "), key))
        .otherwise(symbol)
    )
    return F.struct(shown.alias("display"), F.when(kind == "wrapper_default", F.array(F.lit("model chosen by calling code"))).otherwise(F.array().cast("array<string>")).alias("qualifiers"))


def canonical_model(v: Column) -> Column:
    """(display, qualifiers) of a detected model value (variant): a literal, or an object with union, symbolic, unresolved, template or instance."""
    kind = F.schema_of_variant(v)
    some = lambda display, *quals: F.struct(display.alias("display"), F.array(*quals).cast("array<string>").alias("qualifiers"))
    members = F.try_variant_get(v, "$.union", "array<variant>")
    literals = F.filter(F.transform(members, lambda m: F.when(F.schema_of_variant(m) == "STRING", F.variant_get(m, "$", "string"))), lambda s: F.coalesce(s, F.lit("")) != "")
    symbols = F.array_compact(F.transform(members, lambda m: F.try_variant_get(m, "$.symbolic", "string")))
    keys = F.array_sort(F.array_distinct(F.transform(F.filter(symbols, lambda s: s.startswith("env:")), lambda s: F.substring(s, 5, 1 << 20))))
    others = F.filter(symbols, lambda s: ~s.startswith("env:"))
    unknown = F.exists(members, lambda m: F.try_variant_get(m, "$.unresolved", "string").isNotNull())
    joined = F.array_join(keys, ", ")
    other = _symbol(F.get(others, 0))
    n = F.size(literals)
    display = F.when(n == 1, F.get(literals, 0)).when(n > 1, F.array_join(F.array_sort(literals), " | ")).when(F.size(keys) > 0, F.concat(F.lit("set via env "), joined)).when(F.size(others) > 0, other["display"]).otherwise("not determined")
    quals = F.array_compact(F.array(F.when(n == 1, F.lit("code default")), F.when((n > 0) & (F.size(keys) > 0), F.concat(F.lit("env-configurable: "), joined)), F.when(F.coalesce(unknown, F.lit(False)), F.lit("+unknown"))))
    quals = F.when((n == 0) & (F.size(keys) == 0) & (F.size(others) > 0), F.concat(other["qualifiers"], quals)).otherwise(quals)
    symbolic, unresolved, template, instance = (_text(v, f"$.{k}") for k in ("symbolic", "unresolved", "template", "instance"))
    path = F.regexp_extract(instance, r"^([^@]*)", 1)
    short = F.regexp_extract(path, r"([^.]*)$", 1)
    return (
        F.when(v.isNull() | (kind == "VOID"), some(F.lit("not determined"), F.lit("no value")))
        .when(kind == "STRING", some(F.try_variant_get(v, "$", "string")))
        .when(members.isNotNull(), F.struct(display.alias("display"), quals.alias("qualifiers")))
        .when(symbolic.isNotNull(), _symbol(symbolic))
        .when(unresolved.isNotNull(), some(F.lit("not determined"), unresolved))
        .when(template.isNotNull(), some(template, F.lit("template")))
        .when(instance.isNotNull(), some(short, F.concat(F.lit("model class ("), path, F.lit(")"))))
        .otherwise(some(F.to_json(v)))
    )


def system_type_text(kind: Column, components: Column) -> Column:
    """``agentic (multi-agent, rag)``; null without a kind."""
    return F.when(F.size(components) > 0, F.concat(kind, F.lit(" ("), F.array_join(components, ", "), F.lit(")"))).otherwise(F.nullif(kind, F.lit("")))


def models_display(displays: Column) -> Column:
    """Distinct displays in their order, joined; null without any."""
    return F.nullif(F.array_join(F.array_distinct(F.filter(displays, lambda d: F.coalesce(d, F.lit("")) != "")), "; "), F.lit(""))
