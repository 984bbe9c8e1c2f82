"""Chat formatting with tool-call linking.

Calls and results are joined by conversation and identifier. Calls are put in an order in which each follows those it depends on and
that otherwise keeps the order of turns; their arguments are validated against schemas, and every conversation is serialised as canonical JSON
(sorted keys, no spaces, UTF-8) in parts of a fixed number of turns, so that no conversation is gathered whole.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
CALLS = "conv_id, turn long, idx int, call_id string, name string, arguments string, after array<string>"


#: JSON nested deeper is taken for none.
DEEPEST = 100
_LONE = re.compile("[\ud800-\udfff]")


def canonical(value: object) -> str:
    """Sorted keys, no spaces, UTF-8; a half of a surrogate pair, which UTF-8 lacks, stays an escape."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _plain(text: str) -> str:
    """Text that UTF-8 can hold: halves of surrogate pairs are replaced."""
    return _LONE.sub("\ufffd", text)


def violations(value: object, schema: Mapping, at: str = "$") -> list[str]:
    """Where a JSON value breaks a schema: type, enum, required, properties, additionalProperties, items, minLength, minimum and maximum."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if kinds and not any(isinstance(value, _TYPES[k]) and (k in ("boolean",) or not isinstance(value, bool)) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    found = [f"{at}: not one of the choices"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k, v in value.items():
            if k in properties:
                found += violations(v, properties[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        found += [x for i, v in enumerate(value) for x in violations(v, schema["items"], f"{at}[{i}]")]
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        found.append(f"{at}: too short")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            found.append(f"{at}: out of range")
    return found


def _no_number(name: str) -> object:
    raise ValueError(f"{name} is no JSON")


def _depth(value: object) -> int:
    deep, level = 0, [value]
    while level:
        deep += 1
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
    return deep


def _parsed(text: str | None) -> object:
    """The value of a JSON text; null for what is no JSON, NaN and infinities included, or nested deeper than ``DEEPEST``."""
    try:
        value = json.loads(text, parse_constant=_no_number) if text else None
        return value if _depth(value) <= DEEPEST and _numbers(value) < math.inf else None
    except (ValueError, RecursionError):
        return None


def _numbers(value: object) -> float:
    """The largest absolute value of a float; infinite for a number beyond its range."""
    most, level = 0.0, [value]
    while level:
        most = max([most, *(abs(v) for v in level if isinstance(v, float))])
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
    return most


def extract_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that messages (conv_id, turn, role, text) carry.

    An assistant's text ``{"tool_calls": [{"id", "name", "arguments", "after"}]}`` holds calls, a tool's text
    ``{"tool_call_id", "content"}`` a result. Other texts (null, empty, no JSON), and entries of another shape, hold none; very long texts are parsed whole.
    """

    def text_of(value: dict, key: str) -> str | None:
        return _plain(found) if isinstance(found := value.get(key), str) else None

    def calls(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                value = _parsed(text) if text and "tool_calls" in text else None
                listed = value.get("tool_calls") if isinstance(value, dict) else None
                rows = [c for c in listed if isinstance(c, dict)] if isinstance(listed, list) else []
                out.append([{"call_id": text_of(c, "id"), "name": text_of(c, "name"), "arguments": canonical(c.get("arguments")), "after": [_plain(x) for x in c["after"] if isinstance(x, str)] if isinstance(c.get("after"), list) else []} for c in rows])
            yield pd.Series(out)

    def results(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values = [v if isinstance(v := _parsed(t), dict) else {} for t in texts]
            yield pd.DataFrame({"call_id": [text_of(v, "tool_call_id") for v in values], "content": [_plain(c) if isinstance(c := v.get("content"), str) else c if c is None else canonical(c) for v in values]})

    shape = "array<struct<call_id:string,name:string,arguments:string,after:array<string>>>"
    found = messages.where(F.col("role") == "assistant").select("conv_id", "turn", F.posexplode(F.pandas_udf(calls, shape)(F.col("text"))).alias("idx", "c"))
    answered = messages.where(F.col("role") == "tool").select("conv_id", "turn", F.pandas_udf(results, "call_id string, content string")(F.col("text")).alias("r"))
    return found.select("conv_id", "turn", "idx", "c.*"), answered.select("conv_id", "turn", "r.*")


def link(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls with status (linked, no_result, duplicate_id or no_id), and results with call_turn and call_idx (null for orphans).

    Of several calls of one identifier the first stands, of several results the first; the others are kept and marked.
    """
    named = lambda df: df.where(F.col("call_id").isNotNull())
    key = [F.col("conv_id").alias("_conv"), F.col("call_id").alias("_id")]
    # Both sides are one row an identifier before they meet, so no identifier is hot in the join; calls and results without one pass it by.
    first = named(calls).groupBy(*key).agg(F.min(F.struct("turn", "idx")).alias("_call"))
    answer = named(results).groupBy(F.col("conv_id").alias("_of"), F.col("call_id").alias("_to")).agg(F.min("turn").alias("_result"))
    met = first.join(answer.hint("shuffle_hash"), F.col("_conv").eqNullSafe(F.col("_of")) & (F.col("_id") == F.col("_to")), "left").select("_conv", "_id", "_call", "_result")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("call_id") == F.col("_id"))
    status = F.when((F.col("_call.turn") != F.col("turn")) | (F.col("_call.idx") != F.col("idx")), "duplicate_id").when(F.col("_result").isNull(), "no_result").otherwise("linked")
    marked = named(calls).join(met.hint("shuffle_hash"), same).select(*calls.columns, status.alias("status"))
    marked = marked.unionByName(calls.where(F.col("call_id").isNull()).withColumn("status", F.lit("no_id")))
    tied = F.col("_result") == F.col("turn")
    answered = results.join(met.hint("shuffle_hash"), same, "left").select(*results.columns, F.when(tied, F.col("_call.turn")).alias("call_turn"), F.when(tied, F.col("_call.idx")).alias("call_idx"))
    return marked, answered


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """What :func:`moves` gives, of one conversation's dependencies (turn, idx, d_turn, d_idx, size), in time that grows with their number.

    The latest turn that a call has to wait for spreads from dependencies against the order of turns to all that wait for those calls, the latest first; then the calls that wait for one turn are
    taken in topological order, and those that it does not reach are cyclic.
    """
    behind, wait, origins = {}, {}, {}
    for turn, idx, *on in zip(rows["turn"].tolist(), rows["idx"].tolist(), rows["d_turn"].tolist(), rows["d_idx"].tolist(), strict=True):
        call, on = (turn, idx), tuple(on)
        behind.setdefault(on, []).append(call)
        if on >= call:
            origins.setdefault(on[0], set()).add(call)
    for at in sorted(origins, reverse=True):
        todo = [c for c in origins[at] if c not in wait]
        wait.update(dict.fromkeys(todo, at))
        while todo:
            for other in behind.get(todo.pop(), ()):
                if other not in wait and at >= other[0]:
                    wait[other] = at
                    todo.append(other)
    after = {c: [o for o in behind.get(c, ()) if wait.get(o) == at] for c, at in wait.items()}
    open_ = dict.fromkeys(wait, 0)
    for others in after.values():
        for o in others:
            open_[o] += 1
    hop = {c: 1 if c in origins.get(at, ()) else 0 for c, at in wait.items()}
    todo = [c for c, n in open_.items() if not n]
    settled = set(todo)
    while todo:
        call = todo.pop()
        for other in after[call]:
            hop[other] = max(hop[other], hop[call] + 1)
            open_[other] -= 1
            if not open_[other]:
                settled.add(other)
                todo.append(other)
    out = [(*c, at, hop[c], False) if c in settled else (*c, c[0], 0, True) for c, at in wait.items()]
    found = pd.DataFrame(out, columns=["turn", "idx", "at", "hop", "cyclic"])
    found.insert(0, "conv_id", pd.Series([rows["conv_id"].iloc[0]] * len(found), dtype=rows["conv_id"].dtype))
    return found


def moves(calls: DataFrame, *, at_once: int = 200_000) -> DataFrame | None:
    """Calls that cannot stand at their own turn: conv_id, turn, idx, at, hop (long) and cyclic; None if there are none.

    With (turn, 0) for all others, calls sorted by (at, hop, turn, idx) each follow those in ``after``. A call moves if it depends on one that stands later: it then
    stands right behind that one. Dependencies in the order of turns need no work. A call that moves back more often than its conversation has calls waits for itself, or for one that
    does: it is cyclic and stays at its own turn. Unknown identifiers are no dependencies. Conversations of at most ``at_once`` calls and dependencies (some 10 MB of a task) are settled one by one; longer
    ones are never gathered: there each round is one join.
    """
    key = ["conv_id", "turn", "idx"]
    known = calls.where(F.col("status").isin("linked", "no_result")).select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_id"), F.col("turn").alias("d_turn"), F.col("idx").alias("d_idx"))
    wanting = calls.where(F.size("after") > 0).select(*key, F.explode(F.array_distinct("after")).alias("_need"))
    needs = wanting.join(known, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_need") == F.col("_id"))).select(*key, "d_turn", "d_idx")
    needs = written(needs, "needs")
    against = needs.where(F.struct("d_turn", "d_idx") >= F.struct("turn", "idx"))
    if not against.take(1):
        return None
    sizes = calls.groupBy(F.col("conv_id").alias("_of")).agg(F.count("*").alias("size")).join(needs.groupBy(F.col("conv_id").alias("_also")).agg(F.count("*").alias("n_needs")), F.col("_of").eqNullSafe(F.col("_also")))
    sizes = written(sizes.join(against.select(F.col("conv_id").alias("_moved")).distinct(), F.col("_of").eqNullSafe(F.col("_moved")), "left_semi").select("_of", "size", "n_needs"), "sizes")
    few = (F.col("size") <= at_once) & (F.col("n_needs") <= at_once)
    own = needs.join(sizes.where(few), F.col("conv_id").eqNullSafe(F.col("_of")))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in needs.schema if f.name in key)
    # Many small conversations are little data but much work: they keep their partitions.
    dealt = own.select(*needs.columns, "size").repartition(int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    settled = dealt.groupBy("conv_id").applyInPandas(_settle, f"{shape}, at long, hop long, cyclic boolean")
    large = sizes.where(~few)
    if large.take(1):
        settled = settled.unionByName(_by_rounds(needs.join(large, F.col("conv_id").eqNullSafe(F.col("_of")), "left_semi"), large.select("_of", "size"), key))
    return written(settled, "moves")


def _by_rounds(needs: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    def best(df: DataFrame) -> DataFrame:
        return df.groupBy(*key).agg(F.max(F.struct("at", "hop")).alias("m")).select(*key, "m.at", "m.hop")

    against = needs.where(F.struct("d_turn", "d_idx") >= F.struct("turn", "idx"))
    now = written(best(against.select(*key, F.col("d_turn").alias("at"), F.lit(1).cast("long").alias("hop"))), "moved")
    while True:
        on = F.col("m.conv_id").eqNullSafe(F.col("n.conv_id")) & (F.col("m.turn") == F.col("n.d_turn")) & (F.col("m.idx") == F.col("n.d_idx"))
        pushed = now.alias("m").join(needs.alias("n"), on).where(F.col("m.at") >= F.col("n.turn")).select("n.conv_id", "n.turn", "n.idx", F.col("m.at").alias("at"), (F.col("m.hop") + 1).alias("hop"))
        capped = best(now.unionByName(pushed)).join(sizes, F.col("conv_id").eqNullSafe(F.col("_of"))).select(*key, "at", F.least("hop", F.col("size") + 1).alias("hop"))
        after = written(capped, "moved")
        same = not after.exceptAll(now).take(1)
        discard(now)
        now = after
        if same:
            break
    cyclic = F.col("hop") > F.col("size")
    settled = now.join(sizes, F.col("conv_id").eqNullSafe(F.col("_of")))
    return settled.select(*key, F.when(cyclic, F.col("turn")).otherwise(F.col("at")).alias("at"), F.when(cyclic, F.lit(0)).otherwise(F.col("hop")).cast("long").alias("hop"), cyclic.alias("cyclic"))


def placed(rows: DataFrame, moved: DataFrame | None, turn: Column, idx: Column) -> DataFrame:
    """``rows`` with at and hop of the call at (turn, idx): its own turn and 0 unless it has moved."""
    if moved is None:
        return rows.withColumns({"at": turn, "hop": F.lit(0).cast("long")})
    m = moved.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("idx").alias("_idx"), F.col("at").alias("_at"), F.col("hop").alias("_hop"))
    joined = rows.join(m, F.col("conv_id").eqNullSafe(F.col("_conv")) & (turn == F.col("_turn")) & (idx == F.col("_idx")), "left")
    return joined.withColumns({"at": F.coalesce("_at", turn), "hop": F.coalesce("_hop", F.lit(0)).cast("long")}).drop("_conv", "_turn", "_idx", "_at", "_hop")


def _call_json(schemas: Mapping[str, Mapping]):
    def run(batches) -> Iterator[pd.DataFrame]:
        for ids, names, arguments, status in batches:
            rows = []
            for i, name, text, state in zip(ids, names, arguments, status, strict=True):
                value = _parsed(text)
                wrong = violations(value, schemas[name]) if name in schemas else [f"no tool {name}"]
                rows.append((canonical({"arguments": value, "id": i, "name": name, "role": "call", "status": state, "valid": not wrong}), not wrong, wrong))
            yield pd.DataFrame(rows, columns=["json", "valid", "wrong"])

    def typed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from run(batches)

    return typed


def _message_json(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for ids, roles, texts in batches:
        yield pd.Series([canonical({"content": t, "role": r} | ({"id": i} if i is not None else {})) for i, r, t in zip(ids, roles, texts, strict=True)])


def format_chats(others: DataFrame, calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping], *, part_turns: int = 64) -> DataFrame:
    """One row per conversation and part: conv_id, part, n_messages, n_calls, n_linked, n_valid (long) and chat (canonical JSON).

    ``others`` (conv_id, turn, role, text) are messages that are neither call nor result. A linked result stands right behind its
    call; an orphan stands at its own turn under the role ``orphan``. Null roles and texts stay null, a null turn counts as 0. Repeated messages are kept; ties go by JSON; very long
    texts stay whole; further columns are left out. A conversation without rows does not appear; an empty input gives none. ``turn`` is a long, ``idx`` an int.
    """
    calls, results = (written(rows, name) for rows, name in zip(link(calls, results), ("calls", "results"), strict=True))
    moved = moves(calls)
    json_of = F.pandas_udf(_call_json(schemas), "json string, valid boolean, wrong array<string>")
    shown = placed(calls, moved, F.col("turn"), F.col("idx")).withColumn("j", json_of("call_id", "name", "arguments", "status"))
    message = F.pandas_udf(_message_json, "string")
    zero = F.lit(0).cast("long")
    rows = shown.select("conv_id", F.struct("at", "hop", "turn", F.col("idx").cast("long").alias("idx"), F.lit(0).alias("kind"), "j.json").alias("e"), F.lit(1).alias("call"), (F.col("status") == "linked").cast("int").alias("linked"), F.col("j.valid").cast("int").alias("valid"))
    orphan = F.col("call_turn").isNull()
    behind = placed(results, moved, F.coalesce("call_turn", "turn"), F.coalesce("call_idx", F.lit(-1)))
    none = [F.lit(0).alias(c) for c in ("call", "linked", "valid")]
    text = message("call_id", F.when(orphan, "orphan").otherwise("tool"), "content")
    rows = rows.unionByName(behind.select("conv_id", F.struct("at", "hop", F.coalesce("call_turn", "turn").alias("turn"), F.coalesce("call_idx", F.lit(0)).cast("long").alias("idx"), F.lit(1).alias("kind"), text.alias("json")).alias("e"), *none))
    rows = rows.unionByName(others.select("conv_id", F.struct(F.col("turn").alias("at"), zero.alias("hop"), "turn", zero.alias("idx"), F.lit(-1).alias("kind"), message(F.lit(None).cast("string"), "role", "text").alias("json")).alias("e"), *none))
    part = F.floor(F.coalesce(F.col("e.at"), zero) / part_turns)
    parts = rows.groupBy("conv_id", part.alias("part")).agg(F.array_sort(F.collect_list("e")).alias("e"), *[F.sum(c).cast("long").alias(f"n_{d}") for c, d in (("call", "calls"), ("linked", "linked"), ("valid", "valid"))])
    chat = F.concat(F.lit('{"conv_id":'), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(',"messages":['), F.array_join(F.transform("e", lambda x: x["json"]), ","), F.lit('],"part":'), F.col("part").cast("string"), F.lit("}"))
    return parts.select("conv_id", "part", F.size("e").cast("long").alias("n_messages"), "n_calls", "n_linked", "n_valid", chat.alias("chat"))


REPLY = {"reply": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}}


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    """The table has no tool messages, so each user's turn is read as a call of a ``reply`` tool, and the assistant's turn that follows as its result.

    A call waits for the call before it, as a rule. By conversation and place, every sixth one waits for the next one instead, which waits for none, and so has to move; every sixth one waits for
    the next one, which waits for it: a cycle.
    """
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    turn = F.col("turn").cast("long")
    kind = F.pmod(F.col("conv_id") + F.floor(turn / 2), F.lit(6))
    after = F.when(kind.isin(1, 4), F.array(name(turn + 2))).when(kind == 2, F.array().cast("array<string>")).otherwise(F.array(name(turn - 2)))
    calls = table.where(F.col("role") == "user").select("conv_id", turn.alias("turn"), F.lit(0).alias("idx"), name(turn).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn"))).alias("arguments"), after.alias("after"))
    results = table.where(F.col("role") == "assistant").select("conv_id", turn.alias("turn"), name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    others = table.where(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))).withColumn("turn", turn)
    return format_chats(others, calls, results, REPLY)


OP5_SQL = r"""
WITH c AS (SELECT u.conv_id, u.turn, r.turn IS NOT NULL AS linked, u.text IS NOT NULL AND u.text <> '' AS valid, u.text,
                  CASE WHEN (u.conv_id + u.turn // 2) % 6 = 1 AND n.turn IS NOT NULL THEN 1 ELSE 0 END AS moved
           FROM conversations u LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant') r ON r.conv_id = u.conv_id AND r.turn = u.turn + 1
                LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user') n ON n.conv_id = u.conv_id AND n.turn = u.turn + 2
           WHERE u.role = 'user'),
m AS (SELECT DISTINCT conv_id, turn, moved FROM c),
e AS (SELECT conv_id, turn + 2 * moved AS pos, moved AS hop, turn, 0 AS kind, 1 AS call, CAST(linked AS INT) AS linked, CAST(valid AS INT) AS valid,
             '{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"prompt":' || to_json(text) || ',' END || '"turn":' || turn || '},"id":"' || conv_id || ':' || turn || '","name":"reply","role":"call","status":"'
             || CASE WHEN linked THEN 'linked' ELSE 'no_result' END || '","valid":' || valid || '}' AS j FROM c
      UNION ALL
      SELECT a.conv_id, CASE WHEN m.turn IS NULL THEN a.turn ELSE m.turn + 2 * m.moved END, coalesce(m.moved, 0), CASE WHEN m.turn IS NULL THEN a.turn ELSE m.turn END, 1, 0, 0, 0,
             '{"content":' || coalesce(to_json(a.text), 'null') || ',"id":"' || a.conv_id || ':' || (a.turn - 1) || '","role":"' || CASE WHEN m.turn IS NULL THEN 'orphan' ELSE 'tool' END || '"}'
      FROM conversations a LEFT JOIN m ON a.conv_id = m.conv_id AND m.turn = a.turn - 1 WHERE a.role = 'assistant'
      UNION ALL
      SELECT conv_id, turn, 0, turn, -1, 0, 0, 0, '{"content":' || coalesce(to_json(text), 'null') || ',"role":' || coalesce(to_json(role), 'null') || '}' FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant'))
SELECT conv_id, CAST(pos // 64 AS BIGINT) AS part, count(*) AS n_messages, CAST(sum(call) AS BIGINT) AS n_calls, CAST(sum(linked) AS BIGINT) AS n_linked, CAST(sum(valid) AS BIGINT) AS n_valid,
       '{"conv_id":' || conv_id || ',"messages":[' || string_agg(j, ',' ORDER BY pos, hop, turn, kind, j) || '],"part":' || (pos // 64) || '}' AS chat
FROM e GROUP BY conv_id, pos // 64
"""
