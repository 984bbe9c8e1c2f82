"""Queries that SQL expresses, on the smallest tables, and their edge cases against plain Python."""

import hashlib
import json
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import chat_format as C
from tarnwell.llm import decontaminate as D
from tarnwell.llm import mixing as M
from tarnwell.llm import quality_rules as Q
from tarnwell.llm.common import word_count
from tarnwell.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) & set(QUERIES)))
def test_query_equals_sql(spark, sql, name):
    found, wanted = QUERIES[name](spark, SF), sql.sql(ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    plain = lambda names, rows: sorted((tuple(r[names.index(c)] for c in columns) for r in rows), key=str)
    assert plain(found.columns, found.collect()) == plain(wanted.columns, wanted.fetchall())


ODD = [None, "", "   \n\t", "a", "\n\n", "x " * 60, "a b c " * 30, " a b \x1c c", "ein Wort\n" * 5, "# % & | < > $ *", "é" * 10, "w" * 100_000, " ".join(str(i) for i in range(200_00))]


def features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    marked = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked)


def test_quality_features(texts):
    found = Q.text_features(texts(list(enumerate(ODD)))).collect()
    assert len(found) == len(ODD)
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == features(ODD[r.doc_id]), r.doc_id


def test_cascade_keeps_what_all_rules_pass(texts):
    rules = [Q.Rule("null", F.col("text").isNull()), Q.Rule("short", F.length("text") < 3), Q.Rule("unknown", F.lit(None).cast("boolean"))]
    judged = {r.doc_id: r.kept for r in Q.quality_cascade(texts(list(enumerate(ODD))), rules).collect()}
    assert judged == {i: t is not None and len(t) >= 3 for i, t in enumerate(ODD)}
    assert Q.quality_cascade(texts([]), rules).count() == 0


def test_cascade_order():
    rules = [Q.Rule(n, None) for n in ("dear", "cheap", "never")]
    measured = {"dear": (1.0, 0.5), "cheap": (0.1, 0.2), "never": (0.01, 0.0)}
    assert [r.name for r in Q.cascade_order(rules, measured)] == ["cheap", "dear", "never"]


def water_level(sizes, weights, budget, epochs):
    caps = [s * epochs for s in sizes]
    clamped = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in clamped]
        if not free:
            return caps
        level = (budget - sum(caps[i] for i in clamped)) / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] >= caps[i]}
        if not over:
            return [caps[i] if i in clamped else level * weights[i] for i in range(len(sizes))]
        clamped |= over


def test_mixing(spark, texts):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 60))) for i in range(300)]
    rows = [(i, t, None, rng.choice(["b", "a", None, "é", "hot", "hot", "hot"])) for i, t in rows] + [(300, None, None, "a"), (302, "long " * 50_000, None, "b"), (301, "", None, "empty"), (None, "one two", None, "a"), (5, "again", None, "hot"), (5, "again", None, "hot")]
    docs = texts(rows)
    mixed = M.mix(docs, size=word_count(F.col("text")))
    found = mixed.collect()
    assert len(found) == len(rows) and sorted(map(str, found)) == sorted(map(str, M.mix(docs, size=word_count(F.col("text"))).collect()))
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    sizes = [sum(len((r[1] or "").split()) for r in rows if r[3] == n) for n in names]
    targets = water_level(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2)
    for n, s, t in zip(names, sizes, targets):
        own = [r for r in found if r.source == n]
        assert {r.source_size for r in own} == {s} and all(abs(r.target - t) < 1e-3 for r in own)
        assert sum(r.taken for r in own) == round(t), n
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    repeated = M.repeated(mixed, docs.columns)
    assert repeated.columns == docs.columns
    assert sum(len(r.text.split()) for r in repeated.collect()) == sum(r.taken for r in found)
    assert M.mix(texts([]), size=word_count(F.col("text"))).count() == 0


def test_decontamination(spark, texts):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words[:14])), (2, "Kurz, und gut"), (2, None), (3, ""), (None, "nothing here"), (20, " ".join(words[4:20])), (3, "...")], "item_id long, text string")
    docs = [
        (0, "Before: " + ", ".join(w.upper() for w in words[2:13]) + "; after."), (1, "kurz UND\ngut? kurz und gut"), (2, None), (3, ""), (4, " ".join(words[:9])), (5, "x " * 5000 + " ".join(words[4:14]) + " y" * 5000), (6, "nothing here"), (6, "nothing here"),
    ]
    for block in (64 << 20, 150):
        found = sorted(D.decontaminate(texts(docs), items, block_bytes=block).collect(), key=lambda r: r.doc_id)
        assert [(r.doc_id, r.n_words, r.n_hit, r.items) for r in found] == [(0, 13, 11, ["1"]), (1, 6, 6, ["2"]), (2, 0, 0, []), (3, 0, 0, []), (4, 9, 0, []), (5, 10010, 10, ["1", "20"]), (6, 2, 0, []), (6, 2, 0, [])]
        assert [docs[0][1][s.start : s.stop] for s in found[0].spans] == [docs[0][1][8:-8]]
        assert found[5].items_sha256 == hashlib.sha256(b"1,20").hexdigest() and found[5].contaminated
    assert D.decontaminate(texts([]), items).count() == 0
    assert not any(r.contaminated for r in D.decontaminate(texts(docs), items.where("false")).collect())


def test_schema_violations():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": ["integer", "null"], "minimum": 0}, "b": {"type": "array", "items": {"enum": ["x"]}}}}
    assert C.violations({"a": 1, "b": ["x"]}, schema) == []
    assert C.violations({"b": ["y"], "c": 1}, schema) == ["$.a: missing", "$.b[0]: not one of the choices", "$.c: unknown"]
    assert C.violations({"a": True}, schema) == ["$.a: not integer or null"] and C.violations({"a": -1}, schema) == ["$.a: out of range"] and C.violations(None, schema) == ["$: not object"]


def test_tool_calls_are_linked_and_ordered(spark):
    rows = [
        (1, 0, "user", 'hi "you"'),
        (1, 1, "assistant", '{"tool_calls":[{"id":"b","name":"f","arguments":{"z":1,"a":"é"},"after":["c"]},{"id":"a","name":"f","arguments":[],"after":["none"]}]}'),
        (1, 2, "tool", '{"tool_call_id":"b","content":"B"}'), (1, 3, "assistant", '{"tool_calls":[{"id":"c","name":"g","arguments":{}},{"id":"a","name":"f","arguments":{}},{"name":"f"}]}'), (1, 4, "tool", '{"tool_call_id":"zz","content":{"k":1}}'),
        (1, 5, "tool", '{"tool_call_id":"c","content":null}'), (2, 0, "assistant", '{"tool_calls":[{"id":"p","name":"f","arguments":{},"after":["q"]},{"id":"q","name":"f","arguments":{},"after":["p"]}]}'), (2, 1, None, None), (3, 0, "assistant", "{broken tool_calls"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls, results = C.extract_calls(messages)
    carried = F.col("role").isin("assistant", "tool") & (F.col("conv_id") < 3)
    schemas = {"f": {"type": "object", "required": ["a"]}}
    found = {(r.conv_id, r.part): r for r in C.format_chats(messages.where(~F.coalesce(carried, F.lit(False))), calls, results, schemas).collect()}
    one = json.loads(found[1, 0].chat)["messages"]
    assert sorted((m["role"], m.get("id") or "", m.get("status") or "") for m in one) == [("call", "", "no_id"), ("call", "a", "duplicate_id"), ("call", "a", "no_result"), ("call", "b", "linked"), ("call", "c", "linked"), ("orphan", "zz", ""), ("tool", "b", ""), ("tool", "c", ""), ("user", "", "")]
    place = {m["id"]: i for i, m in enumerate(one) if m["role"] == "call" and m["id"] in ("b", "c")}
    assert place["c"] < place["b"] and one[place["b"] + 1] == {"content": "B", "id": "b", "role": "tool"}
    assert (found[1, 0].n_calls, found[1, 0].n_linked, found[1, 0].n_valid) == (5, 2, 1)
    assert found[2, 0].n_calls == 2 and '"content":null,"role":null' in found[2, 0].chat
    assert found[1, 0].chat == json.dumps(json.loads(found[1, 0].chat), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    moved = C.moves(C.link(calls, results)[0]).collect()
    assert {(r.conv_id, r.cyclic) for r in moved} == {(1, False), (2, True)}
    assert C.format_chats(messages.where("false"), calls.where("false"), results.where("false"), schemas).count() == 0


def test_long_conversations_come_in_parts(spark):
    rows = [(9, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(150)]
    others = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls, results = C.extract_calls(others)
    parts = C.format_chats(others, calls, results, {}).orderBy("part").collect()
    assert [(r.part, r.n_messages) for r in parts] == [(0, 64), (1, 64), (2, 22)]


def test_calls_of_odd_json(spark):
    deep = '{"tool_calls":[{"id":"d","name":"f","arguments":' + "[" * 5000 + "]" * 5000 + "}]}"
    rows = [
        (1, 0, "assistant", deep), (1, 1, "assistant", '{"tool_calls":[{"id":"cut","name":"f","arguments":{"a":"\\ud83d"}}]}'), (1, 2, "assistant", '{"tool_calls":[{"id":"n","name":"f","arguments":{"a":NaN}}]}'),
        (1, 3, "assistant", '{"tool_calls":[{"id":"big","name":"f","arguments":1e999}]}'), (1, 4, "tool", '{"tool_call_id":"cut","content":"\\ud83d!"}'), (1, 5, "assistant", None), (1, 6, "assistant", ""), (1, 7, "assistant", '{"tool_calls":[' + ",".join('{"id":"x%d","name":"f","arguments":{}}' % i for i in range(3000)) + "]}"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls, results = C.extract_calls(messages)
    found = {r.call_id: r.arguments for r in calls.collect()}
    assert len(found) == 3001 and found["cut"] == '{"a":"\\ud83d"}' and json.loads(found["cut"])
    assert [(r.call_id, r.content) for r in results.collect()] == [("cut", "\ufffd!")]


def test_order_of_calls_against_turns(spark):
    """Chains against the turns, cycles, and a conversation without id: at once and by rounds alike."""
    rng = random.Random(2)
    rows = [(1, t, 0, f"a{t}", [f"a{t + 1}"] if t < 9 else []) for t in range(10)]  # each waits for the next one
    rows += [(2, t, 0, f"b{t}", [f"b{(t + 1) % 30}"]) for t in range(30)]  # one cycle
    rows += [(None, t, 0, f"c{t}", [f"c{rng.randrange(t + 1, 40)}"] if t < 39 and rng.random() < 0.5 else [f"c{rng.randrange(0, t)}"] if t and rng.random() < 0.3 else []) for t in range(40)]
    calls = spark.createDataFrame([(*r, "linked") for r in rows], "conv_id long, turn long, idx int, call_id string, after array<string>, status string")
    key = lambda r: (r.conv_id is None, r.conv_id or 0, r.turn, r.idx)
    at_once, by_rounds = (sorted(C.moves(calls, at_once=n).collect(), key=key) for n in (2000, 0))
    assert at_once == by_rounds
    assert [(r.turn, r.at, r.hop) for r in at_once if r.conv_id == 1] == [(t, 9, 9 - t) for t in range(9)]
    assert all(r.cyclic and r.at == r.turn for r in at_once if r.conv_id == 2) and sum(r.conv_id == 2 for r in at_once) == 30
    placed = {(r.conv_id, r.turn): (r.at, r.hop, r.turn) for r in C.placed(calls, C.moves(calls), F.col("turn"), F.col("idx")).collect()}
    cyclic = {(r.conv_id, r.turn) for r in at_once if r.cyclic}
    for conv, turn, _, _, after in rows:
        for need in after:
            if (conv, turn) not in cyclic and (conv, int(need[1:])) not in cyclic:
                assert placed[conv, int(need[1:])] < placed[conv, turn]


def test_measured_costs(spark):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('some words of text ', id), 200)").alias("text"))
    rules = [Q.Rule("cheap", F.col("doc_id") < 30), Q.Rule("dear", F.length(F.regexp_replace("text", r"(?i)[aeiou]+x?", "")) < 0)]
    measured = Q.measure(rows, rules)
    assert abs(measured["cheap"][1] - 0.1) < 1e-9 and measured["dear"][1] == 0 and measured["dear"][0] > 3 * measured["cheap"][0]


def test_long_cycles_are_settled_at_once():
    """5000 calls in a ring, with a tail that waits for it, and a chain of as many against the turns."""
    import pandas as pd

    from tarnwell.llm.chat_format import _settle

    n = 5000
    ring = [(i, 0, (i + 1) % n, 0) for i in range(n)] + [(n, 0, 3, 0)]
    found = _settle(pd.DataFrame([("c", *r, n) for r in ring], columns=["conv_id", "turn", "idx", "d_turn", "d_idx", "size"]))
    assert len(found) == n and found["cyclic"].all() and (found["hop"] == 0).all()
    chain = [(i, 0, i + 1, 0) for i in range(n)]
    found = _settle(pd.DataFrame([("c", *r, n) for r in chain], columns=["conv_id", "turn", "idx", "d_turn", "d_idx", "size"])).sort_values("turn")
    assert not found["cyclic"].any() and (found["at"] == n).all() and found["hop"].tolist() == list(range(n, 0, -1))
