"""Identities of records: the canonical form piece by piece, in memory that does not follow the lists of a record."""

import hashlib
import json
import tracemalloc

import pytest

from tarnwell.sources import records as R

ROWS = [
    {}, {"a": []}, {"b": [1, {"y": "x\n\u00e9", "c": [[], {}, [1, [2]]]}, None], "a": {"z": [], "k": {"b": 1.5, "a": True}}, "scanned_at": 3, "inventory_provenance": {"x": [1]}},
    {"\u00e4 \" key": "v]}", "n": -1e300, "l": ["]", "}", ",", ":"]}, {"scanned_at": 1}, [1, {"b": 2, "a": [3]}], "text", 5, None,
]


def whole(text):
    record = json.loads(text)
    kept = {k: v for k, v in record.items() if k not in R.CLOCK_FIELDS} if isinstance(record, dict) else record
    return json.dumps(kept, sort_keys=True, indent=2, ensure_ascii=False)


@pytest.mark.parametrize("row", ROWS)
@pytest.mark.parametrize("indent", [None, 3])
def test_parts_are_the_whole_form(row, indent):
    text = json.dumps(row, indent=indent)
    assert "".join(R.canonical_parts(text)) == whole(text)


def test_the_last_of_equal_names_counts():
    text = '{"a": [1], "b": 2, "a" : [3, 4] }'
    assert "".join(R.canonical_parts(text)) == whole(text)


def test_a_long_record_is_never_held_as_objects(spark):
    text = json.dumps({"findings": [{"kind": f"k{i}", "evidence": [f"f{i}.py:1"], "severity": "low"} for i in range(60_000)], "bundle_id": "b"})
    tracemalloc.start()
    digest = hashlib.sha256()
    for part in R.canonical_parts(text):
        digest.update(part.encode())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(text) / 4
    assert digest.hexdigest() == hashlib.sha256(whole(text).encode()).hexdigest()
    found = spark.createDataFrame([(text,), (None,)], "value string").select(R.scan_id("value")).collect()
    assert [r[0] for r in found] == [digest.hexdigest()[:16], None]
