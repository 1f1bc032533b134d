"""Linking, order, validation and canonical JSON against hand-made cases."""

import json

import pytest

from flowmill.llm import tool_calls as tc

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {"f": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {
    "x": {"type": "integer", "minimum": 1}, "y": {"enum": ["a", 1, None]}, "z": {"type": "array", "items": {"type": "string"}, "maxItems": 2}}}}


def linked(spark, calls, results):
    got = tc.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS)
    return {(r.conv_id, r.call_id): r for r in got.collect()}


def test_links_and_order(spark):
    ok = '{"x": 1}'
    calls = [
        (1, "a", 0, "f", ok, []), (1, "b", 2, "f", ok, ["a"]), (1, "c", 4, "f", '{"x":0}', ["b", "zz", None]),
        (2, "a", 5, "f", ok, ["b"]), (2, "b", 7, "f", ok, ["c"]), (2, "c", 9, "f", ok, []),  # backwards
        (3, "a", 1, "f", ok, ["b"]), (3, "b", 1, "f", ok, ["a"]), (3, "c", 2, "f", ok, ["c"]), (3, "d", 0, "f", ok, None),
        (4, "a", 3, "g", ok, []), (4, "a", 1, "f", ok, []), (None, "a", 1, "f", ok, []), (4, None, 1, "f", None, [])]
    results = [(1, "a", 1, "first"), (1, "a", 3, "later"), (2, "c", 10, None), (9, "a", 1, "lost"), (1, "c", 5, "r"), (None, "a", 2, "n")]
    got = tc.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    by = {(r.conv_id, r.call_id): r for r in got if r.status != "orphan_result"}
    assert [(r.conv_id, r.result_turn) for r in sorted((r for r in got if r.status == "orphan_result"), key=str)] == [(9, 1), (None, 2)]
    assert [by[1, k].position for k in "abc"] == [0, 1, 2] and by[1, "a"].result_turn == 1
    assert json.loads(by[1, "a"].record)["result"] == "first"
    assert by[1, "c"].status == "invalid" and by[1, "c"].problems == ["/x: below 1", "unknown call zz"]
    assert [by[2, k].position for k in "cba"] == [0, 1, 2] and [by[2, k].level for k in "cba"] == [0, 1, 2]
    assert by[2, "c"].status == "linked" and by[2, "b"].status == "no_result"
    assert [by[3, k].status for k in "abcd"] == ["cycle"] * 3 + ["no_result"] and by[3, "d"].position == 0
    assert by[4, "a"].turn == 1 and by[4, "a"].repeats == 2
    assert by[None, "a"].status == by[4, None].status == "no_id"


def test_empty(spark):
    assert linked(spark, [], []) == {}
    assert {r.status for r in linked(spark, [], [(1, "a", 0, "x")]).values()} == {"orphan_result"}


def test_long_conversation(spark):
    n = 300
    calls = [(7, f"c{i}", i, "f", '{"x":1}', [f"c{i // 2}"] if i else ["c1000"]) for i in range(n)]
    got = linked(spark, calls, [(7, f"c{i}", i + 1, "r") for i in range(n)])
    assert [got[7, f"c{i}"].position for i in range(n)] == list(range(n))


@pytest.mark.parametrize("text,want", [
    ('{"b": 1, "a": [1.0, 2.50, true, null]}', '{"a":[1,2.5,true,null],"b":1}'),
    ('{"\\ud83d\\ude00": 1, "\\ufb33": 2}', '{"\U0001f600":1,"\ufb33":2}'),
    ('[1e21, 1e-7, 0.000001, 123456789012345680000, -0.0, 1E400]', None),
    ('[1e21, 1e-7, 0.000001, 333333333.33333329, 4.50, 2e-3]', '[1e+21,1e-7,0.000001,333333333.3333333,4.5,0.002]'),
    ('"a\\u000fé\\n"', '"a\\u000fé\\n"'), ('{"a":1,"a":2}', None), ('"\\ud800"', None), ("NaN", None), ("{", None), (None, None),
    ("[" * 100_000, None),
])
def test_canonical(text, want):
    if want is None:
        with pytest.raises(tc.NotJson):
            tc.parse_json(text)
    else:
        assert tc.canonical(tc.parse_json(text)) == want


def test_schema():
    check = lambda v: tc.problems_of(v, SCHEMAS["f"])
    assert check({"x": 1, "y": None, "z": ["q"]}) == []
    assert check({"x": True}) == ["/x: not integer"] and check([]) == ["/: not object"]
    assert check({"y": 2, "w": 0, "z": [1, "a", "b"]}) == ["/x: missing", "/y: not one of the values", "/w: unknown", "/z: too long", "/z/0: not string"]
