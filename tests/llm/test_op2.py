import json

from barspan.llm.op2_tool_calls import canonical, link

CALL = "conv_id long, turn long, idx int, call_id string, name string, arguments string, level string"
RESULT = "conv_id long, turn long, call_id string, content string, name string"
SCHEMAS = {
    "add": {"properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number"}, "after": {}}, "required": ["a", "b"]},
    "say": {"properties": {"mood": {"type": "string", "enum": ["up", "down"], "maxLength": 4}, "after": {"type": "array"}}},
}


def run(spark, calls, results):
    c = spark.createDataFrame([(*x, "x") for x in calls], CALL)
    r = spark.createDataFrame([(*x, "x") for x in results], RESULT)
    return link(c, r, SCHEMAS, ["after"])


def test_links_problems_and_records(spark):
    calls = [
        (1, 0, 0, "p", "add", '{"b": 2.5, "a": 1}'),
        (1, 0, 1, "q", "add", '{"a": -1, "c": 0}'),
        (1, 2, 0, "r", "fly", "{}"),
        (1, 2, 1, "s", "say", '{"mood": "sideways", "after": ["p", "zz"]}'),
        (1, 2, 2, "t", "say", "{oops"),
        (1, 4, 0, "p", "say", "{}"),
        (1, 5, 0, "u", "say", '{"mood":"up","mood":"up"}'),
        (1, 6, 0, "late", "say", '{"mood":"up"}'),
        (2, 0, 0, "p", "say", '{"mood":"down"}'),
        (2, 0, 0, "p", "say", '{"mood":"down"}'),
        (None, 0, 0, "p", "say", "{}"),
        (3, 0, 0, None, None, None),
        (3, 1, 0, "n", "say", "{}"),
    ]
    results = [(1, 1, "p", "three\n\"é\""), (1, 3, "p", "again"), (1, 1, "late", "early"), (9, 1, "p", "lost"), (2, 1, "p", None), (None, 1, "p", "x"), (3, 2, "n", "")]
    got = {(r.conv_id, r.call_id, r.turn): r for r in run(spark, calls, results).collect()}
    problems = {k: r.problems for k, r in got.items()}
    assert problems == {
        (1, "p", 0): [],
        (1, "q", 0): ["range:a", "missing:b", "unexpected:c", "no_result"],
        (1, "r", 2): ["unknown_tool", "no_result"],
        (1, "s", 2): ["range:mood", "range:mood", "unknown_reference", "no_result"],
        (1, "t", 2): ["bad_json", "no_result"],
        (1, "p", 4): ["duplicate_call", "no_result"],
        (1, "u", 5): ["bad_json", "no_result"],
        (1, "late", 6): ["result_before_call"],
        (2, "p", 0): [],
        (None, "p", 0): ["missing_id", "no_result"],
        (3, None, 0): ["missing_id", "unknown_tool", "bad_json", "no_result"],
        (9, "p", None): ["orphan_result"],
        (None, "p", None): ["missing_id", "orphan_result"],
        (3, "n", 1): [],
    }
    assert got[1, "p", 0].record == '{"arguments":{"a":1,"b":2.5},"call_id":"p","name":"add","result":"three\\n\\"é\\""}'
    assert json.loads(got[2, "p", 0].record)["result"] is None and json.loads(got[3, "n", 1].record)["result"] == ""


def test_topological_order(spark):
    def call(cid, turn, *after):
        return (1, turn, 0, cid, "say", json.dumps({"after": list(after)}))

    calls = [call("a", 5), call("b", 1, "a"), call("c", 2, "b"), call("d", 3, "c", "a"), call("e", 0, "f"), call("f", 4, "e"), call("g", 6, "f"), call("h", 7, "d"), call("self", 8, "self"), call("z", 9)]
    rows = run(spark, calls, []).collect()
    level = {r.call_id: r.level for r in rows}
    assert {k for k, v in level.items() if v is None} == {"e", "f", "g", "self"}
    assert {r.call_id for r in rows if "cyclic_reference" in r.problems} == {"e", "f", "g", "self"}
    order = [r.call_id for r in sorted((r for r in rows if r.level is not None), key=lambda r: (r.level, r.turn, r.idx, r.call_id))]
    assert all(order.index(x) < order.index(y) for x, y in (("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("d", "h")))


def test_long_backward_chain_needs_no_rounds(spark):
    calls = [(1, t, 0, str(t), "say", json.dumps({"after": [str(t - 1)]})) for t in range(1, 300)] + [(1, 0, 0, "0", "say", "{}")]
    rows = run(spark, calls, [(1, t, str(t), "ok") for t in range(300)]).collect()
    assert len(rows) == 300 and {r.level for r in rows} == {0} and all(not r.problems for r in rows)


def test_canonical_json(spark):
    texts = ['{"b":1,"a":{"d":[1, 2 ],"c":null}}', ' [ true , "é\\u00e9/" ] ', "nope", None, '"x"']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(canonical("t")).collect()]
    assert got == ['{"a":{"c":null,"d":[1,2]},"b":1}', '[true,"éé/"]', None, None, '"x"']


def test_empty_tables(spark):
    assert run(spark, [], []).count() == 0


def test_long_turns_have_a_record(spark):
    from barspan.llm.op2_tool_calls import SCHEMAS as PLAIN
    from barspan.llm.op2_tool_calls import calls_of

    text = "word " * 200_000
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    row = link(*calls_of(turns), PLAIN, references=["after"]).first()
    assert row.problems == [] and json.loads(row.record)["arguments"]["text"] == text == json.loads(row.record)["result"]
