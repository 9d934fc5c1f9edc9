import json

from brinework.llm import tool_calls as t

SCHEMAS = {"add": {"a": {"type": "integer", "required": True}, "b": {"type": "number", "least": 0, "most": 10}, "note": {"type": "string", "least": 2}, "flag": {"type": "boolean"}, "list": {"type": "array"}, "map": {"type": "object"}}}
CALLS = "conv_id long, pos long, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id long, pos long, call_id string, content string"


def run(spark, calls, results):
    return {(r.conv_id, r.call_id): r for r in t.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()}


def test_link_and_json(spark):
    got = run(spark, [(1, 1, "x", "add", '{"b": 2.5, "a": 1}', None), (1, 3, "y", "add", '{"a": "1"}', []), (2, 1, "x", "add", "not json", None), (None, 1, "n", "add", "{}", None), (1, 1, None, "add", "{}", None)], [(1, 2, "x", 'said "é"\n'), (1, 9, "x", "again"), (1, 5, "z", None)])
    assert {k: r.status for k, r in got.items()} == {(1, "x"): "answered", (1, "y"): "unanswered", (2, "x"): "unanswered", (1, "z"): "orphan"}
    assert got[1, "x"].message == '{"arguments":{"a":1,"b":2.5},"content":"said \\"é\\"\\n","id":"x","name":"add","status":"answered"}'
    assert got[1, "x"].repeats == 1 and got[1, "x"].errors == []
    assert got[1, "y"].errors == ["type of a"] and got[2, "x"].errors == ["missing a", "no object"]
    assert all(list(json.loads(r.message)) == ["arguments", "content", "id", "name", "status"] for r in got.values())
    assert json.loads(got[1, "z"].message)["arguments"] is None and json.loads(got[2, "x"].message)["arguments"] == {"text": "not json"}


def test_schemas(spark):
    cases = {'{"a":1,"b":11}': ["most of b"], '{"a":1,"b":-1}': ["least of b"], '{"a":1.5}': ["type of a"], '{"a":1,"note":"x"}': ["least of note"], '{"a":1,"note":5}': ["type of note"], '{"a":1,"flag":true,"list":[1],"map":{"k":1}}': [], '{"a":null}': ["missing a"], "[1]": ["missing a", "no object"], '{"a":1,"flag":1,"list":{},"map":[]}': ["type of flag", "type of list", "type of map"]}
    got = run(spark, [(1, i, str(i), "add", text, None) for i, text in enumerate(cases)] + [(1, 99, "u", "other", "{}", None), (1, 98, "v", None, "{}", None)], [])
    assert [got[1, str(i)].errors for i in range(len(cases))] == list(cases.values())
    assert got[1, "u"].errors == ["unknown tool"] and got[1, "v"].errors == ["unknown tool"]


def order(spark, calls):
    got = run(spark, [(1, p, c, "add", "{}", after) for c, p, after in calls], [])
    return [c for _, c in sorted(got, key=lambda k: (got[k].at, got[k].depth, k))], {c for (_, c), r in got.items() if r.cyclic}


def test_order(spark):
    assert order(spark, [("a", 1, None), ("b", 2, ["a"]), ("c", 3, ["b", "gone", None])]) == (["a", "b", "c"], set())
    assert order(spark, [("a", 1, ["b"]), ("b", 2, ["c"]), ("c", 3, []), ("d", 4, ["a"])]) == (["c", "b", "a", "d"], set())
    assert order(spark, [("a", 5, ["b"]), ("b", 5, ["c"]), ("c", 5, [])]) == (["c", "b", "a"], set())
    found, cyclic = order(spark, [("a", 1, ["b"]), ("b", 2, ["a"]), ("c", 3, ["b"]), ("d", 4, ["d"]), ("e", 5, [])])
    assert cyclic == {"a", "b", "d"} and found == ["a", "b", "c", "d", "e"]
    found, cyclic = order(spark, [("a", 1, ["b"]), ("b", 2, ["c"]), ("c", 9, ["a"]), ("d", 3, ["c"]), ("e", 4, ["z"]), ("z", 8, [])])
    assert cyclic == {"a", "b", "c", "d"} and found.index("z") < found.index("e")


def test_order_as_brute_force_and_few_rounds(spark, monkeypatch):
    import random

    rounds = []
    whole = t._settled

    def counted(*args):
        before = len(cuts)
        out = whole(*args)
        rounds.append((len(cuts) - before) // 3)
        return out

    cuts = []
    cut = t.cut
    monkeypatch.setattr(t, "cut", lambda df, *a: cuts.append(1) or cut(df, *a))
    monkeypatch.setattr(t, "_settled", counted)
    n = 3000  # a conversation that stands backwards: each call waits for the one after it
    chain = [(1, i, f"c{i}", [f"c{i + 1}"] if i + 1 < n else None) for i in range(n)]
    rng = random.Random(7)
    many = [(2, rng.randrange(200), f"d{i}", [f"d{j}" for j in rng.sample(range(i), min(i, rng.choice([0, 1, 1, 3])))]) for i in range(120)]
    calls = spark.createDataFrame(chain + many, "conv_id long, pos long, call_id string, after array<string>")
    got = {(r.conv_id, r.call_id): (r.at, r.depth, r.cyclic) for r in t.in_order(calls).collect()}
    assert max(rounds) <= 30
    assert all(got[1, f"c{i}"] == (n - 1, n - 1 - i, False) for i in range(n))
    want = {}
    for _, pos, name, after in many:
        want[name] = max([(pos, 0), *((want[a][0], want[a][1] + 1) for a in after)])
    assert all(got[2, name][:2] == v for name, v in want.items())


def test_public_message_form_and_clashing_columns(spark):
    call = {"id": "k", "type": "function", "function": {"name": "add", "arguments": '{"a": 2}'}}
    rows = [(1, 1, "assistant", json.dumps({"tool_calls": [call]}), "x", 1), (1, 2, "tool", json.dumps({"tool_call_id": "k", "content": "2"}), "y", 2)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, status string, _args int")
    calls, results = t.from_messages(frame)
    got = t.link(calls.withColumn("least", calls.pos).withColumn("held", calls.pos), results.withColumn("status", results.pos), SCHEMAS).collect()
    assert [(r.call_id, r.status, r.errors) for r in got] == [("k", "answered", [])]


def test_messages_with_tools(spark):
    rows = [(1, 0, "user", "sum?"), (1, 1, "assistant", json.dumps({"tool_calls": [{"id": "k", "name": "add", "arguments": {"a": 2}}]})), (1, 2, "tool", json.dumps({"tool_call_id": "k", "content": "2"})), (1, 3, "assistant", "plain"), (1, 4, "assistant", None)]
    calls, results = t.from_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = t.link(calls, results, SCHEMAS).collect()
    assert [(r.call_id, r.status, r.errors, r.message) for r in got] == [("k", "answered", [], '{"arguments":{"a":2},"content":"2","id":"k","name":"add","status":"answered"}')]


def test_exchanges_and_empty(spark):
    rows = [(1, 0, "user", "hi there"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (1, 2, "user", None), (None, 0, "user", "x"), (2, 5, "assistant", "alone"), (2, 0, "system", "s")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    schema = {"reply": {"prompt": {"type": "string", "required": True, "least": 1}}}
    got = {r.call_id: (r.status, r.errors, r.repeats) for r in t.link(*t.from_exchanges(frame), schema).collect()}
    assert got == {"1:0": ("answered", [], 0), "1:2": ("unanswered", ["least of prompt"], 1), "2:4": ("orphan", [], 0)}
    assert t.link(*t.from_exchanges(frame.limit(0)), schema).count() == 0
