import json
import random

from fieldloom.llm import tool_calls as L

CALLS = "conv_id bigint, turn bigint, call_id string, name string, arguments string, parent string, depth int"
RESULTS = "conv_id bigint, turn bigint, call_id string, content string, status string"
SCHEMAS = "name string, param string, type string, required boolean"
SPEC = [("add", "a", "number", True), ("add", "b", "integer", True), ("add", "note", "string", False), ("add", "tags", "array", False), ("add", "o", "object", False), ("add", "f", "boolean", False)]


def link(spark, calls, results, schemas=SPEC):
    frame = lambda rows, schema: spark.createDataFrame([(*r, *[None] * (schema.count(",") + 1 - len(r))) for r in rows], schema)
    return L.link_tool_calls(frame(calls, CALLS), frame(results, RESULTS), frame(schemas, SCHEMAS)).collect()


def test_links_validation_and_canonical_json(spark):
    calls = [
        (1, 0, "x", "add", '{"b": 2,  "a": 1.5}', None),
        (1, 2, "y", "add", '{"a":"1","z":null,"tags":[1],"o":{"q":1,"b":2},"f":true}', "x"),
        (1, 4, "z", "nope", "{}", "y"),
        (1, 5, "w", "add", "[1]", "gone"),
        (2, 0, "x", "add", None, "x"),
        (2, 1, None, "add", "{}", None),
        (None, 0, "n", "add", '{"a":1,"b":2}', None),
    ]
    results = [(1, 1, "x", 'say "ü"\n'), (1, 1, "y", "too early"), (3, 0, "x", "orphan"), (None, 3, "n", "null conversation"), (2, 9, None, "no id")]
    got = {(r.conv_id, r.call_id, r.status): r for r in link(spark, calls, results)}
    x = got[1, "x", "linked"]
    assert x.errors == [] and x.depth == 0
    assert x.record == '{"arguments":{"a":1.5,"b":2},"id":"x","name":"add","result":"say \\"ü\\"\\n","status":"linked"}'
    y = got[1, "y", "early"]
    assert y.errors == ["missing:b", "type:a", "unknown:z"] and y.depth == 1
    assert json.loads(y.record)["arguments"] == {"a": "1", "f": True, "o": {"b": 2, "q": 1}, "tags": [1], "z": None}
    assert got[1, "z", "pending"].errors == ["unknown tool"] and got[1, "z", "pending"].depth == 2
    assert got[1, "w", "pending"].errors == ["invalid json"] and got[1, "w", "pending"].depth == 0
    assert got[2, "x", "pending"].depth is None  # its own parent
    assert got[3, "x", "orphan"].n_results == 1 and got[None, "n", "linked"].errors == []
    assert got[2, None, "pending"].n_calls == 1 and got[2, None, "orphan"].n_results == 1
    assert len(got) == 9


def test_repeated_identifiers_are_merged(spark):
    calls = [(1, t % 3, "x", "add", '{"a":1,"b":2}', None) for t in range(50)]
    results = [(1, 5, "x", str(t)) for t in range(40)]
    (row,) = link(spark, calls, results)
    assert (row.n_calls, row.n_results, row.turn, row.status) == (50, 40, 0, "linked") and json.loads(row.record)["result"] == "0"


def test_depths_match_brute_force(spark):
    rng = random.Random(4)
    parents = {f"c{k}": rng.choice([None, f"c{rng.randrange(80)}", f"c{max(0, k - 1)}" if k else None]) for k in range(80)}
    parents |= {f"d{k}": f"d{k - 1}" if k else None for k in range(100)}

    def depth(k):
        seen, n = set(), 0
        while parents.get(k) is not None:
            if k in seen:
                return None
            seen.add(k)
            k, n = parents[k], n + 1
        return n

    calls = spark.createDataFrame([(1, k, p) for k, p in parents.items()], "conv_id bigint, call_id string, parent string")
    assert {r.call_id: r.depth for r in L.call_depths(calls).collect()} == {k: depth(k) for k in parents}


def test_conversations(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "user", "hi"), (1, 2, "assistant", "ho"), (1, 3, "user", None), (2, 0, "assistant", "first"), (2, 1, None, "x"), (3, None, "user", "?")]
    rows += [(4, 0, "assistant", '{"id":"k1","name":"add","arguments":{"b":1,"a":2}}'), (4, 1, "tool", '{"call_id":"k1","content":"3"}'), (4, 2, "user", "{not json")]
    m = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, call_id int")
    calls, results = L.conversation_calls(m)
    schemas = L.conversation_schemas(spark).union(spark.createDataFrame(SPEC, SCHEMAS))
    got = {(r.conv_id, r.call_id): r for r in L.link_tool_calls(calls, results, schemas).collect()}
    assert got[1, "c1-1"].status == "linked" and got[1, "c1-3"].depth == 1 and got[1, "c1-3"].status == "pending"
    assert got[2, "c2--1"].status == "orphan"
    assert got[4, "k1"].record == '{"arguments":{"a":2,"b":1},"id":"k1","name":"add","result":"3","status":"linked"}'
    assert all(not r.errors for r in got.values() if r.name and r.turn is not None)
    assert len(got) == 7
    empty = L.conversation_calls(m.limit(0))
    assert L.link_tool_calls(*empty, schemas).count() == 0


def test_no_row_is_lost(spark, tmp_path):
    """Messages without conversation, of other roles and of tools that name no call; several results."""
    from fieldloom.llm.queries import op1_tool_call_linking

    rows = [(None, 1, "user", "a"), (None, 1, "user", "b"), (None, 1, "system", "c"), (None, 2, "assistant", "d"), (None, 2, "assistant", "e")]
    rows += [(1, 0, None, "f"), (1, 1, "developer", "g"), (1, 2, "tool", "plain h"), (1, 3, "tool", '{"x":1}'), (1, 4, None, None)]
    rows += [(2, 0, "assistant", '{"id":"k","name":"add"}'), (2, 1, "tool", '{"call_id":"k","content":"i"}'), (2, 2, "tool", '{"call_id":"k","content":"j"}')]
    rows += [(2, 3, "assistant", '{"id":"k","name":"sub"}')]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = op1_tool_call_linking(spark, str(tmp_path)).collect()
    records = [(r.conv_id, r.status, json.loads(r.record)) for r in got]
    assert sorted(x["arguments"].get("prompt", x["arguments"].get("instructions")) for c, s, x in records if s == "pending" and c is None) == ["a", "b", "c"]
    assert {x["result"] for c, s, x in records if s == "orphan"} == {"d", "e", "plain h", '{"x":1}'}
    assert {(x.get("role"), x["content"]) for c, s, x in records if s == "other"} == {(None, "f"), ("developer", "g"), (None, "")}
    (k,) = [x for c, s, x in records if c == 2]
    assert k["result"] == "i" and k["results"] == ["i", "j"] and [c["name"] for c in k["calls"]] == ["add", "sub"]
    assert len(got) == 11


def test_native_plan(spark):
    m = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    plan = L.link_tool_calls(*L.conversation_calls(m), L.conversation_schemas(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_order_keys_are_topological_and_whole_numbers_are_integers(spark):
    rng = random.Random(9)
    calls = [(1, rng.randrange(50), f"k{k}", "add", '{"a":1,"b":2.0}' if k % 2 else '{"a":1,"b":2.5}', f"k{rng.randrange(k)}" if k and rng.random() < 0.8 else None) for k in range(60)]
    rows = link(spark, calls, [(1, 3, "lost", "x")])
    order = [r.call_id for r in sorted(rows, key=lambda r: r.order_key)]
    place = {c: n for n, c in enumerate(order)}
    assert order[-1] == "lost" and all(place[c[5]] < place[c[2]] for c in calls if c[5])
    assert all(r.errors == ([] if int(r.call_id[1:]) % 2 else ["type:b"]) for r in rows if r.call_id != "lost")


def test_very_long_arguments_and_results(spark):
    text = "é" * 1_000_000
    (row,) = link(spark, [(1, 0, "x", "add", json.dumps({"a": 1, "b": 2, "note": text}), None)], [(1, 1, "x", text)])
    found = json.loads(row.record)
    assert row.errors == [] and found["result"] == text and found["arguments"]["note"] == text
