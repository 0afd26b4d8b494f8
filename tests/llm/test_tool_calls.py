import json
import random

import pytest
from pyspark.sql import functions as F

from samplewright.llm import queries, tool_calls

SF_DIR = "/root/testdata/sf0.001"

CALLS = "conv_id long, call_id string, turn long, name string, arguments string"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = [("f", "a", "string", True), ("f", "b", "number", False), ("g", "a", "array", True)]


def link_rows(spark, calls, results, schemas=SCHEMAS):
    return tool_calls.link_calls(
        spark.createDataFrame(calls, CALLS),
        spark.createDataFrame(results, RESULTS),
        spark.createDataFrame(schemas, "name string, param string, kind string, required boolean"),
    ).collect()


def link(*args):
    return {(r.conv_id, r.call_id): r for r in link_rows(*args)}


def test_statuses_and_errors(spark):
    got = link(
        spark,
        [
            (1, "ok", 0, "f", '{"b": 2.5, "a": "x"}'),
            (1, "int", 1, "f", '{"a": "x", "b": 2}'),
            (1, "missing", 2, "f", '{"c": null}'),
            (1, "kind", 3, "g", '{"a": {"z": 1, "y": [1, "q"]}}'),
            (1, "text", 4, "f", "no json"),
            (1, "list", 5, "f", "[1]"),
            (1, "tool", 6, "h", "{}"),
            (1, "open", 7, "f", '{"a": ""}'),
            (1, "late", 8, "f", '{"a": ""}'),
            (1, "null", 9, None, None),
        ],
        [(1, c, 20, "r") for c in ("ok", "int", "missing", "kind", "text", "list", "tool", "null", "nobody")] + [(1, "late", 3, None)],
    )
    status = {k[1]: (r.status, r.errors) for k, r in got.items()}
    assert status == {
        "ok": ("ok", ""), "int": ("ok", ""), "open": ("unanswered", ""), "late": ("early", ""), "nobody": ("orphan", ""),
        "missing": ("invalid", "missing a; unexpected c"), "kind": ("invalid", "a is object, not array"),
        "text": ("invalid", "no object"), "list": ("invalid", "no object"), "tool": ("invalid", "unknown tool"),
        "null": ("invalid", "unknown tool"),
    }
    assert got[1, "ok"].json == '{"arguments":{"a":"x","b":2.5},"call_id":"ok","name":"f","result":"r"}'
    assert '"arguments":{"a":{"y":[1,"q"],"z":1}}' in got[1, "kind"].json
    assert all(json.loads(r.json) is not None for r in got.values())


def test_topological_levels_and_cycles(spark):
    needs = {"a": [], "b": ["a"], "c": ["b", "a"], "d": ["x"], "x": ["d"], "e": ["x"], "s": ["s"], "u": ["unknown"], "v": ["c", "u"]}
    calls = [(1, k, i, "f", json.dumps({f"k{n}": f"${p}" for n, p in enumerate(v)})) for i, (k, v) in enumerate(needs.items())]
    calls += [(2, "b", 0, "f", '{"a": "$a"}')]
    got = link(spark, calls, [])
    levels = {k[1]: r.level for k, r in got.items() if k[0] == 1}
    assert levels == {"a": 0, "b": 1, "c": 2, "d": None, "x": None, "e": None, "s": None, "u": 0, "v": 3}
    assert {k for k, r in got.items() if r.status == "cyclic"} == {(1, c) for c in "dxes"}
    assert got[2, "b"].level == 0


def test_repeated_and_null_rows(spark):
    calls = [(1, "a", 5, "f", '{"a":"late"}'), (1, "a", 2, "f", '{"a":"q\\"uote"}'), (1, "a", None, "f", "{}"), (None, None, None, None, None)]
    results = [(1, "a", 9, "two"), (1, "a", 7, "one\né"), (None, None, None, None), (None, "z", 1, "c")]
    rows = link_rows(spark, calls, results)
    got = {(r.conv_id, r.call_id): r for r in rows}
    a = got[1, "a"]
    assert (a.turn, a.result_turn, a.n_calls, a.n_results, a.status) == (2, 7, 3, 2, "ok")
    assert json.loads(a.json) == {"arguments": {"a": 'q"uote'}, "call_id": "a", "name": "f", "result": "one\né"}
    assert sorted(r.status for r in rows if r.conv_id is None and r.call_id is None) == ["invalid", "orphan"]
    assert got[None, "z"].status == "orphan"
    assert link(spark, [], []) == {}


def test_null_minus_one_and_empty_ids_stay_apart(spark):
    ids = [(c, k) for c in (None, -1, 1) for k in (None, "", "a")]
    calls = [(c, k, 1, "f", '{"a":"$a"}') for c, k in ids]
    got = tool_calls.link_calls(
        spark.createDataFrame(calls, CALLS),
        spark.createDataFrame([(c, k, 2, "r") for c, k in ids], RESULTS),
        spark.createDataFrame(SCHEMAS, "name string, param string, kind string, required boolean"),
    ).collect()
    linked = {(c, k) for c, k in ids if c is not None and k is not None}
    want = {}
    for c, k in ids:
        if (c, k) in linked:
            want[c, k, 1] = (1, 1, "cyclic")
        else:
            # a NULL call id still waits for the call it names; a NULL conversation names none
            want[c, k, 1] = (1, 0, "cyclic" if c is not None else "unanswered")
            want[c, k, None] = (0, 1, "orphan")
    assert {(r.conv_id, r.call_id, r.turn): (r.n_calls, r.n_results, r.status) for r in got} == want
    assert len(got) == len(want)


def test_conversation_ids_of_any_type(spark):
    calls = spark.createDataFrame([("x", "a", 1, "f", '{"a":"$gone","b":1}'), ("", "a", 1, "f", '{"a":"q"}')], CALLS.replace("conv_id long", "conv_id string"))
    results = spark.createDataFrame([("x", "a", 2, "r"), ("", "a", 3, "s")], RESULTS.replace("conv_id long", "conv_id string"))
    schemas = spark.createDataFrame(SCHEMAS, "name string, param string, kind string, required boolean")
    got = {r.conv_id: r for r in tool_calls.link_calls(calls, results, schemas).collect()}
    assert {k: (r.status, r.result_turn, r.n_unknown) for k, r in got.items()} == {"x": ("ok", 2, 1), "": ("ok", 3, 0)}
    mixed = tool_calls.link_calls(calls.selectExpr("7 AS conv_id", "* EXCEPT (conv_id)"), results.selectExpr("7L AS conv_id", "* EXCEPT (conv_id)"), schemas)
    assert [(r.conv_id, r.status) for r in mixed.collect()] == [(7, "ok")]


def test_numbers_have_one_form(spark):
    forms = {
        "1": ["1", "1.0", "1.00", "1e0", "100e-2", "0.01E2", "10e-1"],
        "0": ["0", "-0", "0.0", "-0.0", "0e5"],
        "0.1": ["0.1", "0.10", "1e-1"],
        "0.0000001": ["0.0000001", "1e-7", "1E-7"],
        "12345678.9": ["12345678.9", "1.23456789e7", "123456789e-1"],
        "100000000000000000000": ["100000000000000000000", "1e20"],
        "12345678901234567890123456789012345678": ["12345678901234567890123456789012345678"],
        "[1,-2.5,3]": ["[1.0, -2.50, 3e0]", "[1,-25e-1,3]"],
        r'{"x":"a\\\"1.0\\","y":1}': [r'{"y":1e0,"x":"a\\\"1.0\\"}'],
        r'["\" 1e0",1]': [r'["\u0022 1e0", 1e0]'],
        r'["\\u0022 1e0",1]': [r'["\\u0022 1e0",1e0]'],
    }
    rows = [(want, text) for want, texts in forms.items() for text in texts]
    df = spark.createDataFrame(rows, "want string, text string")
    out = df.select("*", tool_calls.canonical_json(F.try_parse_json("text")).alias("got")).collect()
    assert [(r.text, r.got) for r in out] == [(r.text, r.want) for r in out]
    assert all(json.loads(r.got) == json.loads(r.text) for r in out)


def test_whole_numbers_are_integers_and_overlong_ones_refused(spark):
    schemas = [("f", "a", "integer", True)]
    args = {"1.0": "ok", "1e0": "ok", "7": "ok", "1.5": "invalid", "9" * 38: "ok", "9" * 41: "invalid"}
    calls = [(1, k, 0, "f", f'{{"a": {k}}}') for k in args] + [(1, "s", 0, "f", '{"a": 1, "b": "%s"}' % ("9" * 50))]
    got = {k[1]: r for k, r in link(spark, calls, [(1, k, 1, "r") for k in args], schemas).items()}
    assert {k: got[k].status for k in args} == args
    assert got["9" * 41].errors.endswith("number of more than 38 digits") and "9" * 41 in got["9" * 41].json
    assert got["s"].errors == "unexpected b"


def test_long_chain(spark):
    calls = [(1, f"c{i}", i, "f", json.dumps({"a": f"$c{i - 1}"})) for i in range(7)]
    got = link(spark, calls, [])
    assert [got[1, f"c{i}"].level for i in range(7)] == list(range(7))


def test_chains_take_logarithmic_rounds(spark, monkeypatch):
    n, rounds = 3000, []
    monkeypatch.setattr(tool_calls, "settle", lambda df, real=tool_calls.settle: rounds.append(1) or real(df))
    single = spark.range(1, n).selectExpr("struct(1L AS conv_id, concat('c', id) AS call_id) AS call", "struct(1L AS conv_id, concat('c', id - 1) AS call_id) AS to")
    ends = tool_calls.chain_ends(single).selectExpr("call.call_id AS c", "to.call_id AS t", "dist").collect()
    assert {(r.c, r.t, r.dist) for r in ends} == {(f"c{i}", "c0", i) for i in range(1, n)}
    assert len(rounds) <= 14


@pytest.mark.parametrize("seed", range(3))
def test_levels_against_plain_python(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(60)]
    needs = {}
    for i, name in enumerate(names):
        pool = names[:i] if rng.random() < 0.97 else names
        needs[name] = set(rng.sample(pool, min(len(pool), rng.choice([0, 1, 1, 1, 1, 2, 3]))))
    level = {}
    for _ in names:
        level |= {k: max((level[p] + 1 for p in v), default=0) for k, v in needs.items() if k not in level and all(p in level for p in v)}
    struct = "struct(1L AS conv_id, {} AS call_id) AS {}"
    nodes = spark.createDataFrame([(k,) for k in names], "a string").selectExpr(struct.format("a", "call"))
    edges = spark.createDataFrame([(k, p) for k, v in needs.items() for p in v], "a string, b string")
    got = tool_calls.levels(nodes, edges.selectExpr(struct.format("a", "call"), struct.format("b", "needs")))
    rows = [(r.c, r.level) for r in got.selectExpr("call.call_id AS c", "level").collect()]
    assert len(rows) == len(set(rows)) and dict(rows) == level


def test_query_against_plain_python(spark):
    turns = [r.asDict() for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()]
    want = {}
    for t in turns:
        if t["role"] != "user":
            continue
        text, n, at = t["text"] or "", len(t["text"] or ""), t["turn"]
        args = {"limit": str(n % 10) if n % 7 == 0 else n % 10}
        errors = ["limit is string, not integer"] * (n % 7 == 0) + ["missing query"] * (n % 11 == 0)
        if n % 11:
            args["query"] = text
        if at >= 2:
            args["after"] = f"$c{at - 2}"
        want[t["conv_id"], f"c{at}"] = {"args": args, "errors": "; ".join(errors), "turn": at, "level": 0}
    for (conv, call), w in sorted(want.items(), key=lambda x: x[1]["turn"]):
        before = want.get((conv, w["args"].get("after", "").lstrip("$")))
        w["level"] = before["level"] + 1 if before else 0
    answers = {(t["conv_id"], f"c{t['turn'] - 1}"): t["text"] for t in turns if t["role"] == "assistant"}
    got = {(r.conv_id, r.call_id): r for r in queries.op2_tool_calls(spark, SF_DIR).collect()}
    assert set(got) == set(want) | set(answers)
    for k, r in got.items():
        body = json.loads(r.json)
        if k not in want:
            assert r.status == "orphan" and body["result"] == answers[k]
            continue
        w = want[k]
        assert (r.level, r.errors, body["arguments"], body["result"]) == (w["level"], w["errors"], w["args"], answers.get(k))
        assert r.json == json.dumps(body, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        assert r.status == ("invalid" if w["errors"] else "ok" if k in answers else "unanswered")
