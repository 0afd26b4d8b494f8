"""Tool-call linking: calls and results joined by identifier, ordered by their dependencies, arguments validated.

Column expressions, joins and grouping only. Everything is a row per call, so that a conversation of any length is
spread over tasks; (level, turn) sorts the calls of a conversation topologically.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.session import scratch_path, settle

# (conv_id, call_id) as one struct: equal where both parts are, NULLs included, so it can be grouped and joined by.
KEY = "call"
REFERENCE = r"^\$(.+)$"
DIGITS = 38


def _outside(json: Column) -> Column:
    """The pieces of a JSON text between its quotes: those at even places, from 0, stand outside of strings.

    Escaped quotes and backslashes are first written as code points, so every quote left is one that delimits.
    """
    plain = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))
    return F.split(plain, '"', -1)


def _number(token: Column) -> Column:
    """A number as JSON prints it, in plain digits without needless zeros where 38 places hold it."""
    double = token.try_cast("double")
    exact = [token.try_cast(f"decimal(38,{scale})") for scale in (18, 0, 37)]
    fitting = F.coalesce(*[F.when(d.cast("double") == double, d.cast("string")) for d in exact], token)
    digits = F.when(token.contains("E"), fitting).otherwise(token)
    plain = F.when(digits.contains(".") & ~digits.contains("E"), F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))).otherwise(digits)
    return F.when(plain == "-0", "0").otherwise(plain)


def canonical_json(value: Column) -> Column:
    """A variant as JSON with sorted keys, no blanks, and one way to write each number (``1e0`` is ``1``)."""
    text = F.to_json(value)
    tokens = lambda x: F.regexp_extract_all(x, F.lit(r"-?[0-9][0-9.E+-]*|[^0-9-]+|-"), F.lit(0))
    numbers = lambda x: F.array_join(
        F.transform(tokens(x), lambda t: F.when(t.rlike("^-?[0-9]"), _number(t)).otherwise(t)), ""
    )
    rewritten = F.array_join(F.transform(_outside(text), lambda x, i: F.when(i % 2 == 0, numbers(x)).otherwise(x)), '"')
    restored = F.replace(F.replace(rewritten, F.lit("\\u0022"), F.lit('\\"')), F.lit("\\u005c"), F.lit("\\\\"))
    return F.when(text.rlike(r"[0-9]E|[0-9]\.[0-9]*0|-0"), restored).otherwise(text)


def overlong(json: Column) -> Column:
    """Whether a number of a JSON text is written with more digits than can be kept."""
    bare = F.array_join(F.filter(_outside(json), lambda x, i: i % 2 == 0), " ")
    many = F.replace(bare, F.lit("."), F.lit("")).rlike(f"[0-9]{{{DIGITS + 1}}}")
    return F.when(json.rlike(f"[0-9.]{{{DIGITS + 1}}}"), many).otherwise(F.lit(False))


def json_type(value: Column) -> Column:
    """The JSON type of a variant: string, integer, number, boolean, array, object or null. ``1.0`` is an integer."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | F.is_variant_null(value), "null")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "BIGINT", "integer")
        .when(
            kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"),
            F.when(canonical_json(value).rlike("^-?[0-9]+$"), "integer").otherwise("number"),
        )
        .when(kind.startswith("ARRAY"), "array")
        .otherwise("object")
    )


def members(calls: DataFrame) -> DataFrame:
    """(call, key, value, kind) for every argument; ``value`` is the text of a string, else NULL."""
    v = F.try_parse_json("arguments")
    objects = calls.select(KEY, v.alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    rows = objects.lateralJoin(calls.sparkSession.tvf.variant_explode(F.col("v").outer()))
    text = F.try_variant_get("value", "$", "string")
    return rows.select(KEY, "key", text.alias("value"), json_type(F.col("value")).alias("kind"))


def argument_errors(calls: DataFrame, given: DataFrame, schemas: DataFrame) -> DataFrame:
    """(call, errors): sorted texts, for calls whose arguments don't fit the schema of their tool.

    ``schemas`` has a row per (name, param, kind, required). An integer is a number too. A tool without a
    row in ``schemas`` is unknown; arguments that are no JSON object are one error.
    """
    objects = F.schema_of_variant(F.try_parse_json("arguments")).startswith("OBJECT")
    known = schemas.select("name").distinct().withColumn("known", F.lit(True))
    whole = calls.join(known, "name", "left").select(
        KEY,
        F.when(F.col("known").isNull(), "unknown tool")
        .when(~F.coalesce(objects, F.lit(False)), "no object")
        .when(overlong(F.col("arguments")), f"number of more than {DIGITS} digits")
        .alias("error"),
    )
    expected = calls.filter(objects).join(schemas, "name").select(
        KEY, F.col("param").alias("key"), F.col("kind").alias("wanted"), "required"
    )
    named = given.join(calls.join(known, "name", "left_semi").select(KEY), KEY, "left_semi")
    both = expected.join(named, [KEY, "key"], "full")
    fits = (F.col("kind") == F.col("wanted")) | ((F.col("kind") == "integer") & (F.col("wanted") == "number"))
    error = (
        F.when(F.col("kind").isNull(), F.when(F.col("required"), F.concat(F.lit("missing "), "key")))
        .when(F.col("wanted").isNull(), F.concat(F.lit("unexpected "), "key"))
        .when(~fits, F.concat("key", F.lit(" is "), "kind", F.lit(", not "), "wanted"))
    )
    errors = whole.union(both.select(KEY, error.alias("error"))).filter("error IS NOT NULL")
    return errors.groupBy(KEY).agg(F.sort_array(F.collect_set("error")).alias("errors"))


def chain_ends(single: DataFrame) -> DataFrame:
    """(call, to, dist): where the chain of calls that wait for one other call ends, and how many links away.

    ``single`` (call, to) has a row per such call. By pointer doubling: every round a pointer skips to where the call
    it points at points, so a chain of n links takes log2(n) rounds. Once a round leaves as many open as the one before,
    these are in a cycle or behind one, and get no row.
    """
    inner = single.select(F.col(KEY).alias("to"), F.lit(False).alias("ended"))
    hops = settle(
        single.join(inner, "to", "left").select(KEY, "to", F.lit(1).cast("long").alias("dist"), F.coalesce("ended", F.lit(True)).alias("ended"))
    )
    before = None
    while (left := hops.filter("NOT ended").count()) not in (0, before):
        before = left
        ahead = hops.select(F.col(KEY).alias("to"), F.col("to").alias("beyond"), F.col("dist").alias("more"), F.col("ended").alias("last"))
        skipped = hops.filter("NOT ended").drop("ended").join(ahead, "to")
        skipped = skipped.select(KEY, F.col("beyond").alias("to"), (F.col("dist") + F.col("more")).alias("dist"), F.col("last").alias("ended"))
        hops = settle(hops.filter("ended").union(skipped))
    return hops.filter("ended").drop("ended")


def _junction_levels(waits: DataFrame) -> DataFrame:
    """(call, level) of the calls that wait for several others, from ``waits`` (call, root, reach).

    ``reach`` is the level asked for so far, ``root`` the junction still waited for, NULL if there is none. A round
    places the calls with no root left and adds their levels where they were roots; there are as many rounds as the
    longest chain has junctions. All rounds are folders of one table.
    """
    spark = waits.sparkSession
    path, schema = scratch_path(spark), f"{KEY} {waits.schema[KEY].dataType.simpleString()}, level long"
    left, rounds = settle(waits), 0
    while True:
        ready = left.groupBy(KEY).agg(F.max("reach").alias("level"), F.count("root").alias("open")).filter("open = 0")
        part = f"{path}/round={rounds}"
        ready.select(KEY, "level").write.parquet(part)
        placed = spark.read.schema(schema).parquet(part)
        rounds += 1
        if placed.isEmpty():
            break
        of = placed.select(F.col(KEY).alias("root"), "level")
        rest = left.join(placed, KEY, "left_anti").join(of, "root", "left")
        known = F.col("level").isNotNull()
        left = settle(
            rest.select(
                KEY, F.when(~known, F.col("root")).alias("root"),
                (F.col("reach") + F.coalesce("level", F.lit(0))).alias("reach"),
            )
        )
    return spark.read.schema(schema).parquet(path).select(KEY, "level")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(call, level): 0 for calls that wait for none, else one more than the highest they wait for.

    ``edges`` (call, needs) name what a call waits for. Chains of calls that wait for one other are followed to their
    ends by pointer doubling; what is left is a graph of the calls that wait for several, placed in rounds. Calls in a
    cycle, or behind one, get no row.
    """
    edges = settle(edges.distinct())
    fan = settle(edges.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("to")))
    ends = chain_ends(fan.filter("n = 1").select(KEY, "to"))
    several = fan.filter("n > 1").select(KEY)
    free = nodes.join(fan.select(KEY), KEY, "left_anti").select(KEY, F.lit(0).cast("long").alias("level"))
    if several.isEmpty():
        return free.union(ends.select(KEY, F.col("dist").alias("level")))
    waits = edges.join(several, KEY, "left_semi").join(fan.select(F.col(KEY).alias("needs"), "n"), "needs", "left")
    via = ends.select(F.col(KEY).alias("needs"), "to", "dist")
    # A need in a cycle has no end: it is its own root, which is never placed.
    root = F.when(F.col("n") == 1, F.coalesce("to", "needs")).otherwise(F.col("needs"))
    waits = waits.join(via, "needs", "left").select(KEY, root.alias("root"), (F.coalesce("dist", F.lit(0)) + 1).alias("reach"))
    waits = waits.join(fan.select(F.col(KEY).alias("root"), F.lit(True).alias("waiting")), "root", "left")
    junctions = _junction_levels(waits.select(KEY, F.when(F.col("waiting"), F.col("root")).alias("root"), "reach"))
    at = several.join(junctions, KEY, "left").select(F.col(KEY).alias("to"), "level", F.lit(True).alias("junction"))
    level = F.when(F.col("junction"), F.col("level")).otherwise(0) + F.col("dist")
    chained = ends.join(at, "to", "left").select(KEY, level.alias("level")).filter("level IS NOT NULL")
    return free.union(junctions).union(chained)


def _common_type(a: str, b: str) -> str:
    """The type both ids are compared as: their own if it is one, long for whole numbers, else text."""
    if a == b:
        return a
    return "bigint" if {a, b} <= {"tinyint", "smallint", "int", "bigint"} else "string"


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call id and per result without a call, with status, errors, level and canonical JSON.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text). ``results``: conv_id, call_id, turn, content.
    Conversation ids may be of any type. A string argument ``$id`` waits for the result of that call of the conversation;
    ``n_unknown`` counts those that name no call. Of calls or results with the same id the first (by turn, then
    content) counts; n_calls and n_results tell how many there were. Calls and results with a NULL conversation or
    call id are never linked, nor waited for: they get one row for each pair of ids, calls and results apart, NULLs
    kept. status: ok, invalid (errors in ``errors``), unanswered, early (the result stands before its call),
    cyclic, orphan (no call). ``json`` has its keys in sorted order, no blanks, and one way to write each number; numbers in exponent
    form are doubles. Arguments that are no JSON, or hold a number of more than 38 digits, go in as ``text``.
    """
    kind = _common_type(dict(calls.dtypes)["conv_id"], dict(results.dtypes)["conv_id"])
    call = F.struct(F.col("conv_id").cast(kind).alias("conv_id"), F.col("call_id").cast("string").alias("call_id")).alias(KEY)
    linkable = F.col(f"{KEY}.conv_id").isNotNull() & F.col(f"{KEY}.call_id").isNotNull()
    turn = F.col("turn").cast("long").alias("turn")
    first = F.struct(F.col("turn").isNull(), "turn", "name", "arguments")
    one_call = settle(
        calls.select(call, turn, "name", "arguments")
        .groupBy(KEY)
        .agg(F.min(first).alias("c"), F.count(F.lit(1)).alias("n_calls"))
        .select(KEY, "c.turn", "c.name", "c.arguments", "n_calls")
    )
    answer = F.struct(F.col("turn").isNull(), "turn", "content")
    one_result = (
        results.select(call, turn, "content")
        .groupBy(KEY)
        .agg(F.min(answer).alias("r"), F.count(F.lit(1)).alias("n_results"))
        .select(KEY, F.col("r.turn").alias("result_turn"), "r.content", "n_results", linkable.alias("linkable"))
    )
    given = settle(members(one_call))
    named = F.regexp_extract("value", REFERENCE, 1)
    needs = F.struct(F.col(f"{KEY}.conv_id").alias("conv_id"), named.alias("call_id")).alias("needs")
    edges = given.filter(F.col(f"{KEY}.conv_id").isNotNull() & (named != "")).select(KEY, needs).distinct()
    exists = one_call.select(F.col(KEY).alias("needs"), F.lit(True).alias("exists"))
    edges = settle(edges.join(exists, "needs", "left").select(KEY, "needs", F.coalesce("exists", F.lit(False)).alias("exists")))
    unknown = edges.filter("NOT exists").groupBy(KEY).agg(F.count(F.lit(1)).alias("n_unknown"))
    placed = levels(one_call.select(KEY), edges.filter("exists").select(KEY, "needs"))
    described = (
        one_call.join(argument_errors(one_call, given, schemas), KEY, "left").join(placed, KEY, "left").join(unknown, KEY, "left")
    )
    linked = described.join(one_result.filter("linkable").drop("linkable"), KEY, "full")
    linked = linked.unionByName(one_result.filter("NOT linkable").drop("linkable"), allowMissingColumns=True)
    status = (
        F.when(F.col("n_calls").isNull(), "orphan")
        .when(F.col("level").isNull(), "cyclic")
        .when(F.col("errors").isNotNull(), "invalid")
        .when(F.col("n_results").isNull(), "unanswered")
        .when(F.col("result_turn") < F.col("turn"), "early")
        .otherwise("ok")
    )
    parsed = F.when(~overlong(F.col("arguments")), F.try_parse_json("arguments"))
    canonical = F.coalesce(canonical_json(parsed), F.to_json(F.struct(F.col("arguments").alias("text"))))
    quoted = lambda c: F.coalesce(
        F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit("")
    )
    value = lambda c: F.when(F.col(c).isNull(), "null").otherwise(quoted(c))
    json = F.concat(
        F.lit('{"arguments":'), F.when(F.col("arguments").isNull(), "null").otherwise(canonical),
        F.lit(',"call_id":'), value("call_id"), F.lit(',"name":'), value("name"),
        F.lit(',"result":'), value("content"), F.lit("}"),
    )
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return linked.select("*", f"{KEY}.*").select(
        "conv_id", "call_id", "level", "turn", "result_turn", count("n_calls"), count("n_results"), count("n_unknown"),
        status.alias("status"), F.array_join(F.coalesce("errors", F.array()), "; ").alias("errors"), json.alias("json"),
    )


def derived_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in plain conversations: a user's turn calls a tool, the assistant's next turn answers it.

    The tool and its arguments follow from the text alone; each call refers to the one two turns before. Some
    arguments are of the wrong type or missing, as the text's length has it.
    """
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    limit = F.when(n % 7 == 0, F.concat(F.lit('"'), (n % 10).cast("string"), F.lit('"'))).otherwise((n % 10).cast("string"))
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    after = F.when(F.col("turn") >= 2, F.concat(F.lit(',"after":"$c'), (F.col("turn") - 2).cast("string"), F.lit('"'))).otherwise("")
    body = F.when(n % 11 == 0, F.concat(F.lit('{"limit":'), limit, after, F.lit("}"))).otherwise(
        F.concat(F.lit('{"query":'), quoted, F.lit(', "limit":'), limit, after, F.lit("}"))
    )
    id_at = lambda t: F.concat(F.lit("c"), t.cast("string"))
    calls = conversations.filter("role = 'user'").select(
        "conv_id", id_at(F.col("turn")).alias("call_id"), "turn",
        F.when(n % 2 == 0, "search").otherwise("lookup").alias("name"), body.alias("arguments"),
    )
    results = conversations.filter("role = 'assistant'").select(
        "conv_id", id_at(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content")
    )
    return calls, results


def derived_schemas(calls: DataFrame) -> DataFrame:
    """Schemas of the two derived tools, one row per parameter."""
    rows = [
        (tool, param, kind, required)
        for tool in ("search", "lookup")
        for param, kind, required in (("query", "string", True), ("limit", "integer", True), ("after", "string", False))
    ]
    return calls.sparkSession.createDataFrame(rows, "name string, param string, kind string, required boolean")
