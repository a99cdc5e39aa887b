"""Chat formatting with tool-call linking, in DataFrame operations only.

Messages are rows (conv_id, turn, role, text, calls, result_for): ``calls`` are the tool calls a message makes, with their
arguments as JSON text, ``result_for`` is the identifier of the call a message answers. Calls and results are joined by
(conversation, identifier); messages are put into an order in which an answer follows its call and a call follows the answers its
arguments refer to ({"$ref": identifier}); arguments are checked against the tool's schema; each message becomes one
line of canonical JSON (sorted keys, no spaces, nulls left out).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wxspark.llm.common import ordered_positions
from wxspark.session import cut, stored

CALLS = "array<struct<id:string,name:string,arguments:string>>"
#: Field: (type, required, smallest, largest); types: string, integer, boolean.
Schema = dict[str, tuple[str, bool, int | None, int | None]]


def _on(pairs: list[tuple[str, str]]) -> Column:
    same = F.lit(True)
    for a, b in pairs:
        same = same & F.col(a).eqNullSafe(F.col(b))
    return same


def errors(name: str, arguments: str, schemas: dict[str, Schema]) -> Column:
    """Sorted array of what is wrong with ``arguments`` (a JSON text) of a call to ``name``; empty if nothing is."""
    value = F.try_parse_json(F.col(arguments))
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    checks = F.lit(None).cast("array<string>")
    spoken = {"string": ["STRING"], "integer": ["BIGINT"], "boolean": ["BOOLEAN"]}
    for tool, schema in schemas.items():
        wrong = [F.transform(F.array_except(keys, F.array(*[F.lit(k) for k in schema])), lambda k: F.concat(F.lit("unknown:"), k))]
        for field, (kind, required, low, high) in schema.items():
            there = F.array_contains(keys, field)
            part = F.variant_get(value, f"$['{field}']", "variant")
            typed = F.coalesce(F.schema_of_variant(part).isin(spoken[kind]), F.lit(False))
            found = F.when(there & ~typed, F.array(F.lit(f"type:{field}"))).otherwise(F.array().cast("array<string>"))
            if required:
                found = F.when(~there, F.array(F.lit(f"missing:{field}"))).otherwise(found)
            if low is not None or high is not None:
                size = F.try_variant_get(value, f"$['{field}']", "bigint" if kind == "integer" else "string")
                size = size if kind == "integer" else F.length(size)
                off = (size < low if low is not None else F.lit(False)) | (size > high if high is not None else F.lit(False))
                found = F.when(there & typed & off, F.array(F.lit(f"range:{field}"))).otherwise(found)
            wrong.append(found)
        checks = F.when(F.col(name) == tool, F.array_sort(F.concat(*wrong))).otherwise(checks)
    unreadable = value.isNull() | (F.substring(F.ltrim(arguments), 1, 1) != "{")
    return F.when(unreadable, F.array(F.lit("arguments"))).otherwise(F.coalesce(checks, F.array(F.lit("tool"))))


def _settled(nodes: DataFrame, edges: DataFrame, same_moment: bool) -> DataFrame:
    """Relax (moment, depth) along ``edges`` (conv, parent, child) until nothing changes; only changed messages go on.

    First the moment: the largest turn among a message and all it depends on. Then, among messages of one moment, the depth:
    how many dependencies deep a message is, at most the number of such messages, which only those on or behind a cycle
    reach. Dependencies that the turns already respect need no round.
    """
    current = nodes
    while True:
        parents = current.select(F.col("conv").alias("_pc"), F.col("node").alias("_pn"), F.col("moment").alias("_pm"), F.col("depth").alias("_pd"))
        reached = edges.join(parents, _on([("e_conv", "_pc"), ("parent", "_pn")])).groupBy("e_conv", "child")
        if not same_moment:
            incoming = reached.agg(F.max("_pm").alias("_in"))
            joined = current.join(incoming, _on([("conv", "e_conv"), ("node", "child")]), "left")
            after = joined.select("conv", "node", F.greatest("moment", F.coalesce("_in", "moment")).alias("moment"), "depth", "most", (F.coalesce(F.col("_in") > F.col("moment"), F.lit(False))).alias("changed"))
        else:
            deepest = edges.join(parents, _on([("e_conv", "_pc"), ("parent", "_pn")])).groupBy("e_conv", "child", "_pm").agg((F.max("_pd") + 1).alias("_in"))
            joined = current.join(deepest, _on([("conv", "e_conv"), ("node", "child"), ("moment", "_pm")]), "left")
            deeper = F.least(F.greatest("depth", F.coalesce("_in", "depth")), "most")
            after = joined.select("conv", "node", "moment", deeper.alias("depth"), "most", (deeper > F.col("depth")).alias("changed"))
        after = cut(after)
        current = after.drop("changed")
        if after.where("changed").isEmpty():
            return current


def link(messages: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """conv_id, turn, position, role, n_calls, n_valid, status and json of every message.

    Status: ``message``; ``call`` if every call of the message has an answer, ``pending`` if one has none, ``reused`` if one
    repeats an identifier of an earlier call; ``result``, ``repeated_result`` (the call has an earlier answer) or ``orphan``;
    ``cycle`` if the message depends on itself. Positions count from 0 per conversation: by the moment all dependencies are there, then
    their depth, then turn, role and text; messages of a cycle come last in their moment. Rows repeated in full are
    kept and stand next to each other; null conversations and turns are values of their own, null texts and roles are left out of the JSON. Other columns
    are ignored. An empty table gives an empty one.
    """
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.col("calls").cast(CALLS).alias("calls"), "result_for")
    rows = stored(rows, "messages")
    calls = rows.select("conv_id", "turn", F.posexplode("calls").alias("nth", "call")).select("conv_id", "turn", "nth", "call.*")
    owners = calls.where("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "nth")).alias("own"))
    answers = rows.where("result_for is not null").groupBy("conv_id", F.col("result_for").alias("id")).agg(F.min("turn").alias("answer"))
    o, a = owners.alias("o"), answers.alias("a")
    tied = o.join(a, F.col("o.conv_id").eqNullSafe(F.col("a.conv_id")) & (F.col("o.id") == F.col("a.id")), "left")
    tied = stored(tied.select(F.col("o.conv_id").alias("l_conv"), F.col("o.id").alias("l_id"), F.col("own.turn").alias("l_turn"), F.col("own.nth").alias("l_nth"), "answer"), "links")

    # Dependencies between turns of a conversation: call before answer, answer before the calls that refer to it.
    first = tied.where("answer is not null").select(F.col("l_conv").alias("e_conv"), F.col("l_turn").alias("parent"), F.col("answer").alias("child"))
    refs = calls.select("conv_id", "turn", F.explode(F.regexp_extract_all("arguments", F.lit(r'"\$ref"\s*:\s*"([^"\\]+)"'), F.lit(1))).alias("ref"))
    second = refs.join(tied, F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col("ref") == F.col("l_id"))).where("answer is not null")
    edges = first.union(second.select("conv_id", F.col("answer"), F.col("turn"))).distinct()
    edges = stored(edges.where(~F.col("parent").eqNullSafe(F.col("child"))), "edges")
    ends = edges.select(F.col("e_conv").alias("conv"), F.col("parent").alias("node")).union(edges.select("e_conv", "child")).distinct()
    nodes = cut(ends.select("conv", "node", F.col("node").alias("moment"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("most")))
    nodes = _settled(nodes, edges, False)
    sizes = nodes.groupBy(F.col("conv").alias("_c"), F.col("moment").alias("_m")).agg(F.count("*").alias("_n"))
    nodes = cut(nodes.join(sizes, _on([("conv", "_c"), ("moment", "_m")])).select("conv", "node", "moment", "depth", F.col("_n").alias("most")))
    nodes = _settled(nodes, edges, True)

    checked = calls.withColumn("errors", errors("name", "arguments", schemas)).join(tied, F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col("id") == F.col("l_id")), "left")
    owns = F.coalesce((F.col("l_turn").eqNullSafe(F.col("turn"))) & (F.col("l_nth") == F.col("nth")) & F.col("l_id").isNotNull(), F.lit(False))
    state = F.when(F.col("id").isNull(), "pending").when(~owns, "reused").when(F.col("answer").isNull(), "pending").otherwise("call")
    one = F.struct("nth", "id", "name", "arguments", "errors", state.alias("state"))
    per_message = checked.groupBy(F.col("conv_id").alias("m_conv"), F.col("turn").alias("m_turn")).agg(F.array_sort(F.collect_set(one)).alias("made"))

    full = rows.join(per_message, _on([("conv_id", "m_conv"), ("turn", "m_turn")]), "left")
    tied_result = tied.select(F.col("l_conv").alias("r_conv"), F.col("l_id").alias("r_id"), F.col("answer").alias("r_answer"))
    full = full.join(tied_result, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("result_for") == F.col("r_id")), "left")
    full = full.join(nodes, _on([("conv_id", "conv"), ("turn", "node")]), "left")
    # Rows of one turn share what was collected for it; each keeps the calls it makes itself.
    own = F.filter("made", lambda m: F.exists("calls", lambda c: c["id"].eqNullSafe(m["id"]) & c["name"].eqNullSafe(m["name"]) & c["arguments"].eqNullSafe(m["arguments"])))
    full = full.withColumn("made", F.when(F.size("calls") > 0, own))
    states = F.col("made.state")
    status = (
        F.when(F.coalesce(F.col("depth") >= F.col("most"), F.lit(False)), "cycle")
        .when(F.size("made") > 0, F.when(F.array_contains(states, "reused"), "reused").when(F.array_contains(states, "pending"), "pending").otherwise("call"))
        .when(F.col("result_for").isNull(), "message")
        .when(F.col("r_id").isNull(), "orphan")
        .when(F.col("r_answer").eqNullSafe(F.col("turn")), "result")
        .otherwise("repeated_result")
    )
    full = full.select(
        "conv_id", "turn", "role", "text", "result_for", "made", status.alias("status"), F.coalesce("moment", "turn").alias("moment"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
        F.coalesce(F.size("made"), F.lit(0)).cast("long").alias("n_made"),
    )
    placed = ordered_positions(full, ["conv_id"], ["moment", "depth", "turn", "role", "text"])
    return placed.select(
        "conv_id", "turn", "position", "role", F.greatest("n_made", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce(F.size(F.filter("made", lambda m: F.size(m["errors"]) == 0)), F.lit(0)).cast("long").alias("n_valid"), "status", canonical().alias("json"),
    )


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("s"))), r"(?s)^\{\"s\":(.*)\}$", 1)


def canonical() -> Column:
    """One message as canonical JSON; arguments that are no JSON stay a string."""
    def call(m: Column) -> Column:
        arguments = F.coalesce(F.to_json(F.try_parse_json(m["arguments"])), _quoted(m["arguments"]))
        fields = [("arguments", F.when(m["arguments"].isNotNull(), arguments)), ("id", F.when(m["id"].isNotNull(), _quoted(m["id"]))), ("name", F.when(m["name"].isNotNull(), _quoted(m["name"])))]
        return _object(fields)

    made = F.when(F.size("made") > 0, F.concat(F.lit("["), F.array_join(F.transform("made", call), ","), F.lit("]")))
    text, role, result = F.col("text"), F.col("role"), F.col("result_for")
    return _object([
        ("content", F.when(text.isNotNull(), _quoted(text))), ("role", F.when(role.isNotNull(), _quoted(role))),
        ("tool_call_id", F.when(result.isNotNull(), _quoted(result))), ("tool_calls", made),
    ])


def _object(fields: list[tuple[str, Column]]) -> Column:
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


#: Tools of the derived messages below.
TOOLS: dict[str, Schema] = {
    "search": {"query": ("string", True, 1, 12), "limit": ("integer", True, 1, 50)},
    "lookup": {"id": ("integer", True, 0, None), "fresh": ("boolean", False, None, None)},
    "note": {"text": ("string", True, 1, None)},
}


def tool_turns(conversations: DataFrame) -> DataFrame:
    """Messages with tool calls derived from every turn of ``conversations`` (conv_id, turn, role, text).

    An assistant turn makes one call, a second one if its text has an even length; the second refers to the first call of the
    assistant turn before. A user turn answers the first call of the turn before it, in every third conversation that of the turn after it,
    so answers come too early there. Tool and arguments follow from the text and its length.
    """
    n = F.length("text")
    name = lambda c, t, k: F.concat(F.lit("c"), c.cast("string"), F.lit("-"), t.cast("string"), F.lit(f"-{k}"))
    word = F.regexp_extract("text", r"^([A-Za-z]*)", 1)
    search = F.to_json(F.struct(word.alias("query"), (n % 60).alias("limit")))
    lookup = F.to_json(F.struct(n.alias("id"), (n % 4 == 3).alias("fresh")))
    bare = F.to_json(F.struct(n.alias("size")))
    first = F.struct(
        name(F.col("conv_id"), F.col("turn"), 0).alias("id"),
        F.when(n % 3 == 0, "search").when(n % 3 == 1, "lookup").otherwise("note").alias("name"),
        F.when(n % 3 == 0, search).when(n % 3 == 1, lookup).otherwise(bare).alias("arguments"),
    )
    ref = name(F.col("conv_id"), F.col("turn") - 2, 0)
    second = F.struct(
        name(F.col("conv_id"), F.col("turn"), 1).alias("id"), F.lit("note").alias("name"), F.concat(F.lit('{"text": {"$ref": "'), ref, F.lit('"}}')).alias("arguments")
    )
    calls = F.when(F.col("role") == "assistant", F.when(n % 2 == 0, F.array(first, second)).otherwise(F.array(first)))
    asked = F.when(F.col("conv_id") % 3 == 0, F.col("turn") + 1).otherwise(F.col("turn") - 1)
    answers = F.when((F.col("role") == "user") & (asked >= 0), name(F.col("conv_id"), asked, 0))
    return conversations.select("conv_id", "turn", F.when(answers.isNotNull(), "tool").otherwise(F.col("role")).alias("role"), "text", calls.cast(CALLS).alias("calls"), answers.alias("result_for"))


def report(conversations: DataFrame) -> DataFrame:
    return link(tool_turns(conversations), TOOLS)
