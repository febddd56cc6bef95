"""Chat formatting with linked tool calls, DataFrame operations only.

Events are messages, tool calls and tool results.  Calls and results are linked
by a hash join on (conversation, identifier).  A result depends on its call, and
a call or message on the results whose identifiers it names in ``needs``; the
order is topological: an event that was logged too early moves behind what it
depends on, and so do those that depend on it.  Arguments are parsed, validated
against the tool's schema and written as canonical JSON (sorted keys, no white
space, one form for each number).  Every event is one row with its place in the
conversation, so no conversation is ever collected, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkogram.runtime import cut, drop_scratch

#: Kinds in their order at one place of a conversation.
RANK = {"message": 0, "call": 1, "result": 2}


def quoted(c: Column) -> Column:
    """A string as JSON text; null becomes ``null``."""
    doc = F.to_json(F.struct(c.cast("string").alias("x")))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(doc, F.lit(6), F.length(doc) - 6))


#: JSON tokens: a string, a number, or other characters.
_TOKEN = r'"(?:[^"\\]++|\\.)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++|-'


def canonical(json: Column) -> Column:
    """JSON text with one form for each number outside of strings.

    Integers stay digit for digit.  Numbers with a fraction or an exponent are
    read as doubles: integral ones below 1e15 are written as integers, others in
    the shortest form that reads back the same (``1.5``, ``1.0E20``).
    """

    def form(token: Column) -> Column:
        value = token.try_cast("double")
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        short = F.when(whole, value.cast("long").cast("string")).otherwise(F.coalesce(value.cast("string"), token))
        return F.when(token.rlike("^-?[0-9]+[.eE]"), short).otherwise(token)

    tokens = F.regexp_extract_all(json, F.lit(_TOKEN), F.lit(0))
    return F.when(json.rlike("[0-9][.eE]"), F.array_join(F.transform(tokens, form), "")).otherwise(json)


def _needed(places: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """(conv_id, key, at): the least place behind all results that ``wanted`` (conv_id, key, need) names."""
    of = places.select("conv_id", F.col("id").alias("need"), "circular", F.col("result").alias("r")).where("r is not null")
    after = F.struct("circular", F.col("r.place").alias("place"), (F.col("r.depth") + 1).alias("depth"))
    return wanted.join(of, ["conv_id", "need"]).groupBy("conv_id", *key).agg(F.max(after).alias("at"))


def _spot(place: Column, depth: Column | int = 0) -> Column:
    return F.struct(place.cast("long").alias("place"), F.lit(depth).cast("long").alias("depth") if isinstance(depth, int) else depth.alias("depth"))


def _places(firsts: DataFrame) -> DataFrame:
    """(conv_id, id, circular, call, result) with (place, depth) of identifiers whose call needs results or whose result is needed.

    A call lies behind the results it needs, at their place and one deeper unless
    it was logged later; a result not before its call.  Each round moves what
    hangs on the last round's moves, so a log in order takes one look.  In a
    circle of needs depths would grow for ever: a call deeper than its
    conversation has moved calls is in a circle, or behind one, and marked.
    """
    edges = firsts.where("call is not null").select("conv_id", "id", F.explode("call.needs").alias("need")).distinct()
    edges = cut(edges.join(firsts.where("result is not null").select("conv_id", F.col("id").alias("need")), ["conv_id", "need"], "left_semi"), "needs")
    ends = edges.select("conv_id", "id").unionAll(edges.select("conv_id", F.col("need").alias("id"))).distinct()
    call, result = F.col("call.turn"), F.col("result.turn")
    state = firsts.join(ends, ["conv_id", "id"], "left_semi").select(
        "conv_id", "id", F.lit(False).alias("circular"), call.alias("turn"), result.alias("logged"),
        F.when(call.isNotNull(), _spot(call)).alias("call"), F.when(result.isNotNull(), _spot(F.greatest(call, result))).alias("result"),
        F.lit(True).alias("moved"), F.lit(False).alias("displaced"),
    )
    state = cut(state, "places")
    while True:
        at = _needed(state.where("moved"), edges, "id")
        now = F.struct("circular", "call.place", "call.depth")
        nxt = state.drop("moved").join(at, ["conv_id", "id"], "left").withColumn("moved", F.coalesce(F.col("at") > now, F.lit(False)) & ~F.col("circular"))
        nxt = nxt.withColumn("displaced", F.col("displaced") | F.col("moved"))
        nxt = cut(nxt, "moves")
        many = nxt.where("displaced").groupBy("conv_id").agg(F.count("*").alias("most"))
        nxt = nxt.join(many, "conv_id", "left")
        circle = F.col("circular") | (F.col("moved") & (F.col("at.circular") | (F.col("at.depth") > F.col("most"))))
        spot = F.when(circle, _spot(F.col("turn"))).when(F.col("moved"), F.struct("at.place", "at.depth")).otherwise(F.col("call"))
        nxt = nxt.select("conv_id", "id", circle.alias("circular"), "turn", "logged", spot.alias("call"), "result", "moved", "displaced")
        behind = F.when(F.col("logged").isNotNull(), F.greatest(_spot(F.col("logged")), F.coalesce("call", _spot(F.col("logged")))))
        nxt = cut(nxt.withColumn("result", behind), "places")
        drop_scratch(state)
        state = nxt
        if not state.where("moved").take(1):
            return state.select("conv_id", "id", "circular", "call", "result")


def link_events(events: DataFrame, schemas: DataFrame) -> DataFrame:
    """Linked, ordered, validated and serialised events.

    ``events``: conv_id, turn, kind (message, call, result), role, id, name, body
    (a call's arguments as JSON, else text) and, optional, needs (identifiers, an
    array of strings).  ``schemas``: name, field, type (string, integer, number,
    boolean, object, array), required.

    Result columns: conv_id, turn, role, kind, id, place, depth, rank, status,
    errors, json.  Sort by (conv_id, place, depth, rank, turn, id) for the
    conversation.  Status: ``message``; ``linked``, ``pending`` (call without
    result), ``orphan`` (result without call), ``duplicate`` (identifier already
    used by an earlier call, or answered by an earlier result), ``circular`` (a
    call whose needs depend on its own result, or on such a call's; it stays where
    it was logged); ``invalid`` (a call whose arguments are no JSON object or break
    the schema; JSON beyond what a VARIANT holds counts as no object).

    Defined results: null texts are JSON null; a null identifier links with
    nothing; needs that no result answers are ignored; repeated rows are
    duplicates of the first, ties broken by a hash of the event's content, exact
    copies sharing its status; an empty table gives no rows; clashing extra
    columns are ignored.
    """
    needs = F.col("needs") if "needs" in events.columns else F.lit(None)
    needs = F.array_distinct(F.filter(F.coalesce(needs.cast("array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull()))
    e = events.select("conv_id", F.col("turn").cast("long").alias("turn"), "kind", "role", "id", "name", "body", needs.alias("needs"))
    e = e.withColumn("print", F.xxhash64("body"))
    e = e.withColumn("rank", F.coalesce(*(F.when(F.col("kind") == k, F.lit(n)) for k, n in RANK.items()), F.lit(0)))
    named = "kind in ('call', 'result') and id is not null"
    # written before it is joined back: then adaptive execution can split a hot identifier
    firsts = e.where(named).groupBy("conv_id", "id").agg(
        F.min(F.when(F.col("kind") == "call", F.struct("turn", "name", "print", "needs"))).alias("call"),
        F.min(F.when(F.col("kind") == "result", F.struct("turn", "print"))).alias("result"),
    )
    firsts = cut(firsts, "firsts")
    linked = e.where(named).join(firsts, ["conv_id", "id"], "left").select(*e.columns, "call", "result")
    # events without an identifier link with nothing and are not shuffled
    other = e.where(f"not coalesce({named}, false)")
    linked = linked.unionAll(other.select(*e.columns, *(F.lit(None).cast(firsts.schema[c].dataType).alias(c) for c in ("call", "result"))))
    first_call = F.expr("kind = 'call' and coalesce(struct(turn, name, print, needs) <=> call, false)")
    log = _spot(F.when(F.col("kind") == "result", F.greatest("turn", "call.turn")).otherwise(F.col("turn")))
    if firsts.where("size(call.needs) > 0").take(1) or e.where("size(needs) > 0").take(1):
        places = _places(firsts)
        spots = places.select("conv_id", "id", "circular", F.col("call").alias("call_at"))
        wanted = e.where("size(needs) > 0").select("conv_id", "needs").distinct().select("conv_id", "needs", F.explode("needs").alias("need"))
        leaves = _needed(places.where("not circular"), wanted, "needs").select("conv_id", "needs", F.struct("at.place", "at.depth").alias("after"))
        linked = linked.join(cut(spots, "spots"), ["conv_id", "id"], "left").join(cut(leaves, "leaves"), ["conv_id", "needs"], "left")
        spot = (
            F.when(F.col("kind") == "result", F.greatest(log, F.col("call_at")))
            .when(first_call, F.coalesce("call_at", log))
            .otherwise(F.greatest(log, F.col("after")))
        )
        linked = linked.withColumn("spot", spot).withColumn("circular", F.coalesce("circular", F.lit(False)) & first_call)
    else:
        linked = linked.withColumn("spot", log).withColumn("circular", F.lit(False))

    fields = cut(schemas.groupBy("name").agg(F.collect_list(F.struct("field", "type", "required")).alias("fields")), "schemas")
    got = linked.join(fields, "name", "left")
    got = got.withColumn("args", F.when(F.col("kind") == "call", F.expr("try_parse_json(body)")))
    got = got.withColumn(
        "given",
        F.expr("case when schema_of_variant(args) like 'OBJECT%' then map_entries(cast(args as map<string, variant>)) end"),
    )
    got = got.withColumn(
        "types",
        F.expr(
            """transform(given, x -> named_struct('field', x.key, 'type', case
                 when schema_of_variant(x.value) = 'STRING' then 'string'
                 when schema_of_variant(x.value) = 'BIGINT' then 'integer'
                 when schema_of_variant(x.value) like 'DECIMAL%,0)' then 'integer'
                 when schema_of_variant(x.value) like 'DECIMAL%' or schema_of_variant(x.value) = 'DOUBLE' then 'number'
                 when schema_of_variant(x.value) = 'BOOLEAN' then 'boolean'
                 when schema_of_variant(x.value) like 'ARRAY%' then 'array'
                 when schema_of_variant(x.value) like 'OBJECT%' then 'object'
                 else 'null' end))"""
        ),
    )
    errors = F.expr(
        """case when kind <> 'call' then array()
             when given is null then array('arguments are no object')
             when fields is null then array('unknown tool')
             else array_sort(concat(
               transform(filter(fields, f -> f.required and not exists(types, t -> t.field = f.field)), f -> concat('missing ', f.field)),
               transform(filter(types, t -> not exists(fields, f -> f.field = t.field)), t -> concat('unknown ', t.field)),
               transform(filter(types, t -> exists(fields, f -> f.field = t.field and f.type <> t.type
                 and not (f.type = 'number' and t.type = 'integer'))), t -> concat('type of ', t.field)))) end"""
    )
    got = got.withColumn("errors", F.array_join(errors, "; "))
    again = F.expr(
        """(kind = 'call' and not (struct(turn, name, print, needs) <=> call))
           or (kind = 'result' and not (struct(turn, print) <=> result))"""
    )
    status = (
        F.when(~F.col("kind").isin("call", "result"), "message")
        .when(F.col("id").isNull(), F.when(F.col("kind") == "call", "pending").otherwise("orphan"))
        .when(again, "duplicate")
        .when(F.col("errors") != "", "invalid")
        .when(F.col("circular"), "circular")
        .when((F.col("kind") == "call") & F.col("result").isNull(), "pending")
        .when((F.col("kind") == "result") & F.col("call").isNull(), "orphan")
        .otherwise("linked")
    )
    got = got.withColumn("status", status)
    args = F.coalesce(canonical(F.to_json("args")), quoted(F.col("body")))
    part = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    json = (
        F.when(F.col("kind") == "call", F.concat_ws(",", part("arguments", args), part("id", quoted(F.col("id"))), part("name", quoted(F.col("name"))), part("status", quoted(F.col("status"))), F.lit('"type":"call"')))
        .when(F.col("kind") == "result", F.concat_ws(",", part("content", quoted(F.col("body"))), part("id", quoted(F.col("id"))), part("role", quoted(F.col("role"))), part("status", quoted(F.col("status"))), F.lit('"type":"result"')))
        .otherwise(F.concat_ws(",", part("content", quoted(F.col("body"))), part("role", quoted(F.col("role"))), F.lit('"type":"message"')))
    )
    return got.select(
        "conv_id", "turn", "role", "kind", "id", F.col("spot.place").alias("place"), F.col("spot.depth").alias("depth"), "rank", "status", "errors",
        F.concat(F.lit("{"), json, F.lit("}")).alias("json"),
    )


def tool_events(turns: DataFrame) -> DataFrame:
    """Events of a conversation table whose texts carry tool traffic as JSON.

    An assistant text ``{"tool_calls": [{"id", "name", "arguments", "needs"}]}``
    gives a call per entry (``needs``, if there, lists identifiers), a tool text ``{"tool_call_id", "content"}`` a result, any
    other text a message.
    """
    calls = F.from_json(F.get_json_object("text", "$.tool_calls"), "array<string>")
    t = turns.select("conv_id", "turn", "role", "text", F.when(F.col("role") == "assistant", calls).alias("calls"))
    t = t.withColumn("of", F.when(F.col("role") == "tool", F.get_json_object("text", "$.tool_call_id")))
    none = F.lit(None).cast("string")
    call = t.where("calls is not null").select("conv_id", "turn", "role", F.explode("calls").alias("c"))
    call = call.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "role", F.get_json_object("c", "$.id").alias("id"),
        F.get_json_object("c", "$.name").alias("name"), F.get_json_object("c", "$.arguments").alias("body"),
        F.from_json(F.get_json_object("c", "$.needs"), "array<string>").alias("needs"),
    )
    rest = t.where("calls is null").select(
        "conv_id", "turn", F.when(F.col("of").isNull(), "message").otherwise("result").alias("kind"), "role", F.col("of").alias("id"),
        none.alias("name"), F.when(F.col("of").isNull(), F.col("text")).otherwise(F.get_json_object("text", "$.content")).alias("body"),
        F.lit(None).cast("array<string>").alias("needs"),
    )
    return call.unionByName(rest)


def turn_events(turns: DataFrame, tool: str = "reply") -> DataFrame:
    """Events of a plain conversation table: a user turn calls the assistant, whose next turn is the result.

    The identifier is the user's turn number; the arguments hold text and turn; a
    call needs the result of the exchange two turns before.  Turns of other roles
    are messages.
    """
    turn = F.col("turn").cast("long")
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    return turns.select(
        "conv_id",
        turn.alias("turn"),
        F.when(user, "call").when(reply, "result").otherwise("message").alias("kind"),
        "role",
        F.when(user, turn).when(reply, turn - 1).cast("string").alias("id"),
        F.when(user, F.lit(tool)).alias("name"),
        F.when(user, F.to_json(F.struct(F.col("turn"), F.col("text")))).otherwise(F.col("text")).alias("body"),
        F.when(user, F.array((turn - 2).cast("string"))).alias("needs"),
    )
