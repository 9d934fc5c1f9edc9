"""Tool-call linking for chat data, in DataFrame functions only: calls and results are hash-joined by identifier, put in
topological order, checked against the schemas of their tools, and written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinework.llm.common import cut, joined_by_key

#: A tool's schema: for each field its type (string, integer, number, boolean, array, object), whether it must be
#: there, and an optional least and most (of a number, or of a string's characters).
Schema = dict[str, dict]

_TYPES = {
    "string": "kind = 'STRING'",
    "integer": "kind in ('BIGINT', 'INT', 'SMALLINT', 'TINYINT') or kind like 'DECIMAL(%,0)'",
    "number": "kind in ('BIGINT', 'INT', 'SMALLINT', 'TINYINT', 'DOUBLE', 'FLOAT') or kind like 'DECIMAL%'",
    "boolean": "kind = 'BOOLEAN'",
    "array": "kind like 'ARRAY%'",
    "object": "kind like 'OBJECT%'",
}


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def problems(schemas: dict[str, Schema], name: str = "name", arguments: str = "_args") -> Column:
    """What is wrong with the arguments (a variant column) of a call, as an array of short texts."""
    checks = []
    for tool, fields in schemas.items():
        here = f"{name} = {_text(tool)}"
        for field, rule in fields.items():
            value = f"try_variant_get({arguments}, {_text('$.' + field)}, 'variant')"
            missing = f"({value} is null or is_variant_null({value}))"
            if rule.get("required"):
                checks.append(f"case when {here} and {missing} then {_text('missing ' + field)} end")
            typed = _TYPES[rule["type"]].replace("kind", f"schema_of_variant({value})")
            checks.append(f"case when {here} and not {missing} and not ({typed}) then {_text('type of ' + field)} end")
            measure = f"length(try_variant_get({arguments}, {_text('$.' + field)}, 'string'))" if rule["type"] == "string" else f"try_variant_get({arguments}, {_text('$.' + field)}, 'double')"
            for bound, sign in (("least", "<"), ("most", ">")):
                if bound in rule:
                    checks.append(f"case when {here} and not {missing} and ({typed}) and {measure} {sign} {rule[bound]} then {_text(bound + ' of ' + field)} end")
    known = ", ".join(_text(t) for t in schemas) or "''"
    checks += [f"case when {name} is null or {name} not in ({known}) then 'unknown tool' end", f"case when {arguments} is null or schema_of_variant({arguments}) not like 'OBJECT%' then 'no object' end"]
    return F.expr(f"filter(array({', '.join(checks)}), x -> x is not null)")


_KEY = ["conv_id", "call_id"]


def _settled(place: DataFrame, waits: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
    """``place`` (conv_id, call_id, least) with each ``least`` raised to one step over those of the calls it waits for, by
    the ``n`` rows of ``waits`` (conv_id, call_id, needs, k); and the waits that never end, and their number.

    A call that waits for one call only is skipped over: what it adds, the greatest of a constant and of what it waits for,
    so much deeper, has the same form for a chain of any length, so waits over chains double in each round. A round is
    needed, besides, for each level of calls that wait for several. A round that settles no call ends it."""
    open_calls = -1
    while n:
        own = waits.groupBy(*_KEY).agg(F.count("*").alias("degree"), F.first("needs").alias("next"), F.first("k").alias("more"))
        asked = waits.groupBy("conv_id", "needs").agg(F.count("*").alias("_size"))
        ahead = place.join(own, _KEY, "left").select("conv_id", F.col("call_id").alias("needs"), F.col("least").alias("there"), F.coalesce("degree", F.lit(0)).alias("degree"), "next", "more")
        met = cut(joined_by_key(waits, ahead.join(asked, ["conv_id", "needs"]), ["conv_id", "needs"], "_size", n))
        gain = met.where("degree < 2").groupBy(*_KEY).agg(F.max(F.struct(F.col("there.at").alias("at"), (F.col("there.depth") + F.col("k")).alias("depth"))).alias("gain"))
        place = cut(place.join(gain, _KEY, "left").select(*_KEY, F.greatest("least", F.coalesce("gain", "least")).alias("least")))
        one = F.col("degree") == 1
        on = met.where("degree > 0").select(*_KEY, F.when(one, F.col("next")).otherwise(F.col("needs")).alias("needs"), (F.col("k") + F.when(one, F.col("more")).otherwise(0)).alias("k"))
        waits = cut(on.groupBy(*_KEY, "needs").agg(F.max("k").alias("k")))
        n, left = waits.agg(F.count("*"), F.count_distinct(F.struct(*_KEY))).first()
        if left == open_calls:
            break
        open_calls = left
    return place, waits, n


def in_order(calls: DataFrame) -> DataFrame:
    """``calls`` (conv_id, call_id, pos, after) with ``at`` and ``depth``: sorting by (at, depth) puts each call after
    all calls it names in ``after``, as near to its position as that allows. ``cyclic``: it waits for itself, directly
    or not, or would have to move for one that does; it then stands at its own position. Names of no call, and null ones,
    are ignored.

    A call's place is the greatest of its own and those of what it waits for, one deeper. In a log in order that is its
    own, which one pass finds; else see ``_settled``."""
    start = cut(calls.select(*_KEY, F.struct(F.col("pos").alias("at"), F.lit(0).alias("depth")).alias("least")))
    known = start.select("conv_id", F.col("call_id").alias("needs"), F.col("least.at").alias("need_at"))
    waits = calls.select(*_KEY, "pos", F.explode("after").alias("needs")).where("needs is not null").distinct()
    waits = cut(waits.join(known, ["conv_id", "needs"]).select(*_KEY, "needs", F.lit(1).alias("k"), F.coalesce(F.col("need_at") >= F.col("pos"), F.lit(True)).alias("late")))
    n, late = waits.agg(F.count("*"), F.count_if("late")).first()
    waits = waits.drop("late")
    place, stuck = (start, None) if not late else _settled(start, waits, n)[:2]
    held = None
    if late and not stuck.isEmpty():
        # of those that wait without end, the ones that are waited for without end are on cycles
        back = waits.join(stuck.select(*_KEY).distinct(), _KEY, "left_semi").select("conv_id", F.col("needs").alias("call_id"), F.col("call_id").alias("needs"), "k")
        back = cut(back.join(stuck.select(*_KEY).distinct(), _KEY, "left_semi"))
        _, round_, _ = _settled(start, back, back.count())
        cycle = cut(round_.select(*_KEY).distinct())
        on = cycle.select("conv_id", F.col("call_id").alias("needs"))
        free = cut(waits.join(cycle, _KEY, "left_anti"))
        rest = cut(free.join(on, ["conv_id", "needs"], "left_anti").select(*_KEY, "needs", "k"))
        m = rest.count()
        place = _settled(start, rest, m)[0]
        # those that would move for a call on a cycle
        pushed = free.join(on, ["conv_id", "needs"], "left_semi").join(known, ["conv_id", "needs"]).groupBy(*_KEY).agg(F.max(F.struct(F.col("need_at").alias("at"), F.lit(1).alias("depth"))).alias("push"))
        moved = _settled(cut(start.join(pushed, _KEY, "left").select(*_KEY, F.greatest("least", F.coalesce("push", "least")).alias("least"))), rest, m)[0]
        behind = moved.withColumnRenamed("least", "moved").join(place, _KEY).where("moved > least").select(*_KEY)
        held = cut(cycle.union(behind).distinct()).withColumn("held", F.lit(True))
    out = calls.join(place, _KEY)
    out = out.join(held, _KEY, "left") if held is not None else out.withColumn("held", F.lit(None).cast("boolean"))
    cyclic = F.coalesce("held", F.lit(False))
    return out.withColumns({"at": F.when(cyclic, F.col("pos")).otherwise(F.col("least.at")), "depth": F.when(cyclic, 0).otherwise(F.col("least.depth")), "cyclic": cyclic}).drop("least", "held")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """One row for each call identifier of a conversation, and for each result without a call.

    ``calls``: conv_id, pos, call_id, name, arguments (JSON text), after (array of call_ids); ``results``: conv_id, pos,
    call_id, content. Of calls or results with one identifier the first by position counts (ties: least text) and the
    others are counted in ``repeats``. ``status`` is answered, unanswered or orphan (a result alone). ``errors`` lists
    what the schemas find, empty where all is well and for orphans. ``message`` is canonical JSON: keys sorted, no
    spaces; arguments that are no JSON stand as text. Rows with a null conversation or identifier are dropped, as
    nothing can be linked to them. Other columns are ignored; empty inputs give an empty result."""
    has = "conv_id is not null and call_id is not null"
    asked = calls.where(has).groupBy("conv_id", "call_id").agg(F.min(F.struct("pos", "name", "arguments", "after")).alias("c"), F.count("*").alias("n")).select("conv_id", "call_id", "c.*", (F.col("n") - 1).alias("more"))
    got = results.where(has).groupBy("conv_id", "call_id").agg(F.min(F.struct("pos", "content")).alias("r"), F.count("*").alias("n")).select("conv_id", "call_id", F.col("r.pos").alias("result_pos"), F.col("r.content").alias("content"), (F.col("n") - 1).alias("more_results"), F.lit(True).alias("has_result"))
    ordered = in_order(cut(asked)).withColumn("has_call", F.lit(True))
    both = ordered.join(got, ["conv_id", "call_id"], "full_outer").withColumn("_args", F.try_parse_json("arguments"))
    status = F.when(F.col("has_call").isNull(), "orphan").when(F.col("has_result").isNull(), "unanswered").otherwise("answered")
    out = both.select(
        "conv_id", "call_id", "name", "pos", "result_pos", status.alias("status"),
        F.coalesce("at", "result_pos").alias("at"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        (F.coalesce("more", F.lit(0)) + F.coalesce("more_results", F.lit(0))).alias("repeats"),
        F.when(F.col("has_call"), problems(schemas)).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.when(F.col("arguments").isNotNull(), F.coalesce(F.to_json("_args"), F.to_json(F.struct(F.col("arguments").alias("text"))))).alias("_json"), "content",
    )
    quoted = lambda c: F.expr(f"coalesce(substring(to_json(named_struct('x', {c})), 6, length(to_json(named_struct('x', {c}))) - 6), 'null')")
    parts = [F.lit('{"arguments":'), F.coalesce("_json", F.lit("null")), F.lit(',"content":'), F.when(F.col("content").isNull(), "null").otherwise(quoted("content")), F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), F.when(F.col("name").isNull(), "null").otherwise(quoted("name")), F.lit(',"status":"'), F.col("status"), F.lit('"}')]
    return out.withColumn("message", F.concat(*parts)).drop("_json", "content")


def from_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in the texts of ``messages`` (conv_id, turn, role, text): assistant texts that are JSON with
    ``tool_calls`` [{id, type, function: {name, arguments}}], or the flat form [{id, name, arguments, after}], and tool
    texts that are JSON with ``tool_call_id`` and ``content``. ``arguments`` is JSON text. Other messages have none."""
    form = "tool_calls array<struct<id:string,type:string,function:struct<name:string,arguments:string>,name:string,arguments:string,after:array<string>>>"
    calls = messages.where("role = 'assistant'").select("conv_id", F.col("turn").alias("pos"), F.explode(F.from_json("text", form)["tool_calls"]).alias("c"))
    answer = F.from_json("text", "tool_call_id string, content string")
    results = messages.where("role = 'tool'").select("conv_id", F.col("turn").alias("pos"), answer.alias("a"))
    calls = calls.select("conv_id", "pos", F.col("c.id").alias("call_id"), F.coalesce("c.function.name", "c.name").alias("name"), F.coalesce("c.function.arguments", "c.arguments").alias("arguments"), "c.after")
    return calls, results.select("conv_id", "pos", F.col("a.tool_call_id").alias("call_id"), "a.content")


def from_exchanges(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chats without tool messages, as calls of one tool ``reply``: a user turn calls it with its text, and the
    assistant turn after it is the result. A call waits for the one two turns before."""
    name = lambda turn: F.concat_ws(":", "conv_id", turn)
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    arguments = F.to_json(F.struct(F.col("turn"), words.alias("words"), F.coalesce("text", F.lit("")).alias("prompt")))
    calls = messages.where("role = 'user'").select("conv_id", F.col("turn").alias("pos"), name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.array(name(F.col("turn") - 2)).alias("after"))
    results = messages.where("role = 'assistant'").select("conv_id", F.col("turn").alias("pos"), name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
