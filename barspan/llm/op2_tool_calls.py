"""Tool-call linking for chat formatting, in DataFrame operations only.

Calls (conv_id, turn, idx, call_id, name, arguments) and results (conv_id, turn, call_id,
content) meet in a hash join on (conv_id, call_id). Arguments are JSON texts: they are parsed,
checked against the schema of the called tool, and written back as canonical JSON (keys in
code-point order, no blanks). Arguments named in ``references`` hold ids of earlier calls of
the conversation and set the order.

Order: sorted by (level, turn, idx, call_id) every call stands after the calls it refers to.
The level counts references that point forward in the transcript, so it is 0 everywhere in a
consistent one and nothing is iterated; otherwise levels are raised along the references until
they settle. A call on a cycle, or behind one, has no level.

``problems`` lists what is wrong with a call, in this order: ``missing_id`` (null conv_id or
call_id: linked with nothing), ``duplicate_call`` (a later call of the same id), ``unknown_tool``,
``bad_json`` (also: not an object, or a key twice), ``missing:x``, ``unexpected:x``, ``type:x``,
``range:x`` for arguments, ``unknown_reference``, ``cyclic_reference``, ``no_result``,
``result_before_call``. Further results of one id are dropped in favour of the first; a result
without a call is a row of its own with the problem ``orphan_result``. Rows repeated in all
columns count once; ties go to the smaller text. Null arguments are bad JSON, a null content is
a result. Empty tables give no rows. Further columns of the inputs are ignored.

No window or group gathers a conversation: all groups are single ids.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspan.llm.common import written

#: Tool -> {"properties": {name: {"type", "minimum", "maximum", "minLength", "maxLength", "enum"}}, "required": [...]}.
Schemas = Mapping[str, Mapping]

_TYPES = {
    "string": "^STRING$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": r"^(BIGINT|DECIMAL\(.*|DOUBLE|FLOAT)$",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT<",
    "array": "^ARRAY<",
    "null": "^VOID$",
}


def canonical(text: str | Column) -> Column:
    """Canonical JSON of a JSON text; null if it is none."""
    return F.to_json(F.try_parse_json(text))


def quoted(c: str | Column) -> Column:
    """A string as a JSON string, null as ``null``."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.to_json(F.struct(c.alias("a")), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(6), F.length(text) - 6)


def violations(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Problems of JSON arguments under the schema of the tool ``name``."""
    parsed = F.try_parse_json(arguments)
    kind = F.schema_of_variant(parsed)
    is_object = F.coalesce(kind.startswith("OBJECT<"), F.lit(False))
    keys = F.map_keys(F.from_json(F.when(is_object, arguments), "map<string,string>"))
    found = F.array(F.lit("unknown_tool"))
    for tool, schema in schemas.items():
        checks = []
        properties = schema.get("properties", {})
        for key in sorted(properties):
            rule, has = properties[key], F.array_contains(keys, key)
            value = F.try_variant_get(parsed, f"$['{key}']", "variant")
            if key in schema.get("required", ()):
                checks.append(F.when(~has, f"missing:{key}"))
            fits = F.schema_of_variant(value).rlike(_TYPES[rule["type"]]) if "type" in rule else F.lit(True)
            checks.append(F.when(has & ~F.coalesce(fits, F.lit(False)), f"type:{key}"))
            text, number = F.try_variant_get(parsed, f"$['{key}']", "string"), F.try_variant_get(parsed, f"$['{key}']", "double")
            bounds = [number < rule["minimum"]] if "minimum" in rule else []
            bounds += [number > rule["maximum"]] if "maximum" in rule else []
            bounds += [F.length(text) < rule["minLength"]] if "minLength" in rule else []
            bounds += [F.length(text) > rule["maxLength"]] if "maxLength" in rule else []
            bounds += [~text.isin(*rule["enum"])] if "enum" in rule else []
            for outside in bounds:
                checks.append(F.when(has & fits & outside, f"range:{key}"))
        extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in properties]).cast("array<string>")))
        own = F.concat(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), F.transform(extra, lambda k: F.concat(F.lit("unexpected:"), k)))
        found = F.when(name == tool, own).otherwise(found)
    return F.when(~is_object & name.isin(*schemas), F.array(F.lit("bad_json"))).when(
        ~is_object, F.array(F.lit("unknown_tool"), F.lit("bad_json"))
    ).otherwise(found)


def link(calls: DataFrame, results: DataFrame, schemas: Schemas, references: Sequence[str] = ()) -> DataFrame:
    """(conv_id, call_id, turn, idx, level, name, arguments, result, result_turn, problems, record).

    ``record`` is the canonical JSON of the linked call, null where there are problems.
    """
    c = calls.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("idx").cast("long"), F.col("call_id").cast("string"),
        F.col("name").cast("string"), F.col("arguments").cast("string").alias("raw"),
    ).distinct()
    r = results.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("call_id").cast("string"), F.col("content").cast("string"))
    key = ["conv_id", "call_id"]
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    place = F.struct("turn", "idx", "raw", "name")
    first = c.where(known).groupBy(*key).agg(F.min(place).alias("first"))
    answer = r.where(known).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("answer"), F.lit(True).alias("answered"))

    # both sides are one row per id, so a full join links, and keeps calls and results that have no partner
    linked = c.where(known).join(first.join(answer, key, "full"), key, "full")
    linked = linked.unionByName(c.where(~known), allowMissingColumns=True)
    lost = r.where(~known).distinct().select("conv_id", "call_id", F.struct("turn", "content").alias("answer"), F.lit(True).alias("answered"))
    linked = linked.unionByName(lost, allowMissingColumns=True)

    orphan = F.col("answered").isNotNull() & F.col("first").isNull() & F.col("turn").isNull() & F.col("raw").isNull() & F.col("name").isNull()
    whole = F.coalesce(known, F.lit(False))
    again = whole & ~F.struct("turn", "idx", "raw", "name").eqNullSafe(F.col("first"))
    rows = (
        linked.withColumn("orphan", orphan)
        .withColumn("again", again & ~orphan)
        .withColumn("whole", whole)
        .withColumn("bad", F.when(orphan, F.array().cast("array<string>")).otherwise(violations(F.col("name"), F.col("raw"), schemas)))
    )
    rows = written(rows, "linked-calls")
    levels = _levels(rows, references) if references else None
    if levels is not None:
        rows = rows.join(levels.withColumnRenamed("known_refs", "_ok"), key, "left").withColumn("level", F.when(F.col("orphan"), F.lit(None)).otherwise(F.coalesce("level", F.lit(0))))
        lost_ref, cyclic = ~F.coalesce("_ok", F.lit(True)), F.col("level") < 0
    else:
        rows, lost_ref, cyclic = rows.withColumn("level", F.when(~F.col("orphan"), F.lit(0))), F.lit(False), F.lit(False)
    no_answer = F.col("answered").isNull() | F.col("again")
    problems = F.array_compact(
        F.flatten(
            F.array(
                F.array(
                    F.when(~F.col("whole"), "missing_id"),
                    F.when(F.col("again"), "duplicate_call"),
                ),
                F.col("bad"),
                F.array(
                    F.when(lost_ref & F.col("whole") & ~F.col("again"), "unknown_reference"),
                    F.when(cyclic & F.col("whole") & ~F.col("again"), "cyclic_reference"),
                    F.when(no_answer & ~F.col("orphan"), "no_result"),
                    F.when(~no_answer & (F.col("answer.turn") < F.col("turn")), "result_before_call"),
                    F.when(F.col("orphan"), "orphan_result"),
                ),
            )
        )
    )
    out = rows.withColumn("problems", problems).withColumn("arguments", canonical("raw")).select(
        "conv_id",
        "call_id",
        "turn",
        "idx",
        F.when(F.col("level") >= 0, F.col("level")).alias("level"),
        "name",
        "arguments",
        F.when(~F.col("again"), F.col("answer.content")).alias("result"),
        F.when(~F.col("again"), F.col("answer.turn")).alias("result_turn"),
        "problems",
    )
    record = F.concat(
        F.lit('{"arguments":'), "arguments", F.lit(',"call_id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"),
        F.lit(',"result":'), quoted("result"), F.lit("}"),
    )
    return out.withColumn("record", F.when(F.size("problems") == 0, record))


def _levels(rows: DataFrame, references: Sequence[str]) -> DataFrame:
    """(conv_id, call_id, level, known_refs) of calls that refer to others; level -1: on or behind a cycle."""
    nodes = rows.where("whole and not again and not orphan").select("conv_id", "call_id", "turn", "idx", "raw")
    parsed = F.try_parse_json("raw")
    ids = F.flatten(
        F.array(
            *[
                F.coalesce(
                    F.try_variant_get(parsed, f"$['{k}']", "array<string>"),
                    F.array_compact(F.array(F.try_variant_get(parsed, f"$['{k}']", "string"))),
                )
                for k in references
            ]
        )
    )
    edges = nodes.select("conv_id", "call_id", "turn", "idx", F.explode(F.array_distinct(ids)).alias("to_id"))
    target = nodes.select("conv_id", F.col("call_id").alias("to_id"), F.struct("turn", "idx", "call_id").alias("to"))
    edges = edges.join(target, ["conv_id", "to_id"], "left")
    forward = (F.struct("turn", "idx", "call_id") <= F.col("to")).cast("int")
    edges = written(edges.select("conv_id", "call_id", "to_id", F.col("to").isNotNull().alias("known"), F.coalesce(forward, F.lit(0)).alias("ahead")), "call-edges")
    refs = edges.groupBy("conv_id", "call_id").agg(F.bool_and("known").alias("known_refs"))
    real = edges.where("known")
    limits = real.groupBy("conv_id").agg(F.sum("ahead").alias("limit")).where("limit > 0")
    if limits.isEmpty():
        return refs.select("conv_id", "call_id", F.lit(0).cast("long").alias("level"), "known_refs")
    real = real.join(limits, "conv_id")
    # a path without a cycle meets every forward reference once at most: a higher level is a cycle
    new = F.when((F.col("up") < 0) | (F.col("up") > F.col("limit")), -1).otherwise(F.col("up"))
    level = written(real.select("conv_id", "call_id").union(real.select("conv_id", "to_id")).distinct().withColumn("level", F.lit(0).cast("long")), "levels")
    while True:
        parent = level.select("conv_id", F.col("call_id").alias("to_id"), F.col("level").alias("of_parent"))
        step = real.join(parent, ["conv_id", "to_id"])
        up = F.max(F.when(F.col("of_parent") < 0, F.col("limit") + 1).otherwise(F.col("of_parent") + F.col("ahead"))).alias("up")
        raised = step.groupBy("conv_id", "call_id").agg(up, F.max("limit").alias("limit")).select("conv_id", "call_id", new.alias("new"))
        both = level.join(raised, ["conv_id", "call_id"], "left")
        # a call that refers to nothing, or is known to be cyclic, stays
        after = F.when(F.col("level") < 0, -1).otherwise(F.coalesce(F.col("new"), F.col("level"))).cast("long")
        both = written(both.select("conv_id", "call_id", after.alias("level"), (after != F.col("level")).alias("moved")), "levels")
        level = both.drop("moved")
        if both.where("moved").isEmpty():
            break
    return refs.join(level, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.coalesce("level", F.lit(0)).alias("level"), "known_refs")


#: The tool of ``calls_of``.
SCHEMAS: Schemas = {
    "answer": {
        "properties": {
            "after": {"type": "string"},
            "text": {"type": "string", "minLength": 1},
            "turn": {"type": "integer", "minimum": 0},
        },
        "required": ["text", "turn"],
    }
}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a plain transcript implies.

    A user turn calls ``answer`` with its text and refers to the user turn two turns before;
    the assistant turn that follows is the result.
    """
    me = F.concat_ws("-", "conv_id", "turn")
    me = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), me)
    before = F.when(F.col("turn") >= 2, F.concat_ws("-", F.col("conv_id"), F.col("turn") - 2))
    calls = conversations.where("role = 'user'").select(
        "conv_id", "turn", F.lit(0).alias("idx"), me.alias("call_id"), F.lit("answer").alias("name"),
        F.to_json(F.struct("turn", F.col("text").cast("string").alias("text"), before.alias("after"))).alias("arguments"),
    )
    asked = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.concat_ws("-", F.col("conv_id"), F.col("turn") - 1))
    results = conversations.where("role = 'assistant'").select("conv_id", "turn", asked.alias("call_id"), F.col("text").alias("content"))
    return calls, results
