"""Evidence documents against a schema, and trees compared by hashes of their subtrees."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONSTRAINTS = "shape string, rule string, argument string"
#: What a value of evidence may not say: where something lies on somebody's machine.
PRIVATE = r"(?i)(^|[^a-z])([a-z]:[\\/]|/users/|/home/|file://)"


def schema_rows(schema: dict, shape: str = "") -> list[tuple[str, str, str]]:
    """A JSON schema as rows (shape, rule, argument): one for each constraint on each place. A shape is a path whose places in
    arrays are ``*``. Known are type, enum, const, pattern, minimum, maximum, minItems, maxItems, required, properties,
    additionalProperties false, and items; any other keyword is refused."""
    rows = []
    for key, value in schema.items():
        if key == "properties":
            for name, below in value.items():
                rows += [(shape, "known", name), *schema_rows(below, f"{shape}/{name}")]
        elif key == "items":
            rows += schema_rows(value, f"{shape}/*")
        elif key == "additionalProperties" and value is False:
            rows.append((shape, "closed", ""))
        elif key in ("type", "enum", "required"):
            rows += [(shape, key, v if isinstance(v, str) and key != "enum" else json.dumps(v)) for v in (value if isinstance(value, list) else [value])]
        elif key == "const":
            rows.append((shape, "enum", json.dumps(value)))
        elif key in ("pattern", "minimum", "maximum", "minItems", "maxItems"):
            rows.append((shape, key, str(value)))
        else:
            raise ValueError(f"no rule for {key} at {shape or '/'}")
    return rows


def constraints(spark: SparkSession, schema: dict) -> DataFrame:
    return spark.createDataFrame(schema_rows(schema), CONSTRAINTS)


def _with_holders(values: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``ranges.with_paths`` rows with the columns ``holder`` and ``names`` that ``ranges.read_json`` gives of itself."""
    if "names" in values.columns:
        return values
    below = values.where("parent IS NOT NULL").groupBy(*by, F.col("parent").alias("k")).agg(F.collect_list("step_name").alias("_names"))
    above = values.where("kind = 'object'").select(*by, F.col("k").alias("parent"), F.col("shape").alias("holder"))
    out = values.join(below, [*by, "k"], "left").join(above, [*by, "parent"], "left")
    return out.withColumn("names", F.when(F.col("kind").isin("object", "array"), F.coalesce("_names", F.array().cast("array<string>")))).drop("_names")


def violations(values: DataFrame, rules: DataFrame, by: tuple[str, ...] = ("doc_id",), private: str = PRIVATE) -> DataFrame:
    """(by, path, rule, argument): what documents break, from ``ranges.read_json`` or ``ranges.with_paths`` rows and constraint rows.

    Values meet the constraints of their shape and of their holder's, a row a shape, and all is decided in the joined row: types,
    words, patterns, bounds, required keys that no child of the object has, and keys of a closed object that are no property.
    ``private`` names strings that no evidence may hold (rule ``private``). Only what is broken is shuffled: a type or word that two
    equal values of one path break is told once.
    """
    raw, kind = F.col("raw"), F.col("kind")
    text = F.when(kind == "string", F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"))
    kinds = F.when((kind == "number") & raw.rlike("^-?[0-9]+$"), F.array(F.lit("number"), F.lit("integer"))).otherwise(F.array("kind"))
    told = rules.groupBy("shape").agg(F.collect_list(F.struct("rule", "argument")).alias("own"))
    met = _with_holders(values, by).withColumn("text", text).join(F.broadcast(told), "shape", "left")
    met = met.join(F.broadcast(told.select(F.col("shape").alias("holder"), F.col("own").alias("above"))), "holder", "left")
    none = F.array().cast("array<string>")
    given = lambda rule, of="own": F.coalesce(F.transform(F.filter(of, lambda r: r["rule"] == rule), lambda r: r["argument"]), none)
    number, bound = raw.try_cast("double"), lambda a: a.try_cast("double")
    broken = lambda rule, test, of="own": F.transform(F.filter(given(rule, of), test), lambda a: F.struct(F.lit(rule).alias("rule"), a.alias("argument")))
    once = lambda rule, bad, argument: F.when(bad, F.array(F.struct(F.lit(rule).alias("rule"), argument.alias("argument")))).otherwise(F.array().cast("array<struct<rule:string,argument:string>>"))
    words = lambda rule: F.array_join(F.array_sort(F.array_distinct(given(rule))), "|")
    found = F.concat(
        once("type", (F.size(given("type")) > 0) & ~F.arrays_overlap(given("type"), kinds), words("type")),
        once("enum", (F.size(given("enum")) > 0) & ~F.array_contains(given("enum"), F.coalesce(raw, F.lit(""))), words("enum")),
        broken("pattern", lambda a: (kind == "string") & ~F.regexp_like("text", a)),
        broken("minimum", lambda a: (kind == "number") & (number < bound(a))), broken("maximum", lambda a: (kind == "number") & (number > bound(a))),
        broken("minItems", lambda a: (kind == "array") & (F.size("names") < bound(a))), broken("maxItems", lambda a: (kind == "array") & (F.size("names") > bound(a))),
        broken("required", lambda a: (kind == "object") & ~F.exists("names", lambda n: n.eqNullSafe(a))),
        once("additional", (F.size(given("closed", "above")) > 0) & ~F.exists(given("known", "above"), lambda a: a.eqNullSafe(F.col("step_name"))), F.col("step_name")),
        once("private", F.col("text").rlike(private), F.lit("")),
    )
    rows = met.select(*by, "path", "kind", "raw", "k", F.explode(found).alias("f")).select(*by, "path", "f.*", F.when(F.col("f.rule").isin("type", "enum"), F.concat_ws(" ", "kind", "raw")).otherwise(F.col("k").cast("string")).alias("_of"))
    return rows.dropDuplicates([*by, "path", "rule", "argument", "_of"]).drop("_of")


def subtree_hashes(nodes: DataFrame, own: Column, by: str = "scope_id") -> DataFrame:
    """(by, id, parent_id, depth, own, hash): a hash of each node and all that is below it, in order.

    From the deepest level up, a node's hash is that of what it says itself and of its children's hashes in the order of
    siblings; a level is one aggregate by parent and one join. Equal hashes mean equal subtrees.
    """
    given = nodes.select(by, "id", "parent_id", "depth", "sibling_order", F.sha2(F.concat_ws("|", "id", own), 256).alias("own"))
    deepest = given.agg(F.max("depth")).first()[0]
    out, above = None, None
    for d in range(deepest if deepest is not None else -1, -1, -1):
        level = given.where(F.col("depth") == d)
        if above is None:
            level = level.withColumn("hash", F.col("own"))
        else:
            told = above.groupBy(F.col("parent_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sibling_order", "id", "hash"))), lambda x: x["hash"]), ",").alias("below"))
            level = level.join(told, "id", "left").withColumn("hash", F.when(F.col("below").isNull(), F.col("own")).otherwise(F.sha2(F.concat_ws(">", "own", "below"), 256))).drop("below")
        above = level.select(by, "id", "parent_id", "depth", "sibling_order", "own", "hash")
        out = above if out is None else out.unionByName(above)
    return (out if out is not None else given.withColumn("hash", F.col("own"))).drop("sibling_order")


def differing_subtrees(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, change): the nodes that make two hashed trees differ: changed, added or removed.

    From the roots down, only the children of nodes whose hashes differ are looked at; equal subtrees are never entered.
    A node that differs only because of what is below it is not named; of an added or removed subtree only the top is.
    """
    depth = max(x.agg(F.coalesce(F.max("depth"), F.lit(-1))).first()[0] for x in (left, right))
    out, front = None, None
    for d in range(depth + 1):
        a, b = (x.where(F.col("depth") == d).select("id", "parent_id", F.col("own").alias(f"{s}_own"), F.col("hash").alias(f"{s}_hash")) for x, s in ((left, "l"), (right, "r")))
        if front is not None:
            a, b = (x.join(front.select(F.col("id").alias("parent_id")), "parent_id", "left_semi") for x in (a, b))
        met = a.join(b, ["id", "parent_id"] if d else "id", "full_outer").where("NOT l_hash <=> r_hash")
        change = F.when(F.col("l_hash").isNull(), "added").when(F.col("r_hash").isNull(), "removed").when(F.col("l_own") != F.col("r_own"), "changed")
        found = met.select("id", change.alias("change")).where("change IS NOT NULL")
        out = found if out is None else out.unionByName(found)
        front = met.where("l_hash IS NOT NULL AND r_hash IS NOT NULL").select("id")
    return out
