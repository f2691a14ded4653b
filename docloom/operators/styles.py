"""Resolved geometry and styles: the cascade, offsets and bounds through the tree, and text fit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalars import available_width, fit_status, strict_number, utilisation

# Property defaults, and the origins of a value from weakest to strongest.
DEFAULTS = {"fill": "#000000", "stroke": "none", "stroke-width": "1", "opacity": "1", "font-weight": "400", "font-style": "normal", "text-anchor": "start"}
ORIGINS = {"default": 0, "presentation-attribute": 1, "base-rule": 2, "inline-style": 3}
# What a style value may not be, and the words that two properties may have.
WIDE_KEYWORDS = ("inherit", "initial", "revert", "revert-layer", "unset")
GENERIC_FAMILIES = ("cursive", "emoji", "fangsong", "fantasy", "math", "monospace", "sans-serif", "serif", "system-ui", "ui-monospace", "ui-rounded", "ui-sans-serif", "ui-serif")
FORBIDDEN_FUNCTIONS = ("calc", "url", "var")
WORD_VALUES = {"font-style": ("normal", "italic"), "text-anchor": ("start", "middle", "end")}


def _by_class(nodes: DataFrame, rules: DataFrame, theme: DataFrame, by: tuple[str, ...]) -> DataFrame:
    tokens = theme.select(*by, "token", "expression")
    valued = rules.join(tokens, [*by, "token"], "left").select(*by, "class", "source_order", "property", F.coalesce("literal", "expression").alias("value"))
    return nodes.select(*by, "id", F.explode("classes").alias("class")).join(valued, [*by, "class"]).select(*by, "id", "property", F.lit(ORIGINS["base-rule"]).alias("origin"), "source_order", "value")


def declared(nodes: DataFrame, rules: DataFrame, theme: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, property, origin, source_order, value) of every value that a node's classes, attributes or inline style give.

    ``rules``: class, source_order, property, literal, token; ``theme``: token, expression; a token stands for its value
    in the theme. ``nodes``: id, classes, attributes and inline (maps of property to value). ``by`` names columns that
    all three have and that keep documents apart.
    """
    by_class = _by_class(nodes, rules, theme, by)
    own = lambda column, origin: nodes.select(*by, "id", F.explode(column).alias("property", "value")).select(*by, "id", "property", F.lit(ORIGINS[origin]).alias("origin"), F.lit(0).alias("source_order"), "value")
    return by_class.unionByName(own("attributes", "presentation-attribute")).unionByName(own("inline", "inline-style"))


def cascade(nodes: DataFrame, rules: DataFrame, theme: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, property, value, origin): the strongest value of each property, the later of equals; else the default.

    What a node gives itself travels in one row, what its classes give in a row each; they meet once under the node's id, and
    the defaults, the weakest declarations, join them there.
    """
    order = rules.schema["source_order"].dataType
    kind = f"array<struct<property:string,origin:int,source_order:{order.simpleString()},value:string>>"
    one = lambda p, origin, v: F.struct(p.alias("property"), F.lit(ORIGINS[origin]).alias("origin"), F.lit(0).cast(order).alias("source_order"), v.alias("value"))
    own = lambda c, origin: F.coalesce(F.transform(F.filter(F.map_entries(c), lambda e: e["value"].isNotNull()), lambda e: one(e["key"], origin, e["value"])), F.array()).cast(kind)
    selves = nodes.select(*by, "id", F.concat(own("attributes", "presentation-attribute"), own("inline", "inline-style")).alias("g"))
    ruled = _by_class(nodes, rules, theme, by).where("value IS NOT NULL").select(*by, "id", F.array(F.struct("property", "origin", "source_order", "value")).cast(kind).alias("g"))
    given = selves.unionByName(ruled).groupBy(*by, "id").agg(F.flatten(F.collect_list("g")).alias("g"))
    weakest = F.array(*[one(F.lit(p), "default", F.lit(v)) for p, v in DEFAULTS.items()]).cast(kind)
    every = given.select(*by, "id", F.concat("g", weakest).alias("g"))
    strongest = lambda p: F.array_max(F.transform(F.filter("g", lambda x: x["property"].eqNullSafe(p)), lambda x: F.struct(x["origin"].alias("origin"), x["source_order"].alias("source_order"), x["value"].alias("value"))))
    best = F.transform(F.array_distinct(F.transform("g", lambda x: x["property"])), lambda p: F.struct(p.alias("property"), strongest(p).alias("b")))
    names = F.create_map(*[F.lit(x) for k, v in ORIGINS.items() for x in (v, k)])
    out = every.select(*by, "id", F.explode(best).alias("s"))
    return out.select(*by, "id", "s.property", F.col("s.b.value").alias("value"), names[F.col("s.b.origin")].alias("origin"))


def style_value(prop: Column | str, expression: Column | str) -> Column:
    """Struct (text, number, code): the value that an expression gives a property, or why it gives none.

    Paints are none or #rrggbb, lengths plain numbers or pixels, opacity is within 0 and 1, weight 400 or 700, and a font
    is one concrete family. ``code`` is null for a good value, FONT for a bad family, weight or slant, UNKNOWN for another
    property, else VALUE. A null expression is a bad value.
    """
    p, given = (F.col(c) if isinstance(c, str) else c for c in (prop, expression))
    e = F.regexp_replace(F.coalesce(given, F.lit("")), r"^\s+|\s+$", "")
    low = F.lower(e)
    # The word before an open bracket names a function; the word after an exclamation mark, a flag.
    before = F.transform(F.slice(F.split(low, "[(]"), F.lit(1), F.size(F.split(low, "[(]")) - 1), lambda t: F.regexp_extract(t, r"(\w*)\s*$", 1))
    flags = F.transform(F.slice(F.split(low, "!"), F.lit(2), F.size(F.split(low, "!"))), lambda t: F.regexp_extract(t, r"^\s*(\w*)", 1))
    banned = (e == "") | low.isin(*WIDE_KEYWORDS) | F.arrays_overlap(before, F.lit(list(FORBIDDEN_FUNCTIONS))) | F.array_contains(flags, "important")
    number = strict_number(F.regexp_replace(low, "px$", ""))
    finite = number.isNotNull() & (F.abs(number) < float("inf"))
    # A family is a string without escapes and line ends, or identifiers with spaces between them.
    inner, mark = F.substr(e, F.lit(2), F.length(e) - 2), F.left(e, F.lit(1))
    quoted = (F.length(e) > 2) & mark.isin("'", '"') & (F.right(e, F.lit(1)) == mark) & ~F.contains(inner, mark) & (F.translate(inner, "\\\r\n", "") == inner)
    words = F.split(e, r"\s+")
    family = F.when(quoted, inner).when(F.forall(words, lambda w: w.rlike(r"^-?[A-Za-z_][\w-]*$")), F.array_join(words, " "))

    text = (
        F.when(p.isin("fill", "stroke") & low.rlike("^(?:none|#[0-9a-f]{6})$"), low)
        .when((p == "font-family") & ~F.lower(family).isin(*GENERIC_FAMILIES), family)
        .when(((p == "font-style") & low.isin(*WORD_VALUES["font-style"])) | ((p == "text-anchor") & low.isin(*WORD_VALUES["text-anchor"])), low)
    )
    value = (
        F.when((p == "stroke-width") & finite & (number >= 0), number)
        .when((p == "font-size") & finite & (number > 0), number)
        .when((p == "opacity") & ~low.endswith("px") & number.between(0, 1), number)
        .when((p == "font-weight") & e.isin("400", "700"), number)
    )
    known = p.isin(*DEFAULTS, "font-size", "font-family")
    bad = F.when(p.isin("font-family", "font-weight", "font-style") & ~banned, "FONT").otherwise("VALUE")
    code = F.when(~F.coalesce(known, F.lit(False)), "UNKNOWN").when(banned, "VALUE").when(text.isNull() & value.isNull(), bad)
    return F.struct(F.when(code.isNull(), text).alias("text"), F.when(code.isNull(), value).alias("number"), code.alias("code"))


def style_text(cascaded: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, style): the properties of each node in order, as one declaration list."""
    pairs = F.array_sort(F.collect_list(F.concat_ws(":", "property", "value")))
    return cascaded.groupBy(*by, "id").agg(F.array_join(pairs, ";").alias("style"))


def theme_parity(themes: DataFrame) -> DataFrame:
    """(theme_id, token): tokens that some theme has and this one lacks.

    A token's themes are one array, so what is made is what is missing. Themes are few, and are named in one row.
    """
    pairs = themes.select("theme_id", "token").distinct()
    every = pairs.agg(F.array_sort(F.collect_set("theme_id")).alias("every"))
    # One row with the names of all themes meets the tokens; a token's row says which it lacks.
    held = pairs.groupBy("token").agg(F.collect_set("theme_id").alias("held")).crossJoin(F.broadcast(every))
    return held.select(F.explode(F.array_except("every", "held")).alias("theme_id"), "token")


def token_uses(uses: DataFrame, themes: DataFrame, valid: Column) -> DataFrame:
    """(property, token, theme_id, valid): each use of a token under each theme that has it, and whether its value fits."""
    return uses.select("property", "token").distinct().join(themes, "token").select("property", "token", "theme_id", valid.alias("valid"))


def calibration(samples: DataFrame, by: str, measured_col: str, oracle_col: str, absolute: float = 0.75, relative: float = 0.01) -> DataFrame:
    """By group: the largest absolute and relative deviation of measured widths from an oracle's, whether each sample is
    within one of the tolerances, and how far rounding to whole pixels may move their sum."""
    d, share = F.abs(F.col(measured_col) - F.col(oracle_col)), F.try_divide(F.abs(F.col(measured_col) - F.col(oracle_col)), F.abs(F.col(oracle_col)))
    within = (d <= absolute) | F.coalesce(share <= relative, F.lit(False))
    envelope = F.sum(F.abs(F.floor(F.col(measured_col) + 0.5) - F.col(measured_col)))
    return samples.groupBy(by).agg(F.max(d).alias("max_absolute"), F.max(share).alias("max_relative"), F.bool_and(within).alias("all_within"), envelope.alias("envelope"))


def world_offsets(nodes: DataFrame) -> DataFrame:
    """(id, world_x, world_y): the translations of all ancestors and of the node itself, summed from the root down.

    Sums of an ordered array, so floating point results do not depend on the order of a shuffle.
    """
    steps = nodes.select("id", F.posexplode("ancestor_ids").alias("k", "at")).join(nodes.select(F.col("id").alias("at"), "tx", "ty"), "at")
    above = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "tx", "ty"))).alias("s"))
    total = lambda c: F.aggregate(F.coalesce("s", F.array().cast("array<struct<k:int,tx:double,ty:double>>")), F.lit(0.0), lambda a, x: a + x[c]) + F.col(c)
    typed = nodes.withColumns({c: F.col(c).cast("double") for c in ("tx", "ty")})
    return typed.join(above.select("id", F.transform("s", lambda x: F.struct(x["k"].alias("k"), x["tx"].cast("double").alias("tx"), x["ty"].cast("double").alias("ty"))).alias("s")), "id", "left").select("id", total("tx").alias("world_x"), total("ty").alias("world_y"))


def group_bounds(leaves: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, x, y, width, height): each ancestor's union of its leaves' rectangles. Minima compose, so one pass does."""
    each = leaves.select(*by, F.explode("ancestor_ids").alias("id"), "x", "y", (F.col("x") + F.col("width")).alias("r"), (F.col("y") + F.col("height")).alias("b"))
    out = each.groupBy(*by, "id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("r").alias("r"), F.max("b").alias("b"))
    return out.select(*by, "id", "x", "y", (F.col("r") - F.col("x")).alias("width"), (F.col("b") - F.col("y")).alias("height"))


def palette_hash(styles: DataFrame, by: str, *columns: str) -> DataFrame:
    """SHA-256 of the sorted distinct style tuples of each group."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    return styles.groupBy(by).agg(F.sha2(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set(row)), ","), F.lit("]")), 256).alias("palette_sha256"))


def fit_lines(lines: DataFrame, width: Column, near_limit: float = 0.9) -> DataFrame:
    """Adds room, status and utilisation to lines (anchor, anchor_x, frame_x, frame_width) of a measured width."""
    room = available_width("anchor", "anchor_x", "frame_x", "frame_width")
    out = lines.withColumn("width", width).withColumn("available", room)
    return out.withColumn("status", fit_status("width", "available", near_limit)).withColumn("utilisation", utilisation("width", "available"))


def fit_summary(fitted: DataFrame, *by: str) -> DataFrame:
    return fitted.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(f"n_{s.replace('-', '_')}") for s in ("clear", "near-limit", "overflow", "unverified")])


def worst_of(a: Column, b: Column) -> Column:
    """The worse of two fit statuses: overflow, unverified, near-limit, clear."""
    order = ["clear", "near-limit", "unverified", "overflow"]
    rank = lambda c: F.array_position(F.lit(order), c)
    return F.element_at(F.lit(order), F.greatest(rank(a), rank(b)).cast("int"))


def measured(lines: DataFrame, measurer, text_col: str = "text") -> DataFrame:
    """Adds width by a caller's function of a pandas Series of texts.

    A text that it refuses (ValueError, or no finite number of 0 or more) has a null width and its batch fellows theirs;
    any other exception is a mistake in the function and ends the query.
    """

    def one_by_one(texts: pd.Series) -> list:
        out: list = []
        for k in range(len(texts)):
            try:
                out += list(measurer(texts.iloc[k : k + 1]))
            except ValueError:
                out.append(None)
        return out

    @F.pandas_udf("double")
    def width(texts: pd.Series) -> pd.Series:
        try:
            found = list(measurer(texts))
        except ValueError:
            found = one_by_one(texts)
        got = pd.to_numeric(pd.Series(found, index=texts.index), errors="coerce").astype("float64")
        return got.where(got.ge(0) & got.lt(float("inf")))

    return lines.withColumn("width", width(text_col))
