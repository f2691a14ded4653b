"""A scanner that knows where everything stands, and the operators that rewrite or read sources by such ranges."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalars import splice
from docloom.sources import xml_tree as T

# The tokens of a style sheet, of JSON, and of the attributes within a tag.
CSS = r"""(?s)/\*.*?\*/|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|\\.|[{}();:,]|\[|\]|\s+|[^\s{}();:,\[\]"'\\/]++|."""
JSON = r'''"(?:[^"\\]|\\.)*+"|[{}\[\]:,]|[^\s{}\[\]:,"]+|\s+'''
DOC = ("doc_id",)


_CSS, _MARGIN, _DESCRIBING = re.compile(CSS, re.ASCII), re.compile(r"^\s+|\s+\Z", re.ASCII), re.compile("@(font-face|page)")
_SPACES = re.compile(r"\s+", re.ASCII)


def _by_text(docs: DataFrame, by: tuple[str, ...], text_col: str, read: Callable[[str], Iterable], columns: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """(by, columns): the rows that ``read`` gives for each text, where the text is: nothing is shuffled or sorted."""
    given = docs.select(*by, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    n, names, own = len(by), [*by, *columns], [t for _, t in columns.values()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types, rows = [*batch.schema.types[:n], *own], []
            frame = lambda rows, types=types: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            keys = zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True)
            for key, text in zip(keys, batch.column(n), strict=True):
                rows += [(*key, *row) for row in read(text.as_py())]
                if len(rows) >= _MOST_ROWS:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

    head = [f"`{c}` {given.schema[c].dataType.simpleString()}" for c in by]
    return given.mapInArrow(each, ", ".join([*head, *(f"`{c}` {kind}" for c, (kind, _) in columns.items())]))


def _statements(text: str) -> tuple[list[dict], list[tuple[str, int]]]:
    """Statements of a style sheet, with their nesting and the braces that end them, and its faults."""
    found, faults, at, soft, depth, under = [], [], 0, 0, 0, None
    now: dict = {}

    def begin(level: int) -> None:
        nonlocal now
        now = {"said": [], "colon": None, "start": None, "end": None, "level": level, "ended": None}

    begin(0)
    for t in _CSS.findall(text):
        soft += (t in ("(", "[")) - (t in (")", "]"))
        # Brackets hide what is in them; what closes too much is no bracket.
        inside = soft > 0 or t in (")", "]")
        if not inside and t in (";", "{", "}"):
            now["ended"] = t
            found.append(now)
            depth += (t == "{") - (t == "}")
            if depth < 0 and under is None:
                under = at
            begin(depth)
        else:
            comment = t.startswith("/*")
            if not inside and t == ":" and now["colon"] is None:
                now["colon"] = len(now["said"])
            now["said"].append(" " if comment else t)
            if not comment and _SPACES.fullmatch(t) is None:
                now["start"] = at if now["start"] is None else now["start"]
                now["end"] = at + len(t)
        at += len(t)
    if now["said"]:
        found.append(now)
    if under is not None:
        faults.append(("UNOPENED", under))
    if depth > 0:
        faults.append(("UNCLOSED", at))
    return found, faults


def _declarations(text: str) -> Iterator[tuple]:
    """(rule, context, selector, ordinal, property, value, start, end) of each declaration of a style sheet."""
    joined = lambda pieces: _MARGIN.sub("", "".join(pieces))
    # The preludes that are open where a statement stands: the last one at each level above it.
    opened: dict[int, tuple[int, str]] = {}
    ordinals: dict[int, int] = {}
    for k, s in enumerate(_statements(text)[0]):
        level = s["level"]
        rule = opened.get(level - 1) if level in (1, 2) else None
        if rule and s["colon"] is not None and s["ended"] != "{" and (not rule[1].startswith("@") or _DESCRIBING.match(rule[1])):
            context = opened[0][1] if level == 2 else ""
            ordinal = ordinals[rule[0]] = ordinals.get(rule[0], -1) + 1
            yield rule[0], context, rule[1], ordinal, joined(s["said"][: s["colon"]]), joined(s["said"][s["colon"] + 1 :]), s["start"], s["end"]
        if s["ended"] == "{" and level in (0, 1):
            opened[level] = k, joined(s["said"])


def css_rules(sheets: DataFrame, by: tuple[str, ...] = DOC, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(declarations, faults) of style sheets (by, text), read sheet by sheet where they are.

    Declarations are (by, rule, context, selector, ordinal, property, value, start, end), with places in characters: ``context`` is
    the prelude of the block around the rule (``@media ...``), empty for none. The text is cut into tokens; how deep a token
    stands is counted over them, so a semicolon, colon or brace splits only where its own nesting says so: inside
    strings, comments, brackets and parentheses it is text. Faults are (by, code, at): UNCLOSED and UNOPENED blocks.
    """
    text, number = ("string", pa.string()), ("long", pa.int64())
    columns = {"rule": number, "context": text, "selector": text, "ordinal": ("int", pa.int32()), "property": text, "value": text, "start": number, "end": number}
    declarations = _by_text(sheets, by, text_col, _declarations, columns).withColumn("property", F.lower("property"))
    return declarations, _by_text(sheets, by, text_col, lambda x: _statements(x)[1], {"code": text, "at": number})


_PIECES = re.compile(r"""(?s)^<[^\s/>]+|\s+|[^\s=/>"']+\s*=\s*(?:"[^"]*"|'[^']*')|[^\s=/>"']+(?:\s*=\s*[^\s"'>]+)?|.""", re.ASCII)
_NAME, _GIVEN = re.compile(r"""[^\s=/>"'<]+""", re.ASCII), re.compile(r"(?s)=\s*(.*)\Z", re.ASCII)
_TAG = re.compile(r"<([^\s/>]+)", re.ASCII)
_EDITS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())]))


def _family_edits(text: str, old: str, new: str) -> list[dict]:
    """The edits of ``family_edits`` of one text, in order."""
    found, prefix, own = [], f"data-{old}-", f"--{old}-"
    edit = lambda kind, at, what, by: {"kind": kind, "start": at, "end": at + len(what), "replacement": by}

    def sheet(at: int, css: str) -> None:
        for t in _CSS.findall(css) if own in css else ():
            if t.startswith(own):
                found.append(edit("custom-property", at, own, f"--{new}-"))
            at += len(t)

    at, styled = int(text.startswith("\ufeff")), False
    for raw in T._TOKEN.findall(text[at:]):
        if raw[0] != "<" or raw.startswith("<![CDATA["):
            # A style sheet is one text, though a scanner of tags may have cut it.
            if styled:
                sheet(at, raw)
        elif raw[1:2] not in ("!", "?", ""):
            place = at
            for k, piece in enumerate(_PIECES.findall(raw) if raw[1] != "/" else ()):
                name = _NAME.match(piece) if k else None
                if name and name[0].startswith(prefix):
                    found.append(edit("attribute", place, prefix, f"data-{new}-"))
                elif name and name[0].lower() == "style" and (given := _GIVEN.search(piece)):
                    quoted = given[1][:1] in ("'", '"')
                    sheet(place + given.start(1) + quoted, given[1][1:-1] if quoted else given[1])
                place += len(piece)
            if not raw.endswith("/>") or raw[1] == "/":
                tag = _TAG.match(raw)
                styled = raw[1] != "/" and tag is not None and tag[1].lower() == "style"
        at += len(raw)
    return found


def _edits_of(text: Column, old: str, new: str) -> Column:
    @F.arrow_udf("array<struct<kind:string,start:int,end:int,replacement:string>>")
    def edits(texts: pa.Array) -> pa.Array:
        return pa.array((_family_edits(t.as_py(), old, new) for t in texts), _EDITS)

    return edits(F.coalesce(text, F.lit("")))


def family_edits(docs: DataFrame, old: str, new: str, by: tuple[str, ...] = DOC, text_col: str = "text") -> DataFrame:
    """(by, kind, start, end, replacement): the places where a family is named as markup: in the names of attributes, and in
    custom properties within style attributes and style sheets. What only looks like it in prose, comments or other values is
    in no range. A text is read in its row, and its places count from its first character."""
    return docs.select(*by, F.explode(_edits_of(F.col(text_col), old, new)).alias("_e")).select(*by, "_e.kind", *[F.col(f"_e.{c}").cast("long").alias(c) for c in ("start", "end")], "_e.replacement")


def migrate(docs: DataFrame, old: str, new: str, by: tuple[str, ...] = DOC, text_col: str = "text") -> DataFrame:
    """The documents with a family renamed by splices on its ranges, and (n_edits, proven): whether the new source has exactly
    the markup of the old one under the new name. A document without the family is unchanged and proven."""
    text, after = F.col(text_col), F.col("_after")
    count = lambda column, a, b: F.size(_edits_of(column, a, b))
    pieces = F.transform("_edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("replacement")))
    out = docs.select("*", _edits_of(text, old, new).alias("_edits"), count(text, new, old).alias("_had")).withColumn("n_edits", F.size("_edits"))
    out = out.withColumn("_pieces", pieces).withColumn("_after", F.when(F.col("n_edits") > 0, splice(text_col, "_pieces")).otherwise(text)).drop("_pieces")
    out = out.select("*", count(after, old, new).alias("_left"), count(after, new, old).alias("_new"))
    proven = (F.col("_left") == 0) & (F.col("_new") == F.col("_had") + F.col("n_edits"))
    return out.select(*by, *[c for c in docs.columns if c not in (*by, text_col)], after.alias(text_col), "n_edits", proven.alias("proven"))


def json_fields(docs: DataFrame, by: tuple[str, ...] = DOC, text_col: str = "text") -> DataFrame:
    """(by, k, depth, parent, step_name, kind, start, end, raw): every value of JSON texts with its place in the source.

    ``parent`` is the value it stands in and ``step_name`` its key or place there; ``with_paths`` puts these together. Depth is a running sum over tokens, and what
    a token stands in is the last open bracket one level up, so nothing is parsed twice and no text is put together again.
    """
    found = docs.select(*by, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(JSON), F.lit(0))).alias("k", "t"))
    order = Window.partitionBy(*by).orderBy("k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("t")
    step = F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
    placed = found.withColumn("at", F.coalesce(F.sum(F.length("t")).over(before), F.lit(0))).where(~t.rlike(r"^\s+$")).withColumn("step", step)
    placed = placed.withColumn("depth", F.sum("step").over(order) - F.when(F.col("step") == 1, 1).otherwise(0))
    # Within a level, tokens after an open bracket one level up belong to it: brackets are numbered, and commas count places.
    rows = placed.withColumn("role", F.explode(F.array(F.struct(F.lit(0).alias("asks"), (F.col("depth") + 1).alias("level")), F.struct(F.lit(1).alias("asks"), F.col("depth").alias("level")))))
    rows = rows.where("role.asks = 1 OR step = 1").select(*placed.columns, "role.*")
    within = Window.partitionBy(*by, "level").orderBy("k", "asks")
    held = F.last(F.when((F.col("asks") == 0) & (F.col("step") == 1), F.struct("k", "t")), ignorenulls=True).over(within)
    rows = rows.withColumn("in", held).where("asks = 1")
    own = Window.partitionBy(*by, "depth", "in.k").orderBy("k")
    place = F.sum(F.when(t == ",", 1).otherwise(0)).over(own)
    is_key = F.lead("t").over(own) == ":"
    key = F.last(F.when(is_key, F.expr("substring(t, 2, length(t) - 2)")), ignorenulls=True).over(own)
    named = rows.withColumns({"place": place, "is_key": F.coalesce(is_key, F.lit(False)), "key": key})
    # An open bracket ends at the first close of its level after it.
    first = F.first(F.when(F.col("step") == -1, F.col("at") + 1), ignorenulls=True).over(Window.partitionBy(*by, "depth").orderBy("k").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    values = named.withColumn("until", first).where("step >= 0 AND NOT is_key AND t NOT IN (',', ':')").withColumn("step_name", F.when(F.col("in").isNull(), "").when(F.col("in.t") == "[", F.col("place").cast("string")).otherwise(F.col("key")))
    end = F.when(F.col("step") == 1, F.col("until")).otherwise(F.col("at") + F.length("t"))
    kind = F.when(t == "{", "object").when(t == "[", "array").when(t.startswith('"'), "string").when(t.isin("true", "false"), "boolean").when(t == "null", "null").otherwise("number")
    return values.select(*by, "k", "depth", F.col("in.k").alias("parent"), "step_name", kind.alias("kind"), F.col("at").alias("start"), end.alias("end"), F.when(F.col("step") == 0, t).alias("raw"))


def with_paths(values: DataFrame, by: tuple[str, ...] = DOC, most: int = 64) -> DataFrame:
    """``json_fields`` with ``path``, the names from the root down after a slash each, and ``shape``, the same with ``*`` for places
    in arrays; by joins on the holding value, level by level of the deepest text.

    Texts nested deeper than ``most`` are refused with an error.
    """
    deepest = values.agg(F.max("depth")).first()[0] or 0
    if deepest > most:
        raise ValueError(f"values are nested {deepest} deep, over {most}")
    out = last = values.where("depth = 0").withColumns({"path": F.lit(""), "shape": F.lit("")})
    for d in range(1, deepest + 1):
        above = last.select(*by, F.col("k").alias("parent"), F.col("path").alias("_path"), F.col("shape").alias("_shape"), F.col("kind").alias("_kind"))
        step = F.when(F.col("_kind") == "array", "*").otherwise(F.col("step_name"))
        last = values.where(F.col("depth") == d).join(above, [*by, "parent"]).select(*values.columns, F.concat("_path", F.lit("/"), "step_name").alias("path"), F.concat("_shape", F.lit("/"), step).alias("shape"))
        out = out.unionByName(last)
    return out


_JSON, _BLANK = re.compile(JSON, re.ASCII), re.compile(r"\s+\Z", re.ASCII)
_VALUE = "k int, depth long, parent int, step_name string, kind string, start long, end long, raw string, path string, shape string, holder string, names array<string>"
_VALUE_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.list_(pa.string())]
_MOST_ROWS = 1 << 14


def _kind(t: str) -> str:
    named = {"{": "object", "[": "array", "true": "boolean", "false": "boolean", "null": "null"}.get(t)
    return named or ("string" if t[0] == '"' else "number")


def _json_rows(text: str, most: int) -> list[list]:
    """The columns of ``_VALUE`` of each value. A stretch is what one bracket holds on one level: its commas are counted and its
    last key is kept."""
    tokens, at = [], 0
    depth, opened, unclosed = 0, {}, {}
    for k, t in enumerate(_JSON.findall(text)):
        if not _BLANK.match(t):
            depth -= t in "}]"
            tokens.append([k, t, at, depth, opened.get(depth - 1), None])
            if t in "{[":
                opened[depth] = tokens[-1]
                unclosed.setdefault(depth, []).append(tokens[-1])
                depth += 1
            elif t in "}]":
                # An open bracket ends at the first close of its level after it.
                for x in unclosed.pop(depth, ()):
                    x[5] = at + 1
        at += len(t)
    after: dict[tuple, list] = {}
    keys = set()
    for x in tokens:
        own = (x[3], x[4] and x[4][0])
        if x[1] == ":" and own in after:
            keys.add(after[own][0])
        after[own] = x
    rows, places, last, known = [], {}, {}, {}
    for k, t, start, level, holder, until in tokens:
        own = (level, holder and holder[0])
        if t == ",":
            places[own] = places.get(own, 0) + 1
        elif k in keys:
            last[own] = t[1:-1]
        elif t not in "}]:":
            inside = holder is not None
            name = "" if not inside else str(places.get(own, 0)) if holder[1] == "[" else last.get(own)
            path = shape = ""
            above = known.get(holder[0]) if inside else None
            if level > 0:
                if level > most:
                    raise ValueError(f"values are nested {level} deep, over {most}")
                if above is None:
                    continue
                path = None if name is None or above[8] is None else f"{above[8]}/{name}"
                step = "*" if above[4] == "array" else name
                shape = None if step is None or above[9] is None else f"{above[9]}/{step}"
                above[11].append(name)
            elif level < 0:
                continue
            bracket = t in "{["
            row = [k, level, holder[0] if inside else None, name, _kind(t), start, until if bracket else start + len(t), None if bracket else t, path, shape, above[9] if above and above[4] == "object" else None, [] if bracket else None]
            rows.append(row)
            if bracket:
                known[k] = row
    return rows


def read_json(docs: DataFrame, by: tuple[str, ...] = DOC, text_col: str = "text", most: int = 64) -> DataFrame:
    """The rows of ``with_paths`` of the ``json_fields`` of JSON texts, read text by text where they are: nothing is shuffled or sorted.

    Two columns more: ``holder``, the shape of the object that a value stands in, and ``names`` of what an object or array holds.
    """
    columns = {x.split()[0]: (x.split()[1], t) for x, t in zip(_VALUE.split(", "), _VALUE_TYPES, strict=True)}
    return _by_text(docs, by, text_col, lambda text: _json_rows(text, most), columns)
