"""XML parts shredded into node rows: tokens with their places, elements with parents, expanded names and faults.

A part's text is cut into tokens by one expression, depth is a running sum over them, and a parent is the last open tag
one level up. Elements are numbered by their token, so an element's subtree is the interval from ``node`` to ``close`` and
containment is a comparison of numbers. A part arrives whole in a row, so ``read_elements`` shreds it there: nothing is shuffled
or sorted. ``elements`` says the same of token rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The tokens of XML, a name, an attribute, the namespace that needs no declaration.
TOKEN = r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![A-Z][^<>]*>|</[^<>]*>|<[A-Za-z_:][^<>"']*+(?:(?:"[^"<]*+"|'[^'<]*+')[^<>"']*+)*+>|[^<]++|<"""
NAME = r"[A-Za-z_][\w.\-]*(?::[A-Za-z_][\w.\-]*)?"
ATTRIBUTE = r"""([^\s=<>/"']+)\s*=\s*("[^"]*"|'[^']*')"""
XML_SPACE = "http://www.w3.org/XML/1998/namespace"
BY = ("package", "name")


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def decoded(x: Column) -> Column:
    """Text with its five named entities and its numeric references resolved."""
    number = lambda p: F.when(p.startswith("&#x"), F.regexp_extract(p, "^&#x([0-9A-Fa-f]+);$", 1)).otherwise(F.conv(F.regexp_extract(p, "^&#([0-9]+);$", 1), 10, 16))
    char = lambda p: F.decode(F.unhex(F.lpad(number(p), 8, "0")), "UTF-32")
    pieces = F.regexp_extract_all(x, F.lit(r"(?s)&#(?:x[0-9A-Fa-f]{1,6}|[0-9]{1,7});|[^&]+|&"), F.lit(0))
    out = F.when(F.contains(x, F.lit("&#")), F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^&#"), char(p)).otherwise(p)), "")).otherwise(x)
    for code, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return F.when(F.contains(x, F.lit("&")), out).otherwise(x)


def tokens(parts: DataFrame, by: tuple[str, ...] = BY, text: Column | None = None) -> DataFrame:
    """(by, node, at, kind, raw, depth) of every token of parts with ``content``, or with a text given as a column.

    ``at`` counts characters before the token. Kinds are open, close, empty, text, cdata, comment, instruction, doctype and
    stray. An element's own tokens have its depth, 1 for the root; text has the depth of the element it stands in.
    """
    xml = text if text is not None else F.decode("content", "UTF-8")
    found = parts.select(*by, F.posexplode(F.regexp_extract_all(F.regexp_replace(xml, "^\\x{FEFF}", ""), F.lit(TOKEN), F.lit(0))).alias("node", "raw"))
    r = F.col("raw")
    kind = (
        F.when(r.startswith("<!--"), "comment").when(r.startswith("<![CDATA["), "cdata").when(r.startswith("<?"), "instruction").when(r.startswith("<!"), "doctype")
        .when(r.startswith("</"), "close").when(r == "<", "stray").when(r.startswith("<") & r.endswith("/>"), "empty").when(r.startswith("<"), "open").otherwise("text")
    )
    order = Window.partitionBy(*by).orderBy("node")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    depth = F.sum(step).over(order) + F.when(F.col("kind").isin("close", "empty"), 1).otherwise(0)
    at = F.coalesce(F.sum(F.length("raw")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("kind", kind).select(*by, "node", at.alias("at"), "kind", "raw", depth.cast("int").alias("depth"))


def _tag(raw: Column) -> Column:
    return F.regexp_extract(raw, rf"^</?({NAME})(?=[\s/>])", 1)


def _pairs(raw: Column) -> Column:
    """The attributes of a tag as written, names with their prefixes; none where a name stands twice."""
    none = F.create_map().cast("map<string,string>")
    values = F.transform(F.regexp_extract_all(raw, F.lit(ATTRIBUTE), F.lit(2)), lambda v: decoded(F.substr(v, F.lit(2), F.length(v) - 2)))
    found = let(F.regexp_extract_all(raw, F.lit(ATTRIBUTE), F.lit(1)), lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(none))
    return F.when(F.contains(raw, F.lit("=")), found).otherwise(none)


def _placed(found: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Tokens with ``above``: the open tag (node, raw) they stand in, and for a close tag the one it closes."""
    opens = F.when(F.col("kind") == "open", F.struct("node", "raw"))
    asks = F.when(F.col("kind").isin("open", "empty"), F.col("depth") - 1).otherwise(F.col("depth"))
    roles = F.array(F.struct(F.lit(False).alias("asks"), F.col("depth").alias("level")), F.struct(F.lit(True).alias("asks"), asks.alias("level")))
    rows = found.withColumn("role", F.explode(roles)).where("role.asks OR kind = 'open'").select(*found.columns, "role.*")
    # An open tag is known before the tokens of its level that follow it.
    last = F.last(F.when(~F.col("asks"), opens), ignorenulls=True).over(Window.partitionBy(*by, "level").orderBy("node", "asks"))
    return rows.withColumn("above", last).where("asks").drop("asks", "level")


def elements(found: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """From ``tokens``: (by, node, close, parent, depth, tag, parent_tag, attributes, text, start, inner, until, end).

    ``tag`` and the names of attributes are ``{namespace}local``, or the local name alone where no namespace holds; namespace
    declarations are not attributes. ``text`` is the element's own character data. The element is the characters from
    ``start`` to ``end``, its content those from ``inner`` to ``until``. Where a part is not well-formed, its rows say what
    could be read; ``faults`` tells.
    """
    placed = _placed(found, by)
    is_tag, after = F.col("kind").isin("open", "empty"), F.col("at") + F.length("raw")
    own = F.when(F.col("kind") == "cdata", F.expr("substring(raw, 10, length(raw) - 12)")).otherwise(decoded(F.col("raw")))
    # An element's tag, its close tag and its texts meet under its number; all stay where the part is.
    known = placed.where("kind IN ('open', 'empty') OR (kind IN ('close', 'text', 'cdata') AND above IS NOT NULL)").groupBy(*by, F.when(is_tag, F.col("node")).otherwise(F.col("above.node")).alias("element")).agg(
        F.min(F.when(is_tag, F.struct("node", "depth", "raw", "above", F.col("at").alias("start"), after.alias("inner")))).alias("t"),
        F.min(F.when(F.col("kind") == "close", F.struct(F.col("node").alias("close"), F.col("at").alias("until"), after.alias("end")))).alias("c"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin("text", "cdata"), F.struct("node", own.alias("t"))))), lambda x: x["t"]), "").alias("text"),
    ).where("t IS NOT NULL").select(*by, "t.*", "c", "text")
    known = known.withColumns({"given": _pairs(F.col("raw")), "close": F.coalesce("c.close", "node")})
    spaces = F.filter(F.map_entries("given"), lambda e: e["key"].rlike("^xmlns(:|$)"))
    declared = F.transform(spaces, lambda e: F.struct(F.regexp_replace(e["key"], "^xmlns:?", "").alias("prefix"), F.col("node").alias("node"), F.col("close").alias("close"), e["value"].alias("uri")))
    bound = F.flatten(F.collect_list(F.when(F.size(spaces) > 0, declared)).over(Window.partitionBy(*by)))
    known = known.withColumn("spaces", bound)

    def expanded(name: Column, node: Column) -> Column:
        prefix = lambda n: F.when(F.contains(n, F.lit(":")), F.substring_index(n, ":", 1)).otherwise("")
        local = lambda n: F.substring_index(n, ":", -1)
        held = lambda n: F.filter("spaces", lambda s: (s["prefix"] == prefix(n)) & (s["node"] <= node) & (s["close"] >= node))
        uri = lambda n: F.when(prefix(n) == "xml", XML_SPACE).otherwise(F.array_max(F.transform(held(n), lambda s: F.struct(s["node"], s["uri"])))["uri"])
        return let(name, lambda n: let(uri(n), lambda u: F.when(u.isNull() | (u == ""), n).otherwise(F.concat(F.lit("{"), u, F.lit("}"), local(n)))))

    # Few attributes have a prefix; a map without one is kept as it is.
    plain = F.map_filter("given", lambda k, v: ~k.rlike("^xmlns(:|$)"))
    named = F.transform(F.map_entries(plain), lambda e: F.struct(F.when(F.contains(e["key"], F.lit(":")), expanded(e["key"], F.col("node"))).otherwise(e["key"]).alias("key"), e["value"].alias("value")))
    whole = let(named, lambda n: F.when(F.size(F.array_distinct(F.transform(n, lambda e: e["key"]))) == F.size(n), F.map_from_entries(n)).otherwise(F.create_map().cast("map<string,string>")))
    attributes = F.when(F.exists(F.map_keys("given"), lambda k: F.contains(k, F.lit(":")) & ~k.startswith("xmlns:")), whole).otherwise(plain)
    tag = lambda raw, node: expanded(_tag(raw), node)
    out = known.withColumns({"tag": tag(F.col("raw"), F.col("node")), "parent_tag": F.when(F.col("above").isNotNull(), tag(F.col("above.raw"), F.col("above.node"))), "attributes": attributes})
    return out.select(*by, "node", "close", F.col("above.node").alias("parent"), "depth", "tag", "parent_tag", "attributes", "text", "start", "inner", F.coalesce("c.until", "inner").alias("until"), F.coalesce("c.end", "inner").alias("end"))


_TOKEN, _ATTRIBUTE, _OPEN = re.compile(TOKEN), re.compile(ATTRIBUTE, re.ASCII), re.compile(rf"</?({NAME})(?=[\s/>])", re.ASCII)
_NUMBER = re.compile("&#(?:x([0-9A-Fa-f]{1,6})|([0-9]{1,7}));")
_NODE = "node int, close int, parent int, depth int, tag string, parent_tag string, attributes map<string,string>, text string, start long, inner long, until long, end long"
_ARROW = [pa.int32()] * 4 + [pa.string()] * 2 + [pa.map_(pa.string(), pa.string()), pa.string()] + [pa.int64()] * 4
_HOLDER = pa.struct([("node", pa.int32()), ("tag", pa.string()), ("depth", pa.int32())])


def _holders(found: tuple) -> pa.Array:
    """Holders (node, tag, depth), or none, as a column."""
    none = pa.array([h is None for h in found])
    return pa.StructArray.from_arrays([pa.array([h and h[k] for h in found], f.type) for k, f in enumerate(_HOLDER)], fields=list(_HOLDER), mask=none)


#: Rows of one batch that leaves a task.
_MOST_ROWS = 1 << 14


def _char(found: re.Match) -> str:
    number = int(found[1], 16) if found[1] else int(found[2])
    return chr(number) if number < 0xD800 or 0xDFFF < number < 0x110000 else "\ufffd"


def _plain(x: str) -> str:
    """``decoded`` of one text."""
    if "&" not in x:
        return x
    if "&#" in x:
        x = _NUMBER.sub(_char, x)
    return x.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&apos;", "'").replace("&amp;", "&")


class _Element:
    __slots__ = ("node", "depth", "raw", "above", "start", "inner", "close", "until", "end", "texts", "tag", "pairs")

    def __init__(self, node: int, depth: int, raw: str, above: _Element | None, start: int):
        self.node, self.depth, self.raw, self.above, self.start = node, depth, raw, above, start
        self.inner = self.until = self.end = start + len(raw)
        self.close, self.texts, self.tag = None, None, None


def _placed_elements(text: str) -> list[_Element]:
    """Elements with the open tag above them, the place of their close tag and their own texts."""
    found, last, at, depth = [], {}, 0, 0
    for node, raw in enumerate(_TOKEN.findall(text)):
        if raw[0] != "<" or raw.startswith("<![CDATA["):
            if owner := last.get(depth):
                own = raw[9:-3] if raw[0] == "<" else _plain(raw)
                owner.texts = own if owner.texts is None else owner.texts + own
        elif raw[1:2] == "/":
            if (owner := last.get(depth)) and owner.close is None:
                owner.close, owner.until, owner.end = node, at, at + len(raw)
            depth -= 1
        elif raw[1:2] not in ("!", "?", ""):
            found.append(e := _Element(node, depth + 1, raw, last.get(depth), at))
            if raw[-2] != "/":
                depth += 1
                last[depth] = e
        at += len(raw)
    return found


@lru_cache(256)
def _read_tag(raw: str) -> tuple[str, dict[str, str]]:
    """The name of a tag and its attributes as written, none where a name stands twice."""
    name, pairs = _OPEN.match(raw), _ATTRIBUTE.findall(raw) if "=" in raw else []
    known = {k: _plain(v[1:-1]) for k, v in pairs}
    return name[1] if name else "", known if len(known) == len(pairs) else {}


def _named_elements(text: str) -> tuple[list[_Element], tuple | None]:
    """The elements of a text, with expanded names unless each prefix is declared once over all of them: then what the
    prefixes mean is told instead."""
    found, spaces = _placed_elements(text.removeprefix("\ufeff")), {}
    for e in found:
        if "xmlns" in e.raw:
            for k, uri in _read_tag(e.raw)[1].items():
                if k == "xmlns" or k.startswith("xmlns:"):
                    spaces.setdefault(k[6:], []).append((e.node, e.node if e.close is None else e.close, uri))
    if found and all(len(held) == 1 and held[0][0] <= found[0].node and held[0][1] >= found[-1].node for held in spaces.values()):
        return found, tuple((prefix, held[0][2]) for prefix, held in spaces.items())
    for e in found:
        e.tag, e.pairs = _expanded(e.raw, lambda prefix, node=e.node: next((u for low, high, u in reversed(spaces.get(prefix, ())) if low <= node <= high), ""))
    return found, None


def _expanded(raw: str, uri_of: Callable[[str], str]) -> tuple[str, list[tuple[str, str]]]:
    """The expanded name and attributes of a tag, by what its prefixes mean."""

    def expanded(name: str) -> str:
        prefix = name.partition(":")[0] if ":" in name else ""
        uri = XML_SPACE if prefix == "xml" else uri_of(prefix)
        return f"{{{uri}}}{name.rpartition(':')[2]}" if uri else name

    name, own = _read_tag(raw)
    pairs = [(expanded(k) if ":" in k else k, v) for k, v in own.items() if k != "xmlns" and not k.startswith("xmlns:")]
    return expanded(name), pairs if len({k for k, _ in pairs}) == len(pairs) else []


#: By use and meaning of prefixes, what has been told of a tag as written; what is remembered is bounded.
_TOLD: dict[tuple, dict[str, tuple]] = {}
_MOST_TOLD, _MOST_MEANINGS = 1 << 14, 64


def told_elements(text: str, use: Callable[[str, list[tuple[str, str]]], tuple]) -> Iterator[tuple[_Element, tuple]]:
    """The elements of a text, each with ``use`` of its expanded name and attributes, which begins with the name. Equal tags are
    looked at once."""
    found, meaning = _named_elements(text)
    if meaning is None:
        yield from ((e, use(e.tag, e.pairs)) for e in found)
        return
    if (use, meaning) not in _TOLD and len(_TOLD) >= _MOST_MEANINGS:
        _TOLD.clear()
    known, uris = _TOLD.setdefault((use, meaning), {}), dict(meaning)
    for e in found:
        if (told := known.get(e.raw)) is None:
            if len(known) >= _MOST_TOLD:
                known.clear()
            told = known[e.raw] = use(*_expanded(e.raw, lambda prefix: uris.get(prefix, "")))
        e.tag = told[0]
        yield e, told


def _pair(tag: str, pairs: list[tuple[str, str]]) -> tuple:
    return tag, pairs


def text_elements(text: str, anchors: tuple[frozenset[str], ...]) -> Iterator[tuple]:
    """The columns of ``_NODE`` of each element of a text, and the nearest of each kind of anchor that holds it."""
    held: list[_Element | None] = [None] * len(anchors)
    for e, (_, pairs) in told_elements(text, _pair):
        close = e.node if e.close is None else e.close
        around = []
        for i, tags in enumerate(anchors):
            if e.tag in tags:
                held[i] = e
            h = held[i]
            over = h is not None and (h.node if h.close is None else h.close) >= e.node
            around.append((h.node, h.tag, h.depth) if over else None)
        yield (e.node, close, e.above and e.above.node, e.depth, e.tag, e.above and e.above.tag, pairs, e.texts or "", e.start, e.inner, e.until, e.end, *around)


#: Parts that stand in every package, such as themes, are shredded once a worker; what is remembered is bounded.
_MOST_REMEMBERED = 1 << 14


@lru_cache(256)
def _remembered(text: str, anchors: tuple[frozenset[str], ...]) -> tuple[tuple, ...]:
    return tuple(text_elements(text, anchors))


def read_elements(parts: DataFrame, by: tuple[str, ...] = BY, text: Column | None = None, anchors: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The rows of ``elements`` of parts with ``content``, or with a text given as a column, read part by part where they are.

    ``anchors`` names tags by the name of a column each, which says (node, tag, depth) of the element of these tags that holds a
    row's element, as ``held_by`` asks for it.
    """
    xml = text if text is not None else F.decode("content", "UTF-8")
    given = parts.select(*by, xml.alias("_xml"))
    kinds, n = anchors or {}, len(by)
    tags = tuple(frozenset(t) for t in kinds.values())
    head = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in by)
    names = [*by, *(x.split()[0] for x in _NODE.split(", ")), *kinds]

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types, rows = [*batch.schema.types[:n], *_ARROW, *[_HOLDER] * len(tags)], []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True))

            def flush(types: list = types, rows: list = rows) -> pa.RecordBatch:
                columns = [pa.array(c, t) if t != _HOLDER else _holders(c) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                rows.clear()
                return pa.RecordBatch.from_arrays(columns, names=names)

            for key, x in zip(keys, batch.column(n), strict=True):
                if (one := x.as_py()) is not None:
                    for row in _remembered(one, tags) if len(one) <= _MOST_REMEMBERED else text_elements(one, tags):
                        rows.append((*key, *row))
                        if len(rows) == _MOST_ROWS:
                            yield flush()
            if rows:
                yield flush()

    return given.mapInArrow(shred, ", ".join([head, _NODE, *(f"`{c}` struct<node:int,tag:string,depth:int>" for c in kinds)]))


def held_by(found: DataFrame, anchor: str) -> DataFrame:
    """``anchored`` from ``read_elements`` with that column of anchors: the elements that one holds, without a look at others."""
    a = F.col(anchor)
    return found.where(a.isNotNull()).withColumns({"anchor": a["node"], "anchor_tag": a["tag"], "below": F.col("depth") - a["depth"]})


def faults(found: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """From ``tokens``: (by, code) of what keeps parts from being one well-formed, namespace-aware document without a DOCTYPE."""
    placed = _placed(found, by)
    raw, kind = F.col("raw"), F.col("kind")
    attributes = F.regexp_replace(F.regexp_replace(raw, rf"^<{NAME}", ""), rf"""\s+{NAME}\s*=\s*("[^"]*"|'[^']*')""", "")
    keys = F.regexp_extract_all(raw, F.lit(ATTRIBUTE), F.lit(1))
    is_tag = kind.isin("open", "empty")
    bad = (
        (kind == "stray") | ((kind == "close") & (F.col("above").isNull() | (_tag(raw) != _tag(F.col("above.raw"))) | ~raw.rlike(rf"^</{NAME}\s*>$")))
        | (is_tag & ((_tag(raw) == "") | ~attributes.rlike(r"^\s*/?>$") | (F.size(F.array_distinct(keys)) < F.size(keys))))
        | (kind.isin("text", "cdata") & F.col("above").isNull() & ((kind == "cdata") | ~raw.rlike(r"^\s*$")))
        | ((kind == "text") & (F.contains(raw, F.lit("]]>")))) | ((kind.isin("text") | is_tag) & raw.rlike(r"&(?!(?:lt|gt|amp|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)"))
        | ((kind == "comment") & F.substr(raw, F.lit(5), F.length(raw) - 7).rlike(r"--|-\z")) | raw.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]")
        | ((kind == "instruction") & raw.rlike(r"(?i)^<\?xml[\s?]") & (F.col("node") > 0)) | ((kind == "instruction") & ~raw.rlike(rf"(?s)^<\?{NAME}(\s.*)?\?>$"))
    )
    old = (kind == "instruction") & raw.rlike(r"^<\?xml\s") & ~raw.rlike(r"""^<\?xml\s+version\s*=\s*["']1\.0["']""")
    whole = placed.groupBy(*by).agg(
        F.bool_or(bad).alias("bad"), F.bool_or(kind == "doctype").alias("doctype"), F.bool_or(old).alias("old"),
        F.count_if(is_tag & (F.col("depth") == 1)).alias("roots"), F.sum(F.when(kind == "open", 1).when(kind == "close", -1).otherwise(0)).alias("open"),
    )
    loose = F.col("tag").rlike("^[^{]*:") | F.exists(F.map_keys("attributes"), lambda k: k.rlike("^[^{]*:"))
    named = elements(found, by).groupBy(*by).agg(F.bool_or(loose).alias("loose"))
    malformed = F.coalesce(F.col("bad"), F.lit(False)) | (F.col("roots") != 1) | (F.col("open") != 0)
    codes = F.array(F.when(F.col("old"), "XML-VERSION"), F.when(F.col("doctype"), "XML-DOCTYPE"), F.when(malformed, "XML-MALFORMED"), F.when(F.col("loose"), "XML-NAMESPACE"))
    return whole.join(named, list(by), "left").select(*by, F.explode(F.array_compact(codes)).alias("code"))


_LOOSE = re.compile("[^{]*:")
_CLOSE, _REST = re.compile(rf"</{NAME}\s*>", re.ASCII), re.compile(rf"""\s+{NAME}\s*=\s*("[^"]*"|'[^']*')""", re.ASCII)
_START, _ENDS, _SPACE = re.compile(rf"^<{NAME}", re.ASCII), re.compile(r"\s*/?>", re.ASCII), re.compile(r"\s*", re.ASCII)
_ENTITY = re.compile("&(?!(?:lt|gt|amp|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)")
_BANNED, _DASHES = re.compile("[\x00-\x08\x0B\x0C\x0E-\x1F\ufffe\uffff]"), re.compile(r"--|-\Z")
_PROLOG, _TARGET = re.compile(r"<\?xml[\s?]", re.ASCII | re.IGNORECASE), re.compile(rf"(?s)<\?{NAME}(\s.*)?\?>", re.ASCII)
_XML, _VERSION = re.compile(r"<\?xml\s", re.ASCII), re.compile(r"""<\?xml\s+version\s*=\s*["']1\.0["']""", re.ASCII)


def _name_of(raw: str) -> str:
    found = _OPEN.match(raw)
    return found[1] if found else ""


def _fault_codes(text: str) -> list[str]:
    """The codes of ``faults`` of one text."""
    bad = doctype = old = prefixed = False
    found, roots, opened = _TOKEN.findall(text.removeprefix("\ufeff")), 0, []
    for node, raw in enumerate(found):
        bad = bad or _BANNED.search(raw) is not None
        if raw[0] != "<":
            bad = bad or "]]>" in raw or ("&" in raw and _ENTITY.search(raw) is not None) or not (opened or _SPACE.fullmatch(raw))
        elif raw.startswith("<!--"):
            bad = bad or _DASHES.search(raw[4:-3]) is not None
        elif raw.startswith("<![CDATA["):
            bad = bad or not opened
        elif raw.startswith("<?"):
            bad = bad or (node > 0 and _PROLOG.match(raw) is not None) or not _TARGET.fullmatch(raw)
            old = old or (_XML.match(raw) is not None and not _VERSION.match(raw))
        elif raw.startswith("<!"):
            doctype = True
        elif raw.startswith("</"):
            bad = bad or not opened or opened.pop() != _name_of(raw) or not _CLOSE.fullmatch(raw)
        elif raw == "<":
            bad = True
        else:
            keys, name = [k for k, _ in _ATTRIBUTE.findall(raw)], _name_of(raw)
            bad = bad or not name or len(set(keys)) < len(keys) or not _ENDS.fullmatch(_REST.sub("", _START.sub("", raw))) or _ENTITY.search(raw) is not None
            prefixed = prefixed or any(":" in x and not x.startswith("xmlns:") for x in (name, *keys))
            roots += not opened
            if raw[-2] != "/":
                opened.append(name)
    loose = prefixed and any(_LOOSE.match(x) for e in text_elements(text, ()) for x in (e[4], *(k for k, _ in e[6])))
    told = (("XML-VERSION", old), ("XML-DOCTYPE", doctype), ("XML-MALFORMED", bad or roots != 1 or opened), ("XML-NAMESPACE", loose))
    return [code for code, holds in told if holds and found]


def read_faults(parts: DataFrame, by: tuple[str, ...] = BY, text: Column | None = None) -> DataFrame:
    """The rows of ``faults`` of parts with ``content``, or with a text given as a column, read part by part where they are."""
    given = parts.select(*by, (text if text is not None else F.decode("content", "UTF-8")).alias("_xml"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row, code) for row, one in enumerate(batch.column(len(by))) if one.is_valid for code in _fault_codes(one.as_py())]
            keys = batch.take(pa.array([row for row, _ in found], pa.int64())).columns[: len(by)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([code for _, code in found], pa.string())], names=[*by, "code"])

    return given.mapInArrow(read, StructType([*given.schema.fields[: len(by)], StructField("code", StringType())]))


def with_anchor(found: DataFrame, anchor: Column, by: tuple[str, ...] = BY) -> DataFrame:
    """Elements with ``anchor``, ``anchor_tag`` and ``below``: the element that meets a condition and holds this one (or is
    it), and how many levels above it stands; null where none does. Such elements are not nested in one another, so the
    last one before an element is the one to ask."""
    last = F.last(F.when(anchor, F.struct("node", "close", "tag", "depth")), ignorenulls=True).over(Window.partitionBy(*by).orderBy("node"))
    held = F.when(F.col("_l.close") >= F.col("node"), F.col("_l"))
    out = found.withColumn("_l", last).withColumn("_a", held)
    return out.withColumns({"anchor": F.col("_a.node"), "anchor_tag": F.col("_a.tag"), "below": F.col("depth") - F.col("_a.depth")}).drop("_a", "_l")


def anchored(found: DataFrame, anchor: Column, by: tuple[str, ...] = BY) -> DataFrame:
    """The elements that ``with_anchor`` gives an anchor."""
    return with_anchor(found, anchor, by).where("anchor IS NOT NULL")


def said(attributes: Column | str = "attributes") -> Column:
    """Attributes as one text, in the order of their names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(e["key"], F.lit("="), F.to_json(F.struct(e["value"].alias("v"))))), " ")


_JSON = {k: f"\\u{k:04X}" for k in range(32)} | {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}


def said_of(pairs: Iterable[tuple[str, str]]) -> str:
    """``said`` of attributes in a task."""
    return "" if not pairs else " ".join(f'{k}={{"v":"{v.translate(_JSON)}"}}' for k, v in sorted(pairs))


def shape_of(found: DataFrame, *by: str) -> DataFrame:
    """(by, shape): what each group of elements says, level by level in order: depth, tag, attributes, text without its margins."""
    one = F.concat_ws(" ", "depth", "tag", said(), F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")))
    return found.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", one.alias("t")))), lambda x: x["t"]), "\n").alias("shape"))
