"""Slide decks and single diagrams as relations: sections, manifests, object trees, style rules.

Attributes that carry meaning are named ``data-<family>-<name>``; the family is read from the markup itself, so one
parser serves every family.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources import xml_tree

# Elements that hold no rendered object or no content, roles, and the elements each role may use.
NOT_RENDERED = ("defs", "metadata", "title", "desc")
VOID = ("meta", "link", "br", "hr", "img", "input", "base")
ROLE_ELEMENTS = {"shape": ("rect", "circle", "ellipse"), "text": ("text",), "connector": ("line", "polyline"), "group": ("g",), "asset": ("image", "g")}
EXPORT_MODES = ("native", "svg", "raster", "ignore")

NODES = (
    "doc_id string, family string, scope_id string, id string, parent_id string, ancestor_ids array<string>, preorder int, sibling_order int, depth int, "
    "role string, export_mode string, element string, classes array<string>, attributes map<string,string>, text string"
)
SECTIONS = "doc_id string, family string, kind string, name string, ordinal int, body string"
_DATA = re.compile(r"^data-([a-z0-9]+)-([a-z-]+)$")


class _Objects(HTMLParser):
    """Collects sections and objects of one document; unclosed elements end with their parent."""

    def __init__(self, doc_id: str):
        super().__init__(convert_charrefs=True)
        self.doc_id, self.family = doc_id, None
        self.open: list[dict] = []
        self.nodes: list[dict] = []
        self.sections: list[list] = []
        self.scope: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        own = {}
        for k, v in given.items():
            if m := _DATA.match(k):
                self.family = self.family or m[1]
                own[m[2]] = v
        frame = {"tag": tag, "node": None, "section": None, "scope": self.scope, "children": 0}
        kind = next((k for k in ("slide", "theme", "style", "runtime", "editor", "library") if k in own), None)
        if tag == "script" and given.get("type", "").endswith("json"):
            kind = "manifest"
        if kind and tag in ("template", "script", "style", "section"):
            frame["section"] = [kind, own.get(kind, given.get("id", "")), len(self.sections), ""]
            self.sections.append(frame["section"])
            if kind == "slide":
                self.scope = own["slide"]
        elif tag == "svg" and self.scope is None:
            self.scope = given.get("id", "")
        if "role" in own and not any(f["tag"] in NOT_RENDERED for f in self.open):
            above = [f["node"] for f in self.open if f["node"]]
            holder = next((f for f in reversed(self.open) if f["node"]), self.open[0] if self.open else frame)
            order = holder.setdefault(f"n:{self.scope}", 0)
            holder[f"n:{self.scope}"] += 1
            frame["node"] = {
                "scope_id": self.scope, "id": given.get("id"), "parent_id": above[-1]["id"] if above else None, "ancestor_ids": [n["id"] for n in above], "preorder": len(self.nodes), "sibling_order": order, "depth": len(above),
                "role": own["role"], "export_mode": own.get("export", "native"), "element": tag, "classes": given.get("class", "").split(), "attributes": {_DATA.sub(r"\2", k): v for k, v in given.items()}, "text": None,
            }
            self.nodes.append(frame["node"])
        if tag not in VOID:
            self.open.append(frame)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if any(f["tag"] == tag for f in self.open):
            while self.open:
                frame = self.open.pop()
                self.scope = frame["scope"]
                if frame["tag"] == tag:
                    break

    def handle_data(self, data: str) -> None:
        for f in reversed(self.open):
            if f["section"]:
                f["section"][3] += data
                break
        holder = next((f["node"] for f in reversed(self.open) if f["node"]), None)
        if holder and holder["role"] == "text" and data.strip():
            holder["text"] = ((holder["text"] + "\n") if holder["text"] else "") + " ".join(data.split())


def _parse(batches: Iterator[pd.DataFrame], what: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            seen = _Objects(doc_id)
            seen.feed(text or "")
            seen.close()
            if what == "nodes":
                rows += [{"doc_id": doc_id, "family": seen.family} | n for n in seen.nodes]
            else:
                rows += [{"doc_id": doc_id, "family": seen.family, "kind": k, "name": n, "ordinal": o, "body": b} for k, n, o, b in seen.sections]
        yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in re.findall(r"\w+ \w+(?:<[^>]*>)?", NODES if what == "nodes" else SECTIONS)])


def xml_findings(docs: DataFrame) -> DataFrame:
    """(doc_id, code, severity) of standalone diagrams (doc_id, text) that are no strict XML: not well-formed (empty and
    null texts too), a prefix that nothing binds, a DOCTYPE, or another version. An anti join withholds them.

    The faults are those of the node rows (``xml_tree.faults``), read where a text is; of several the first of version,
    DOCTYPE, form and namespace is told.
    """
    empty = docs.where(F.trim(F.coalesce("text", F.lit(""))) == "").select("doc_id", F.lit("XML-MALFORMED").alias("code"))
    found = xml_tree.read_faults(docs, ("doc_id",), F.coalesce("text", F.lit(""))).unionByName(empty)
    rank = F.array_position(F.lit(["XML-VERSION", "XML-DOCTYPE", "XML-MALFORMED", "XML-NAMESPACE"]), F.col("code"))
    return found.groupBy("doc_id").agg(F.min_by("code", rank).alias("code")).select("doc_id", "code", F.lit("fatal").alias("severity"))


def objects(docs: DataFrame) -> DataFrame:
    """Object tree of documents (doc_id, text): one row an object, with its ancestors. Keep it as a table to query it."""
    return docs.select("doc_id", "text").mapInPandas(lambda it: _parse(it, "nodes"), NODES)


def sections(docs: DataFrame) -> DataFrame:
    """Sections of documents: manifest, slides, styles, themes."""
    return docs.select("doc_id", "text").mapInPandas(lambda it: _parse(it, "sections"), SECTIONS)


def manifests(found: DataFrame) -> DataFrame:
    """(doc_id, title, theme, runtime, slide_order, scope_id, layout, hidden): the slides of each manifest in order.

    A slide is a name or an object; both are read.
    """
    m = found.where("kind = 'manifest'")
    top = F.from_json("body", "title string, theme string, runtime string, slides array<string>")
    each = m.select("doc_id", top.alias("m")).select("doc_id", "m.title", "m.theme", "m.runtime", F.posexplode("m.slides").alias("slide_order", "s"))
    full = F.from_json("s", "id string, layout string, hidden boolean")
    return each.withColumn("o", F.when(F.col("s").startswith("{"), full)).select("doc_id", "title", "theme", "runtime", "slide_order", F.coalesce("o.id", "s").alias("scope_id"), "o.layout", F.coalesce("o.hidden", F.lit(False)).alias("hidden"))


def style_rules(found: DataFrame, kind: str = "style") -> DataFrame:
    """(doc_id, theme_id, class, source_order, property, literal, token) of class rules; tokens are custom properties."""
    css = found.where(F.col("kind") == kind).select("doc_id", F.col("name").alias("theme_id"), F.regexp_replace("body", r"(?s)/\*.*?\*/", "").alias("css"))
    rules = css.select("doc_id", "theme_id", F.posexplode(F.regexp_extract_all("css", F.lit(r"([^{}]+\{[^{}]*\})"), F.lit(1))).alias("source_order", "rule"))
    names = F.regexp_extract_all(F.regexp_extract("rule", r"^([^{]*)", 1), F.lit(r"[.]([A-Za-z_][\w-]*)"), F.lit(1))
    values = F.filter(F.split(F.regexp_extract("rule", r"(?s)\{(.*)\}", 1), ";"), lambda d: F.contains(d, F.lit(":")))
    each = rules.select("doc_id", "theme_id", F.explode(names).alias("class"), "source_order", values.alias("v")).select("doc_id", "theme_id", "class", "source_order", F.explode("v").alias("d"))
    value = F.trim(F.regexp_extract("d", r"(?s)^[^:]*:(.*)$", 1))
    token = F.nullif(F.regexp_extract(value, r"^var\(\s*--[a-z0-9]+-([\w-]+)\s*\)$", 1), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(value, r"^([0-9.]+)px$", "$1"), "\\s+", " ")
    return each.select("doc_id", "theme_id", "class", "source_order", F.regexp_replace(F.trim(F.regexp_extract("d", "^([^:]*):", 1)), r"^\s+", "").alias("property"), F.when(token.isNull(), plain).alias("literal"), token.alias("token"))


def theme_tokens(found: DataFrame) -> DataFrame:
    """(doc_id, theme_id, token, expression) of the custom properties that each theme sets."""
    css = found.where("kind = 'theme'").select("doc_id", F.col("name").alias("theme_id"), F.explode(F.regexp_extract_all("body", F.lit(r"(--[\w-]+\s*:\s*[^;}]+)"), F.lit(1))).alias("d"))
    return css.select("doc_id", "theme_id", F.regexp_extract("d", r"^--[a-z0-9]+-([\w-]+)", 1).alias("token"), F.trim(F.regexp_extract("d", r":\s*(.*)$", 1)).alias("expression"))
