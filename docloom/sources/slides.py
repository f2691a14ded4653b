"""Slides of packages read where they are: a row a slide, with its shapes and what it says besides them.

``normalise.slide_shapes`` says the same of node rows by windows and joins; tests hold them equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.pandas.types import from_arrow_type

from docloom.sources.xml_tree import said_of, told_elements

# Namespaces of the format, leaf objects, and elements that no rule takes from a package that has them.
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
REFERENCES = frozenset(f"{{http://schemas.openxmlformats.org/officeDocument/2006/relationships}}{n}" for n in ("id", "embed", "link"))
#: Leaf objects of a slide; groups hold them.
LEAVES = ("sp", "cxnSp", "pic", "graphicFrame")
RICH = (f"{P}pic", f"{P}graphicFrame", f"{A}tbl", f"{C}chart")
BLANK = " \t\n\x0b\f\r"

_LEAVES, _RICH = frozenset(f"{P}{t}" for t in LEAVES), frozenset(RICH)
_FRAME = {f"{A}{t}": names for t, names in (("off", (("x", "x"), ("y", "y"))), ("ext", (("cx", "width"), ("cy", "height"))))}
_GROUP = {f"{A}{t}": names for t, names in (("off", (("x", "ox"), ("y", "oy"))), ("ext", (("cx", "ex"), ("cy", "ey"))), ("chOff", (("x", "cx"), ("y", "cy"))), ("chExt", (("cx", "wx"), ("cy", "wy"))))}
_AROUND = pa.list_(pa.struct([(n, pa.string()) for n in ("group", "ex", "wx", "ey", "wy", "ox", "oy", "cx", "cy")]))
_SHAPE = {
    "ordinal": pa.int32(), "node": pa.int32(), "close": pa.int32(), **dict.fromkeys(("tag", "shape_id", "shape_name", "x", "y", "width", "height", "preset", "fill"), pa.string()),
    "turned": pa.bool_(), "text": pa.string(), "residue": pa.string(), "around": _AROUND,
}
_SHAPES = pa.struct(list(_SHAPE.items()))
_SLIDE = {"rich": pa.bool_(), "shell": pa.string(), "refers": pa.list_(pa.string()), "shapes": pa.list_(_SHAPES)}

#: Shapes of one batch that leaves a task.
_MOST_SHAPES = 1 << 12


# What an element of a leaf object is looked at for; all others are lines of its residue only.
_PROPERTIES, _FRAMED, _COLOUR, _PRESET, _TURN, _PARAGRAPH, _TEXT, _RUN, _LEAF, _GROUPED = range(1, 11)
_ROLES = {
    f"{P}cNvPr": _PROPERTIES, f"{A}off": _FRAMED, f"{A}ext": _FRAMED, f"{A}srgbClr": _COLOUR, f"{A}prstGeom": _PRESET, f"{A}xfrm": _TURN, f"{A}p": _PARAGRAPH, f"{A}t": _TEXT, f"{A}r": _RUN,
    **dict.fromkeys(_LEAVES, _LEAF), **dict.fromkeys((f"{P}grpSp", f"{P}grpSpPr", f"{P}nvGrpSpPr", f"{A}chOff", f"{A}chExt"), _GROUPED),
}
_MASKED = {_PROPERTIES: ("id", "name"), _COLOUR: ("val",)}


def _told(tag: str, pairs: list[tuple[str, str]]) -> tuple:
    """Of a tag: its name, attributes, role, whether it is rich, and its line in a residue, where it has always the same."""
    role = _ROLES.get(tag, 0)
    masked = _MASKED.get(role)
    return tag, dict(pairs), role, tag in _RICH, None if role == _FRAMED else f" {tag} {said_of([p for p in pairs if p[0] not in masked] if masked else pairs)} "


class _Leaf:
    """What has been read of one leaf object."""

    __slots__ = ("known", "parent", "texts", "paragraphs", "lines", "seen", "close")

    def __init__(self, ordinal: int, node: int, tag: str, parent: int | None):
        self.known = dict.fromkeys(_SHAPE) | {"ordinal": ordinal, "node": node, "tag": tag, "turned": False}
        self.parent, self.texts, self.paragraphs, self.lines, self.seen, self.close = parent, [], 0, [], set(), node

    def take(self, tag: str, own: dict, role: int, above: str | None, below: int, text: str) -> None:
        """Adds an element that has a role; of each kind the first counts."""
        if role == _PARAGRAPH:
            self.paragraphs += 1
        elif role == _TEXT:
            self.texts.append((self.paragraphs, text))
        elif role == _TURN:
            self.known["turned"] = self.known["turned"] or (below == 2 and own.get("rot", "0") != "0")
        elif tag not in self.seen and (role != _FRAMED or (below == 3 and above == f"{A}xfrm")):
            self.seen.add(tag)
            if role == _PROPERTIES:
                self.known["shape_id"], self.known["shape_name"] = own.get("id"), own.get("name")
            elif role == _FRAMED:
                self.known.update((name, own.get(k)) for k, name in _FRAME[tag])
            elif role == _COLOUR:
                self.known["fill"] = own.get("val")
            elif role == _PRESET:
                self.known["preset"] = own.get("prst")

    def told(self) -> dict:
        """The fields of ``_SHAPE`` besides the groups around."""
        at, out = 1, []
        for paragraph, text in self.texts:
            out.append("\n" * (paragraph - at) + text)
            at = paragraph
        self.known["text"] = "".join(out) + "\n" * (self.paragraphs - at)
        self.known["residue"], self.known["close"] = "\n".join(self.lines), self.close
        return self.known


def _slide(text: str) -> tuple[bool, str | None, list[str], list[dict]]:
    """The columns of ``_SLIDE`` of one slide."""
    rich, leaves, shell, refers, leaf, end = False, {}, [], [], None, -1
    groups, properties, transforms, frames, names = {}, {}, {}, {}, {}
    for e, (tag, own, role, heavy, line) in told_elements(text, _told):
        node, above = e.node, e.above
        close = node if e.close is None else e.close
        rich = rich or heavy
        if role == _LEAF:
            leaf = leaves[node] = _Leaf(len(leaves), node, tag, above and above.node)
            top, end = e.depth, close
        if role == _GROUPED or role == _TURN or role == _FRAMED or role == _PROPERTIES:
            parent, over = above and above.node, above and above.tag
            if tag == f"{P}grpSp":
                groups[node] = parent
            elif role == _GROUPED and tag not in _GROUP:
                properties[node] = parent
            elif role == _TURN and over == f"{P}grpSpPr":
                transforms[node] = properties.get(parent)
            elif role == _PROPERTIES and over == f"{P}nvGrpSpPr":
                names.setdefault(properties.get(parent), own.get("name"))
            elif tag in _GROUP and over == f"{A}xfrm" and parent in transforms:
                for k, name in _GROUP[tag]:
                    frames.setdefault(transforms[parent], {}).setdefault(name, own.get(k))
        if leaf is not None and node <= end:
            below = e.depth - top
            if close > leaf.close:
                leaf.close = close
            if role:
                leaf.take(tag, own, role, above and above.tag, below, e.texts or "")
                if role == _FRAMED:
                    line = f" {tag}  " if below == 3 else f" {tag} {said_of(own.items())} "
            if role != _PARAGRAPH and role != _TEXT and role != _RUN:
                leaf.lines.append(f"{below}{line}{e.texts.strip(' ') if e.texts else ''}")
        else:
            of = [v for k, v in own.items() if k in REFERENCES] if own else ()
            shell.append(f"{e.depth} {tag} {said_of([p for p in own.items() if p[0] not in REFERENCES] if of else own.items())} {(e.texts or '').strip(BLANK)}" + "\0" * len(of))
            refers += of
    shapes = []
    for found in leaves.values():
        shape, at = found.told(), found.parent
        if at in groups:
            shape["around"] = []
        while at in groups:
            shape["around"].append({"group": names.get(at), **frames.get(at, {})})
            at = groups[at]
        shapes.append(shape)
    return rich, hashlib.sha256("\n".join(shell).encode("utf-8", "surrogatepass")).hexdigest() if shell else None, refers, shapes


def read_slides(slides: DataFrame) -> DataFrame:
    """(package, name, rich, shell, refers, shapes) of slides with ``content``, a row each.

    ``shell`` is a digest of what stands outside the leaf objects, null if nothing does, and ``refers`` the relationship ids in it
    in order. Shapes stand in their order; ``around`` lists the groups that hold one, from the innermost out, and
    numbers are as written. Nothing is shuffled.
    """
    given = slides.select("package", "name", F.decode("content", "UTF-8").alias("_xml"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, shapes = [], [0], []

            def flush(end: int) -> pa.RecordBatch:
                flat = pa.StructArray.from_arrays([pa.array([s[c] for s in shapes], t) for c, t in _SHAPE.items()], fields=list(_SHAPES))
                head = [c.slice(end - len(rows), len(rows)) for c in batch.columns[:2]]
                told = [pa.array([r[k] for r in rows], t) for k, t in enumerate(list(_SLIDE.values())[:3])]
                out = pa.RecordBatch.from_arrays([*head, *told, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), flat)], names=["package", "name", *_SLIDE])
                rows.clear(), shapes.clear(), starts.__delitem__(slice(1, None))
                return out

            for k, one in enumerate(batch.column(2), 1):
                rich, shell, refers, found = _slide(one.as_py()) if one.is_valid else (False, None, [], [])
                rows.append((rich, shell, refers))
                shapes += found
                starts.append(len(shapes))
                if len(shapes) >= _MOST_SHAPES or len(rows) == _MOST_SHAPES:
                    yield flush(k)
            if rows:
                yield flush(batch.num_rows)

    told = [StructField(n, from_arrow_type(t)) for n, t in _SLIDE.items()]
    return given.mapInArrow(read, StructType([*given.schema.fields[:2], *told]))
