"""Column functions: text, hashes, colours, numbers, geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of the package format, and the grammars of ids, numbers and file names.
EMU_PER_UNIT = 7620
STABLE_ID = r"^[A-Za-z][A-Za-z0-9._:-]{0,127}$"
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
MEMO_NAME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}-[A-Za-z0-9._-]+[.]md$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_stable_id(x: Column | str) -> Column:
    return _c(x).rlike(STABLE_ID)


def utf16_length(x: Column | str) -> Column:
    """UTF-16 code units; Spark's length counts code points."""
    return (F.octet_length(F.encode(_c(x), "UTF-16BE")) / 2).cast("long")


def fnv1a32(x: Column | str) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    pairs = F.transform(F.sequence(F.lit(1), F.octet_length(_c(x))), lambda i: F.conv(F.substr(F.hex(F.encode(_c(x), "UTF-8")), i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    pairs = F.when(F.octet_length(_c(x)) > 0, pairs).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(pairs, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(0xFFFFFFFF))


def numeric_id(x: Column | str, low: int = 2, below: int = 2**31) -> Column:
    """A numeric id in [low, below) from the hash of a name."""
    return F.lit(low) + F.pmod(fnv1a32(x), F.lit(below - low))


def short_hash_id(prefix: str, x: Column | str) -> Column:
    return F.concat(F.lit(prefix + "."), F.left(F.sha2(_c(x), 256), F.lit(16)))


def hex_colour(x: Column | str) -> Column:
    """#rrggbb in lower case, or null."""
    return F.when(_c(x).rlike("^#[0-9A-Fa-f]{6}$"), F.lower(_c(x)))


def rgb(x: Column | str) -> Column:
    """Red, green and blue of #rrggbb, or null."""
    c = hex_colour(x)
    return F.when(c.isNotNull(), F.struct(*[F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10).cast("int").alias(n) for i, n in enumerate("rgb")]))


def strict_number(x: Column | str) -> Column:
    """The number a text is, in full; null for anything else. Negative zero is zero."""
    return F.when(_c(x).rlike(NUMBER), _c(x).try_cast("double") + F.lit(0.0))


def escape_xml(x: Column | str, attribute: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(_c(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if attribute else out


def unescape_xml(x: Column | str) -> Column:
    """The inverse of ``escape_xml``."""
    out = _c(x)
    for code, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def normalise_newlines(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(x), "^﻿", ""), "\r\n?", "\n")


def demote_links(x: Column | str) -> Column:
    """[label](http…) becomes label (url), or label alone if it is the url; other links become their label."""
    web = F.regexp_replace(_c(x), r"\[([^\]]+)\]\((?!\1\))(https?://[^)\s]+)\)", "$1 ($2)")
    return F.regexp_replace(web, r"\[([^\]]+)\]\([^)\s]*\)", "$1")


def wrap_marker(x: Column | str, marker: str) -> Column:
    """The text in markers; its outer white space stays outside."""
    return F.when(F.trim(_c(x)) == "", _c(x)).otherwise(F.regexp_replace(_c(x), r"(?s)^(\s*)(.*?)(\s*)$", "$1" + marker.replace("$", r"\$") + "$2" + marker.replace("$", r"\$") + "$3"))


def to_emu(x: Column | str) -> Column:
    """Units as whole EMU; null where they are not whole."""
    e = _c(x) * EMU_PER_UNIT
    return F.when(e == F.floor(e), e.cast("long"))


def from_emu(x: Column | str, scale: float = 1.0, shift: float = 0.0) -> Column:
    """EMU as units under a placement, or null if going forth again does not give the same EMU."""
    u = (_c(x) / F.lit(float(EMU_PER_UNIT)) - F.lit(shift)) / F.lit(scale)
    return F.when(((u * F.lit(scale) + F.lit(shift)) * EMU_PER_UNIT).cast("long") == _c(x), u)


def available_width(anchor: Column | str, anchor_x: Column | str, frame_x: Column | str, frame_width: Column | str) -> Column:
    """Room for a line: to the right of a start anchor, to the left of an end anchor, twice the nearer side of a middle one."""
    left, right = _c(anchor_x) - _c(frame_x), _c(frame_x) + _c(frame_width) - _c(anchor_x)
    return F.when(_c(anchor) == "start", right).when(_c(anchor) == "end", left).otherwise(2 * F.least(left, right))


def fit_status(width: Column | str, available: Column | str, near_limit: float = 0.9) -> Column:
    """unverified without a width; overflow beyond the room; near-limit from that share on; else clear."""
    w, a = _c(width), _c(available)
    used = F.when((a == 0) & (w == 0), 0.0).otherwise(F.try_divide(w, a))
    return F.when(w.isNull(), "unverified").when(w > a, "overflow").when(used >= near_limit, "near-limit").otherwise("clear")


def utilisation(width: Column | str, available: Column | str) -> Column:
    w, a = _c(width), _c(available)
    return F.when((a == 0) & (w == 0), 0.0).otherwise(F.try_divide(w, a))


def half_up(x: Column | str) -> Column:
    """The nearest integer, halves towards positive infinity."""
    return F.floor(_c(x) + 0.5).cast("long")


def point_in(x: Column | str, y: Column | str, left, top, width, height) -> Column:
    return _c(x).between(_c(left), _c(left) + _c(width)) & _c(y).between(_c(top), _c(top) + _c(height))


def is_finite(x: Column | str) -> Column:
    return ~F.isnan(_c(x)) & (F.abs(_c(x)) != F.lit(float("inf")))


def file_version(name: Column | str) -> Column:
    """(id, major, minor) of NAME.1.2.md, or null."""
    pattern = r"^([A-Z]+-[0-9]+)[.]([0-9]+)[.]([0-9]+)[.]md$"
    return F.when(_c(name).rlike(pattern), F.struct(F.regexp_extract(_c(name), pattern, 1).alias("id"), F.regexp_extract(_c(name), pattern, 2).cast("int").alias("major"), F.regexp_extract(_c(name), pattern, 3).cast("int").alias("minor")))


def is_rfc3339(x: Column | str) -> Column:
    shape = _c(x).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$")
    return F.coalesce(shape & F.try_to_timestamp(_c(x)).isNotNull(), F.lit(False))


def preview(x: Column | str, size: int = 512) -> Column:
    """Control characters masked, cut to as many whole characters as fit in so many bytes of UTF-8."""
    clean = F.regexp_replace(F.left(_c(x), F.lit(size)), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "?")
    cut = F.substring(F.encode(clean, "UTF-8"), 1, size)
    # A character that the cut left incomplete (a lead byte and fewer bytes than it asks for) goes.
    back = F.regexp_replace(F.hex(cut), "(?:C[2-9A-F]|D[0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-4](?:[89AB][0-9A-F]){0,2})$", "")
    return F.when(F.octet_length(clean) <= size, clean).otherwise(F.decode(F.unhex(back), "UTF-8"))


def splice(text: Column | str, edits: Column | str) -> Column:
    """Applies edits (start, end, replacement), half-open and disjoint, in order of place; all places are those of the given text,
    and one behind its end is at its end. Of an edit only start, end and replacement, in this order, count."""
    t, up = _c(text), F.array_sort(F.transform(_c(edits), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("replacement"))))
    end = lambda i: F.when(i == 0, 0).otherwise(F.try_element_at(up, F.greatest(i, F.lit(1)))["end"])
    pieces = F.transform(up, lambda e, i: F.concat(F.substr(t, end(i) + 1, e["start"] - end(i)), e["replacement"]))
    joined = F.when(~F.exists(up, lambda e: e["replacement"].isNull()), F.array_join(pieces, ""))
    return F.concat(joined, F.substr(t, F.coalesce(F.try_element_at(up, F.lit(-1))["end"], F.lit(0)) + 1))


def first_given(*choices: Column | str) -> Column:
    """The first that is not null: explicit, then local, then built in."""
    return F.coalesce(*[_c(c) for c in choices])


def toggle(*values: Column | str) -> Column:
    """A switch property: own, then each style's; what none sets is off."""
    return F.coalesce(*[_c(v) for v in values], F.lit(False))


def provenance_stamp(source: Column | str, text: Column | str, size: int = 255) -> Column:
    """Where a text came from and the start of its SHA-256; the end of the stamp is kept if it is too long."""
    return F.right(F.concat(F.lit("source="), _c(source), F.lit(";sha256="), F.left(F.sha2(_c(text), 256), F.lit(16))), F.lit(size))


def safe_part_name(name: Column | str) -> Column:
    """Whether a part's name stays in its package: no root, no step up, no backslash."""
    return ~_c(name).rlike(r"(^/)|(^|/)[.][.](/|$)|\\\\")


TRANSLATE = r"^translate\(\s*([-+0-9.eE]+)(?:[\s,]+([-+0-9.eE]+))?\s*\)$"


def translation(text: Column | str) -> Column:
    """(tx, ty) of translate(x[, y]); null for anything else."""
    part = lambda k: F.regexp_extract(_c(text), TRANSLATE, k).try_cast("double")
    return F.when(_c(text).rlike(TRANSLATE), F.struct(part(1).alias("tx"), F.coalesce(part(2), F.lit(0.0)).alias("ty")))


def exact_difference(a: Column | str, b: Column | str) -> Column:
    """a - b of two number texts, in decimals."""
    return _c(a).try_cast("decimal(30,10)") - _c(b).try_cast("decimal(30,10)")


def exact_products_equal(a: Column | str, b: Column | str, c: Column | str, d: Column | str) -> Column:
    """Whether a x b is exactly c x d, in decimals: equal ratios without a division."""
    n = lambda x: _c(x).try_cast("decimal(18,4)")
    return n(a) * n(b) == n(c) * n(d)


def placed(value: Column | str, scale: Column | float, shift: Column | float) -> Column:
    """A coordinate under a uniform scale and a shift."""
    as_column = lambda x: F.lit(float(x)) if isinstance(x, int | float) else x
    return _c(value).cast("double") * as_column(scale) + as_column(shift)


def code_points(text: Column | str) -> Column:
    """The distinct code points of a text in order."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(_c(text), ""), lambda c: c != ""), lambda c: F.ascii(c))))


def text_slice(text: Column | str, start: int, end: int) -> Column:
    """Code points [start, end)."""
    return F.substring(_c(text), start + 1, end - start)


def byte_slice(text: Column | str, start: int, end: int) -> Column:
    """Bytes [start, end) of the UTF-8 form."""
    return F.substring(F.encode(_c(text), "UTF-8"), start + 1, end - start)


def part_number(name: Column | str) -> Column:
    """The first number in a part's name: slide10 comes after slide9."""
    return F.nullif(F.regexp_extract(_c(name), "([0-9]+)", 1), F.lit("")).cast("long")


def shortened(text: Column | str, size: int = 160) -> Column:
    """The text, cut at the last white space if it is longer than the size; without one, nothing is left."""
    return F.when(F.length(_c(text)) <= size, _c(text)).otherwise(F.regexp_extract(F.left(_c(text), F.lit(size + 1)), r"(?s)^(.*)\s", 1))


def bounded_message(text: Column | str, size: int = 4096) -> Column:
    """A message of at most so many code points; a cut one ends in an ellipsis."""
    return F.when(F.length(_c(text)) <= size, _c(text)).otherwise(F.concat(F.left(_c(text), F.lit(size - 1)), F.lit("\u2026")))
