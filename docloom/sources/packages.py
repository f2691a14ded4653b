"""Office packages as relations: parts and relationships of many archives at once."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from docloom.functions.scalars import escape_xml
from docloom.sources.shared_tables import SharedTables
from docloom.sources.xml_tree import let

# Limits of a package, of the entries that leave a task at once, the fixed time stamp of written archives, and how
# relationships, content types and references to relationships are written.
MAX_PARTS, MAX_BYTES = 10_000, 256 << 20
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20
ZIP_TIME = (1980, 1, 1, 0, 0, 0)
RELATIONSHIP, CONTENT_TYPE = r"(<Relationship\s[^>]*>)", r"(<(?:Default|Override)\s[^>]*>)"
REFERENCE = r'r:(?:id|embed|link)="[^"]*"'
PARTS = "package string, ordinal int, name string, size long, content binary, problem string"


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frame = lambda rows: pd.DataFrame(rows, columns=["package", "ordinal", "name", "size", "content", "problem"])
    # Small archives leave together, large ones alone.
    held, size = [], 0
    for batch in batches:
        for package, content in zip(batch["package"], batch["content"], strict=True):
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    entries = z.infolist()
                    refused = "TOO-MANY-PARTS" if len(entries) > MAX_PARTS else "TOO-LARGE" if sum(e.file_size for e in entries) > MAX_BYTES else None
                    for k, e in enumerate(entries):
                        problem = refused or ("ENCRYPTED" if e.flag_bits & 1 else None)
                        rows.append((package, k, e.filename, e.file_size, None if problem else z.read(e), problem))
            except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError):
                rows = [(package, -1, None, 0, None, "NOT-A-PACKAGE")]
            held += rows
            size += sum(len(r[4] or b"") for r in rows)
            if size > BATCH_BYTES or len(held) > BATCH_ROWS:
                yield frame(held)
                held, size = [], 0
    if held:
        yield frame(held)


def read_parts(files: DataFrame) -> DataFrame:
    """(package, ordinal, name, size, content, problem) of archives (package, content), entry by entry.

    An archive beyond the limits yields its entries without content; a broken one a single row.
    """
    parts = files.select("package", "content").mapInPandas(_unpack, PARTS)
    unsafe = F.col("name").rlike(r"(^/)|(^|/)[.][.](/|$)|\\|[\x00-\x1F]")
    return parts.withColumn("problem", F.coalesce("problem", F.when(unsafe, "UNSAFE-NAME")))


def name_collisions(parts: DataFrame) -> DataFrame:
    """Names of one package that differ at most in case."""
    return parts.groupBy("package", F.lower("name").alias("name")).count().where("count > 1")


def content_classes(parts: DataFrame) -> DataFrame:
    """(package, first): each package with the first one that has the same parts, names and contents, itself if there is no other.

    A package is known by the sums of three stretches of its parts' SHA-256, 180 bits in all, so one short row a package is
    shuffled and the order of its parts says nothing.
    """
    said = F.sha2(F.concat(F.encode(F.to_json(F.struct("name", F.col("content").isNull().alias("none"))), "UTF-8"), F.coalesce("content", F.lit(b""))), 256)
    stretch = lambda k: F.sum(F.conv(F.substring("_said", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")).alias(f"_{k}")
    digests = parts.select("package", said.alias("_said")).groupBy("package").agg(*[stretch(k) for k in range(3)], F.count("*").alias("_n"))
    key = ["_0", "_1", "_2", "_n"]
    firsts = digests.groupBy(*key).agg(F.min("package").alias("first"))
    return digests.join(firsts, key).select("package", "first")


def once_per_content(parts: DataFrame, use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``use`` of the parts (package, name, content) of one package of each content, and its rows for all packages that say the same.

    For work within packages that looks at names and contents only; its rows have a column ``package``.
    """
    tables = SharedTables(parts.sparkSession, "contents")
    classes = tables.cut("classes", content_classes(parts))
    firsts = classes.where("package = first").select("package")
    found = tables.cut("found", use(tables.cut("firsts", parts.join(firsts, "package", "left_semi"))))
    return classes.withColumnRenamed("package", "_all").join(found.withColumnRenamed("package", "first"), "first").withColumnRenamed("_all", "package").select(*found.columns)


def resolve_target(source, target):
    """The part that a relationship of ``source`` points to: relative to the source's folder, dots resolved."""
    base = F.when(target.startswith("/"), F.array().cast("array<string>")).otherwise(F.slice(F.split(source, "/"), F.lit(1), F.size(F.split(source, "/")) - 1))
    steps = F.concat(base, F.filter(F.split(target, "/"), lambda s: (s != "") & (s != ".")))
    up = lambda a, s: F.when(s == "..", F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)).otherwise(F.concat(a, F.array(s)))
    # Most targets are rooted and have nothing to resolve.
    clear = target.startswith("/") & ~target.endswith("/") & ~F.contains(target, F.lit("/.")) & ~F.contains(target, F.lit("//"))
    return F.when(clear, F.substr(target, F.lit(2))).otherwise(F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/"))


def _relationship(x: Column, source: Column) -> Column:
    """(rid, type, to: (target, external)) of one relationship of a source as written."""
    attr = lambda n: F.regexp_extract(x, rf'\s{n}="([^"]*)"', 1)
    given = F.struct(attr("Target").alias("raw"), (attr("TargetMode") == "External").alias("external"))
    target = let(given, lambda g: F.struct(F.when(g["external"], g["raw"]).otherwise(resolve_target(source, g["raw"])).alias("target"), g["external"].alias("external")))
    return F.struct(attr("Id").alias("rid"), attr("Type").alias("type"), target.alias("to"))


def _source() -> Column:
    """The part that a relationship part speaks for."""
    return F.regexp_replace(F.regexp_replace("name", r"_rels/([^/]*)[.]rels$", "$1"), "^/", "")


def relationships(parts: DataFrame) -> DataFrame:
    """(package, source, rid, type, target, external) of every relationship part."""
    rels = parts.where("name LIKE '%.rels' AND content IS NOT NULL").withColumn("source", _source())
    each = rels.select("package", "source", F.explode(F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit(RELATIONSHIP), F.lit(1))).alias("x"))
    return each.select("package", "source", _relationship(F.col("x"), F.col("source")).alias("r")).select("package", "source", "r.rid", "r.type", "r.to.target", "r.to.external")


def _content_type(x: Column) -> Column:
    """(kind, key, content_type) of one declaration as written."""
    attr = lambda n: F.regexp_extract(x, rf'\s{n}="([^"]*)"', 1)
    default = x.startswith("<Default")
    return F.struct(F.when(default, "default").otherwise("override").alias("kind"), F.when(default, attr("Extension")).otherwise(F.regexp_replace(attr("PartName"), "^/", "")).alias("key"), attr("ContentType").alias("content_type"))


def content_types(parts: DataFrame) -> DataFrame:
    """(package, kind, key, content_type) of declared defaults and overrides."""
    x = parts.where("name = '[Content_Types].xml'").select("package", F.explode(F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit(CONTENT_TYPE), F.lit(1))).alias("x"))
    return x.select("package", _content_type(F.col("x")).alias("t")).select("package", "t.*")


def graph_findings(parts: DataFrame) -> DataFrame:
    """(package, code, subject): relationships to parts that are not there, repeated ids, colliding names, repeated types."""
    rels = relationships(parts)
    have = parts.select("package", F.col("name").alias("target")).distinct()
    missing = rels.where("NOT external").join(have, ["package", "target"], "left_anti").select("package", F.lit("MISSING-TARGET").alias("code"), F.concat_ws("#", "source", "rid").alias("subject"))
    repeated = rels.groupBy("package", "source", "rid").count().where("count > 1").select("package", F.lit("REPEATED-RELATIONSHIP").alias("code"), F.concat_ws("#", "source", "rid").alias("subject"))
    names = name_collisions(parts).select("package", F.lit("NAME-COLLISION").alias("code"), F.col("name").alias("subject"))
    types = content_types(parts).groupBy("package", "kind", "key").count().where("count > 1").select("package", F.lit("REPEATED-CONTENT-TYPE").alias("code"), F.concat_ws(":", "kind", "key").alias("subject"))
    broken = parts.where("problem IS NOT NULL").select("package", F.col("problem").alias("code"), F.coalesce("name", F.lit("")).alias("subject")).distinct()
    return missing.unionByName(repeated).unionByName(names).unionByName(types).unionByName(broken)


def part_signatures(parts: DataFrame, sides: str | None = None) -> DataFrame:
    """(package, name, signature): what a part says, whatever order it says it in.

    Relationship parts count as their sorted resolved targets without ids, content types as their sorted set; generated
    document properties are left out; other parts count as their text with white space between tags dropped and
    relationship ids replaced by what they stand for. A text is read where it is and leaves as its digest and the ids in it;
    only these meet the relationships of their part. ``sides`` names a column with the sides of a package that hold a part as
    it is: its text is read once for all of them, and the rows have the column ``side``.
    """
    by = ["package", "side"] if sides else ["package"]
    name, text = F.col("name"), F.decode("content", "UTF-8")
    rels, types = name.endswith(".rels"), name == "[Content_Types].xml"
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    bare = F.regexp_replace(text, r">\s+<", "><")
    refers = F.contains(text, F.lit('r:id="')) | F.contains(text, F.lit('r:embed="')) | F.contains(text, F.lit('r:link="'))
    refs = F.when(refers, F.regexp_extract_all(bare, F.lit(f"({REFERENCE})"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    digest = F.sha2(F.when(refers, F.regexp_replace(bare, REFERENCE, 'r:ref=""')).otherwise(bare), 256)
    told = parts.where("content IS NOT NULL AND name IS NOT NULL").withColumn("source", _source()).select(
        "package", *([sides] if sides else []), F.when(rels, F.col("source")).otherwise(name).alias("key"),
        F.when(rels, F.transform(every(RELATIONSHIP), lambda x: _relationship(x, F.col("source")))).alias("links"),
        F.when(types, F.transform(every(CONTENT_TYPE), lambda x: F.concat_ws("|", _content_type(x)["kind"], _content_type(x)["key"], _content_type(x)["content_type"]))).alias("types"),
        F.when(~rels & ~types & ~name.startswith("docProps/"), F.struct(digest.alias("digest"), refs.alias("refs"))).alias("plain"),
    )
    if sides:
        told = told.withColumn("side", F.explode(sides))
    known = told.groupBy(*by, "key").agg(F.flatten(F.collect_list("links")).alias("links"), F.array_distinct(F.flatten(F.collect_list("types"))).alias("types"), F.collect_list("plain").alias("plain"))
    # Of a repeated id the last target counts.
    target = lambda ref: F.array_max(F.transform(F.filter("links", lambda l: l["rid"] == F.regexp_extract(ref, '"([^"]*)"', 1)), lambda l: l["to"]["target"]))
    meant = lambda p: F.to_json(F.struct(p["digest"], F.transform(p["refs"], lambda r: F.coalesce(target(r), r)).alias("refs")))
    row = lambda name, body: F.struct(name.alias("name"), F.sha2(body, 256).alias("signature"))
    lines = lambda found: F.array_join(F.array_sort(found), "\n")
    none = F.array().cast("array<struct<name:string,signature:string>>")
    graph = F.when(F.size("links") > 0, F.array(row(F.regexp_replace("key", r"(?s)^(.*?)([^/]*)$", "$1_rels/$2.rels"), lines(F.transform("links", lambda l: F.concat_ws("|", l["type"], l["to"]["target"])))))).otherwise(none)
    declared = F.when(F.size("types") > 0, F.array(row(F.col("key"), lines(F.col("types"))))).otherwise(none)
    plain = F.transform("plain", lambda p: row(F.col("key"), F.when(F.size(p["refs"]) > 0, meant(p)).otherwise(p["digest"])))
    return known.select(*by, F.explode(F.concat(graph, declared, plain)).alias("s")).select(*by, "s.*")


def compare_packages(parts: DataFrame, baseline: str, edited: str) -> DataFrame:
    """(name, state): parts that are missing, new or say something else."""
    s = part_signatures(parts)
    b = s.where(F.col("package") == baseline).select("name", F.col("signature").alias("b"))
    e = s.where(F.col("package") == edited).select("name", F.col("signature").alias("e"))
    state = F.when(F.col("e").isNull(), "missing").when(F.col("b").isNull(), "new").when(F.col("b") != F.col("e"), "changed")
    return b.join(e, "name", "full_outer").select("name", state.alias("state")).where("state IS NOT NULL")


@lru_cache(1 << 12)
def _headers(name: str, crc: int, size: int) -> tuple[bytes, bytes]:
    """The local header of an entry, and its central record at place 0."""
    return _entry(name, crc, size).FileHeader(), _central([Row(name=name, crc=crc, size=size, record=0)], 0)


def _archive(parts: list[tuple[str, bytes]]) -> bytes:
    """One archive as the library writes it, of less than 2 GB."""
    records, listed, at = [], [], 0
    for name, content in sorted(parts):
        local, central = _headers(name, zlib.crc32(content), len(content))
        records += (local, content)
        listed.append(b"".join((central[:42], struct.pack("<L", at), central[46:])))
        at += len(local) + len(content)
    directory = b"".join(listed)
    return b"".join((*records, directory, _end(len(listed), len(directory), at)))


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The archive of one package's parts (name, content)."""
    return pd.DataFrame({"package": [key[0]], "content": [_archive(list(zip(pdf["name"], pdf["content"], strict=True)))]})


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Archives of rows whose packages stand together; the last package of a batch may go on in the next."""
    key, parts, keys, held, size = None, [], [], [], 0
    for batch in batches:
        for package, name, content in zip(batch["package"], batch["name"], batch["content"], strict=True):
            if parts and package != key:
                keys.append(key)
                held.append(_archive(parts))
                size, parts = size + len(held[-1]), []
                if size > BATCH_BYTES or len(held) == BATCH_ROWS:
                    yield pd.DataFrame({"package": keys, "content": held})
                    keys, held, size = [], [], 0
            key = package
            parts.append((name, content))
    if parts:
        yield pd.DataFrame({"package": [*keys, key], "content": [*held, _archive(parts)]})


def write_packages(parts: DataFrame) -> DataFrame:
    """(package, content): archives of the parts, byte for byte the same for the same parts. A package has bounded size.

    The parts of packages are read in order as a stream of their partition, so a package costs no call of its own.
    """
    kind = parts.schema["package"].dataType.simpleString()
    ordered = parts.select("package", "name", "content").repartition("package").sortWithinPartitions("package")
    return ordered.mapInPandas(_packed, f"package {kind}, content binary")


def _entry(name: str, crc: int, size: int) -> zipfile.ZipInfo:
    entry = zipfile.ZipInfo(name, ZIP_TIME)
    entry.CRC, entry.compress_size, entry.file_size, entry.external_attr = crc, size, size, 0o600 << 16
    return entry


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted rows (package, name, content): runs of the local records of one package, (task, step) in their order."""
    task, step, held, size, key = TaskContext.get().partitionId(), 0, [], 0, None

    def run() -> pa.RecordBatch:
        columns = [[package], [task], [step], [[e for e, _ in held]], [b"".join(r for _, r in held)]]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, t) for c, t in zip(columns[1:], _RUN.values(), strict=True))], names=["package", *_RUN])

    for batch in batches:
        kind = batch.schema.types[0]
        for row in range(batch.num_rows):
            key, name, content = (c[row].as_py() for c in batch.columns)
            if held and (key != package or size > BATCH_BYTES):
                yield run()
                step, held, size = step + 1, [], 0
            package, content = key, content or b""
            entry = _entry(name, zlib.crc32(content), len(content))
            record = entry.FileHeader() + content
            held.append(({"name": name, "crc": entry.CRC, "size": len(content), "record": len(record)}, record))
            size += len(record)
    if held:
        yield run()


_RUN = {"task": pa.int32(), "step": pa.int64(), "entries": pa.list_(pa.struct([("name", pa.string()), ("crc", pa.int64()), ("size", pa.int64()), ("record", pa.int64())])), "content": pa.binary()}
_RUNS = "task int, step long, entries array<struct<name:string,crc:bigint,size:bigint,record:bigint>>, content binary"


def _central(entries: list, at: int) -> bytes:
    """The central records of a run whose local records begin at a place."""
    out = []
    for e in entries:
        entry, far = _entry(e.name, e.crc, e.size), at > zipfile.ZIP64_LIMIT
        local = entry.FileHeader()  # version to flags, times, sizes and the length of the name stand alike in both
        extra, version = (struct.pack("<HHQ", 1, 8, at), b"\x2d\x00") if far else (b"", local[4:6])
        fixed = struct.pack("<HHHHLL", len(extra), 0, 0, 0, entry.external_attr, 0xFFFFFFFF if far else at)
        out.append(b"PK\x01\x02" + version[:1] + bytes([entry.create_system]) + version + local[6:28] + fixed + local[30:] + extra)
        at += e.record
    return b"".join(out)


def _end(n: int, size: int, at: int) -> bytes:
    """The end record of a directory, with longer ones before it where a number is too large for it."""
    out = b""
    if n > zipfile.ZIP_FILECOUNT_LIMIT or max(size, at) > zipfile.ZIP64_LIMIT:
        out = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, at) + struct.pack("<4sLQL", b"PK\x06\x07", 0, at + size, 1)
    return out + struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, 0xFFFFFFFF), min(at, 0xFFFFFFFF), 0)


def write_pieces(parts: DataFrame) -> DataFrame:
    """(package, at, content): the archives of ``write_packages`` in pieces of whole records, for packages of any size.

    A package may lie in many tasks: parts are sorted over all of them, runs of records are written to the shared folder, and
    only the runs' lengths and directories are summed up.
    """
    kind = parts.schema["package"].dataType.simpleString()
    ordered = parts.select("package", "name", "content").repartitionByRange("package", "name").sortWithinPartitions("package", "name")
    runs = SharedTables(parts.sparkSession, "archives").cut("runs", ordered.mapInArrow(_runs, f"package {kind}, {_RUNS}"))
    order = Window.partitionBy("package").orderBy("task", "step")
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a + e["record"])
    placed = runs.select("package", "task", "step", "entries", size.alias("size")).withColumn("at", before("size"))
    local = runs.drop("entries").join(placed.select("package", "task", "step", "at"), ["package", "task", "step"]).select("package", "at", "content")
    listed = placed.withColumn("content", F.udf(_central, BinaryType())("entries", "at")).withColumn("length", F.octet_length("content").cast("long"))
    whole = listed.groupBy("package").agg(F.sum(F.size("entries")).alias("n"), F.sum("size").alias("from"), F.sum("length").alias("length"))
    directory = listed.withColumn("past", before("length")).drop("length").join(whole, "package").select("package", (F.col("from") + F.col("past")).alias("at"), "content")
    end = whole.select("package", (F.col("from") + F.col("length")).alias("at"), F.udf(_end, BinaryType())("n", "length", "from").alias("content"))
    return local.unionByName(directory).unionByName(end)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The local and central records of pieces: which it is, the place of the local record, name, size, and whether its content is sound."""
    for batch in batches:
        for row in range(batch.num_rows):
            at, content = batch.column(1)[row].as_py(), batch.column(2)[row].as_buffer()
            x, here, found = memoryview(content), 0, []
            while here < len(x) and (mark := bytes(x[here : here + 4])) in (b"PK\x03\x04", b"PK\x01\x02"):
                local = mark == b"PK\x03\x04"
                flags, _, _, _, crc, size, _, names, extra = struct.unpack_from("<4H3L2H", x, here + (6 if local else 8))
                body = here + (30 if local else 46)
                name = bytes(x[body : body + names]).decode("utf-8" if flags & 0x800 else "cp437")
                body += names + extra
                place = at + here if local else struct.unpack_from("<L", x, here + 42)[0]
                if not local and place == 0xFFFFFFFF:
                    place = struct.unpack_from("<Q", x, body - extra + 4)[0]
                found.append((local, place, name, size, crc, local and zlib.crc32(x[body : body + size]) == crc))
                here = body + size if local else body + struct.unpack_from("<H", x, here + 32)[0]
            keys = batch.column(0).take(pa.array([row] * len(found), pa.int32()))
            columns = zip(zip(*found, strict=True), (pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True) if found else ()
            if found:
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in columns)], names=["package", "local", "at", "name", "size", "crc", "sound"])


def read_pieces(pieces: DataFrame) -> DataFrame:
    """(package, name, at, size, problem) of the entries that the directories of archives in pieces of whole records list.

    An entry whose local record is not where the directory says, or says something else, or whose content fails its checksum is BROKEN.
    """
    kind = pieces.schema["package"].dataType.simpleString()
    found = pieces.select("package", "at", "content").mapInArrow(_records, f"package {kind}, local boolean, at long, name string, size long, crc long, sound boolean")
    key = ["package", "at", "name", "size", "crc"]
    # Listed entries and local records meet under their place.
    whole = found.groupBy(*key).agg(F.count_if(~F.col("local")).alias("listed"), F.bool_or("sound").alias("sound"))
    return whole.where("listed > 0").select("package", "name", "at", "size", F.when(~F.col("sound"), "BROKEN").alias("problem"))


def render_shapes(objects: DataFrame) -> DataFrame:
    """(scope_id, xml): shapes of each scope in painter's order, from (scope_id, id, kind, z, x, y, width, height)."""
    ids = F.row_number().over(Window.partitionBy("scope_id").orderBy("z", "id")) + 1
    emu = lambda c: (F.col(c) * 7620).cast("long").cast("string")
    preset = F.when(F.col("kind") == "ellipse", "ellipse").when(F.col("kind") == "line", "line").otherwise("rect")
    xml = F.format_string('<p:sp><p:cNvPr id="%d" name="%s"/><a:off x="%s" y="%s"/><a:ext cx="%s" cy="%s"/><a:prstGeom prst="%s"/></p:sp>', "n", escape_xml(F.col("id"), attribute=True), emu("x"), emu("y"), emu("width"), emu("height"), preset)
    rows = objects.withColumn("n", ids).select("scope_id", "n", xml.alias("xml"))
    return rows.groupBy("scope_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "xml"))), lambda r: r["xml"]), "").alias("xml"))


def archive_sizes(parts: DataFrame) -> DataFrame:
    """(package, archive_size, n_parts): the bytes that ``write_packages`` makes, without making them.

    Each part has a local and a central header of 30 and 46 bytes, its name in both, and its content as it is; the end
    record has 22 bytes.
    """
    each = F.octet_length("content") + 2 * F.octet_length(F.encode("name", "UTF-8")) + 76
    return parts.groupBy("package").agg((F.sum(each) + 22).alias("archive_size"), F.count("*").alias("n_parts"))
