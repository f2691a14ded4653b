"""MinHash near-duplicate detection with exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import connected_components, contract
from docloom.llm.node_ids import NodeIds
from docloom.llm.textblocks import mix64, shingle_sets, text_slices
from docloom.llm.workspace import Workspace

BANDS, ROWS, SHINGLE = 20, 4, 5
#: A shingle that more than one open row in so many has is common; of these at most so many are told apart by their counts.
COMMON_SHARE, COMMON_MOST = 1024, 1 << 18
QUERY_BLOCK, MEMBER_BLOCK = 512, 4096
#: A class of more than one row in so many is joined by broadcast; there are fewer than that many such classes.
HOT_CLASSES = 1000


def _hash_functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:count] | np.uint64(1), seeds[count:]


def _signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """Minima of many multiply-shift hashes over each non-empty set."""
    a, b = _hash_functions(count)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), count), np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat((flat * a[k] + b[k]) >> np.uint64(32), starts)
    return out


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(sig), bands), np.uint64)
    for k in range(bands):
        acc = mix64(np.full(len(sig), k + 1, np.uint64))
        for r in range(rows):
            acc = mix64(acc ^ sig[:, k * rows + r])
        keys[:, k] = acc
    return keys.view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch], bands: int, rows: int, n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in text_slices(batch.column("text")):
            sets = shingle_sets(buf, offs, n)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            sketch: list = [None] * len(sets)
            if full:
                minima = _signatures([sets[i] for i in full], bands * rows)
                found = _band_keys(minima, bands, rows)
                for i, row, low in zip(full, found, minima.astype(np.uint8), strict=True):
                    keys[i], sketch[i] = row, low.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(lo, hi - lo),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(sketch, pa.binary()),
                ],
                names=["id", "digest", "n", "bands", "sketch"],
            )


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch], percent: int, bands: int, rows: int, n: int) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose signatures agree enough and whose full sets are similar enough."""
    count, margin = bands * rows, _margin(percent, bands * rows)
    for batch in batches:
        u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
        keep = np.zeros(len(u), bool)
        left, right = batch.column("u_text"), batch.column("v_text")
        step = 64
        for at in range(0, len(u), step):
            sides = []
            for col in (left, right):
                got: list[np.ndarray] = []
                for _, _, buf, offs in text_slices(col.slice(at, step)):
                    got += shingle_sets(buf, offs, n)
                sides.append(got)
            known: dict[bytes, np.ndarray] = {}
            for k, (x, y) in enumerate(zip(*sides, strict=True)):
                if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                sx, sy = (known.setdefault(s.tobytes(), None) for s in (x, y))
                if sx is None:
                    sx = known[x.tobytes()] = _signatures([x], count)[0]
                if sy is None:
                    sy = known[y.tobytes()] = _signatures([y], count)[0]
                if np.mean(sx == sy) >= margin:
                    keep[at + k] = _linked(x, y, percent)
        yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])


def _agree(batches: Iterator[pa.RecordBatch], percent: int, count: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches (the last byte of each of their minima) agree as often as those of similar rows do."""
    margin = _margin(percent, count)
    for batch in batches:
        u, v = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, count) for c in ("u_sketch", "v_sketch"))
        yield batch.select(["u", "v"]).filter(pa.array((u == v).mean(axis=1) >= margin))


def _margin(percent: int, count: int) -> float:
    """The share of equal minima that a similar pair falls short of once in a thousand million times."""
    return max(0.0, percent / 100 - 6 * np.sqrt(0.25 * 0.6 / count))


def _common(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Of all shingles of a task's texts, those that are in more than a small share of these texts, with their counts."""
    for batch in batches:
        sets = [s for _, _, buf, offs in text_slices(batch.column("text")) for s in shingle_sets(buf, offs, n)]
        values, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = counts > max(1, len(sets) // (2 * COMMON_SHARE))
        yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["shingle", "rows"])


def _rare(batches: Iterator[pa.RecordBatch], percent: int, n: int, common) -> Iterator[pa.RecordBatch]:
    """Each text's rarest shingles, as many as leave it too few for a similar text to share only the others."""
    known, weights = common.value
    for batch in batches:
        ids: list[np.ndarray] = []
        out: list[np.ndarray] = []
        own = batch.column("id").to_numpy()
        for lo, _, buf, offs in text_slices(batch.column("text")):
            for k, s in enumerate(shingle_sets(buf, offs, n)):
                at = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
                weight = np.where(known[at] == s, weights[at], 0) if len(known) else np.zeros(len(s), np.int64)
                least = len(s) + percent * len(s) // -100 + 1  # the size less the shared part, rounded up
                rare = s[np.lexsort((s, weight))][:least]
                out.append(rare)
                ids.append(np.full(len(rare), own[lo + k]))
        flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64), pa.int64()), pa.array(flat.view(np.int64))], names=["id", "shingle"])


def with_partners(rows: DataFrame, texts: DataFrame, ws: Workspace, percent: int, n: int = SHINGLE) -> DataFrame:
    """The ids of rows (id, label, asks) that may have a similar row of another label, where one of the two asks.

    Shingles are put in one order, the common ones last. Two sets at or over the similarity share one of the first of each, so
    a row has a partner only if one of its first shingles is a first shingle of another label too. Rows of one template,
    which share only what all of them have, have none. A shingle is one aggregate, so no pair is made.
    """
    open_texts = texts.hint("merge").join(rows.select("id").distinct(), "id", "left_semi")
    many = rows.count()
    counts = open_texts.select("text").mapInArrow(lambda it: _common(it, n), "shingle long, rows long").groupBy("shingle").agg(F.sum("rows").alias("rows"))
    held = counts.where(F.col("rows") > many // COMMON_SHARE).orderBy(F.desc("rows"), "shingle").limit(COMMON_MOST).collect()
    table = np.array([(r.shingle, r.rows) for r in held], np.int64).reshape(-1, 2)
    order = np.argsort(table[:, 0].view(np.uint64), kind="stable")
    common = rows.sparkSession.sparkContext.broadcast((np.ascontiguousarray(table[order, 0]).view(np.uint64), table[order, 1]))
    first = open_texts.select("id", "text").mapInArrow(lambda it: _rare(it, percent, n, common), "id long, shingle long")
    met = ws.table("first", first.hint("merge").join(rows, "id"))
    shared = met.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.bool_or("asks").alias("asked")).where("low < high AND asked").select("shingle")
    return met.join(shared, "shingle", "left_semi").select("id").distinct()


def _link_block(table: pa.Table, percent: int, n: int) -> pa.Table:
    """Links between the queries of a block and all its members, reduced to those that join different groups."""
    table = table.combine_chunks()
    ids, groups = table.column("id").to_numpy(), table.column("label").to_numpy()
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    sets: list[np.ndarray] = []
    for _, _, buf, offs in text_slices(table.column("text")):
        sets += shingle_sets(buf, offs, n)
    members, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
    out_u, out_v = [], []
    if len(members) and len(queries):
        values, codes = np.unique(np.concatenate([sets[i] for i in members]), return_inverse=True)
        sizes = np.array([len(sets[i]) for i in members])
        starts = np.cumsum(sizes) - sizes
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        mark = np.zeros(len(values), np.int32)
        for q in queries:
            at = np.searchsorted(values, sets[q])
            at = at[(at < len(values))]
            at = at[np.isin(values[at], sets[q], assume_unique=True)]
            mark[at] = 1
            both = np.add.reduceat(mark[codes], starts)
            mark[at] = 0
            for m in np.flatnonzero(100 * both >= percent * (sizes + len(sets[q]) - both)):
                a, b = root(int(groups[q])), root(int(groups[members[m]]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out_u.append(int(ids[q]))
                    out_v.append(int(ids[members[m]]))
    return pa.table({"u": pa.array(out_u, pa.int64()), "v": pa.array(out_v, pa.int64())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Returns (id, n_shingles, component_id, kept) for every row.

    Texts are sets of n-word shingles (A-Z lower-cased). Rows with equal sets form a class that its smallest id stands
    for; representatives get ``bands * rows`` universal-hash minima, and those that share a band become candidates.
    In each bucket all members are compared with the member that meets most others; members that this leaves in
    another group are then compared with the whole bucket, in blocks of bounded size spread over the cluster. Only members
    with a partner come so far: one of a set's rarest shingles must be among those of a similar set, so what all pages of a
    template have in common brings none of them together. Sketches of the minima are compared before texts meet a leader's,
    and every link is confirmed on full shingle sets. Components come from alternating large-star and small-star rounds.

    Ids may be of any type that has an order.

    Defined cases: a null or blank text has no shingles, is linked with nothing and is its own component; a row with
    null id is linked with nothing and has a null component and kept = true; rows that share an id count as one
    document; repeated rows each get their result; a pair at exactly the similarity is linked; a text of any length is
    compared whole, in memory proportional to it; an empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "near")
    ids = NodeIds(docs, id_col, ws)
    given = ids.numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    sig = ws.table("sig", given.mapInArrow(lambda it: _describe(it, bands, rows, n), "id long, digest binary, n long, bands array<long>, sketch binary"))
    count = sig.count()
    few, many = ws.tasks(count * bands, 1_000_000), ws.tasks(count, 20_000, 16)
    able = sig.where("n > 0 AND id IS NOT NULL")
    classes = ws.table("classes", able.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), few)
    # A class's rows meet its smallest id by that id, not by the digest that all copies share.
    reps = able.join(classes.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
    keyed = reps.select("id", F.explode("bands").alias("key"))
    who = [F.bit_xor(F.xxhash64("id")).alias("who"), F.sum(F.pmod(F.xxhash64("id"), F.lit(1 << 31))).alias("also")]
    buckets = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi"), *who).where("lo < hi")
    buckets = buckets.groupBy("size", "lo", "hi", "who", "also").agg(F.min("key").alias("key")).select("key", "size")
    inc = ws.table("inc", keyed.join(buckets, "key").select("key", "size", "id").distinct(), few)
    central = inc.groupBy("id").agg(F.sum("size").alias("met"))
    leaders = inc.join(central, "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("neg"))).alias("best")).select("key", (-F.col("best.neg")).alias("leader"))
    inc = ws.table("led", inc.join(leaders, "key"), few)
    # One plan at every size: the texts are dealt by id, never met by a broadcast that only small inputs allow.
    cand = ws.table("cand", given.hint("merge").join(inc.select("id").distinct(), "id", "left_semi"), many)

    text_of = lambda name: cand.select(F.col("id").alias(name), F.col("text").alias(f"{name}_text"))
    sketches = reps.select("id", "sketch").dropDuplicates(["id"])
    sketch_of = lambda name: sketches.select(F.col("id").alias(name), F.col("sketch").alias(f"{name}_sketch"))

    def confirmed(name: str, pairs: DataFrame) -> DataFrame:
        """Links among pairs: sketches meet first, and only the texts of pairs whose sketches agree."""
        near = pairs.hint("merge").join(sketch_of("u"), "u").hint("merge").join(sketch_of("v"), "v").mapInArrow(lambda it: _agree(it, percent, bands * rows), "u long, v long")
        near = ws.table(f"{name}-near", near, few)
        return ws.table(name, near.join(text_of("u"), "u").join(text_of("v"), "v").mapInArrow(lambda it: _verify(it, percent, bands, rows, n), "u long, v long"))

    star = confirmed("star", inc.where("id <> leader").select(F.least("id", "leader").alias("u"), F.greatest("id", "leader").alias("v")).distinct())
    # Two rounds bring most groups to one root. Those of one root are connected, which is all that a label claims.
    stars = contract(star, ws, "first", 2)
    groups = stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))

    label = F.coalesce("root", "id")
    seen = inc.where("size > 2").join(groups.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "leader", label.alias("label"))
    heads = groups.select(F.col("node").alias("leader"), F.col("root").alias("head"))
    seen = seen.join(heads, "leader", "left").withColumn("asks", F.col("label") != F.coalesce("head", "leader"))
    # Only buckets with a member apart from their leader are open, and of these only the members that may have a partner.
    opened = seen.groupBy("key").agg(F.count_if("asks").alias("q")).where("q > 0").select("key")
    opened = ws.table("open", seen.join(opened, "key", "left_semi"), few)
    once = opened.groupBy("id").agg(F.min("label").alias("label"), F.bool_or("asks").alias("asks"))
    live = ws.table("live", with_partners(once, cand, ws, percent, n), few)
    seen = opened.hint("merge").join(live, "id", "left_semi")
    open_buckets = seen.groupBy("key").agg(F.count("*").alias("m"), F.count_if("asks").alias("q")).where("q > 0 AND m > 1")
    open_buckets = open_buckets.select("key", F.ceil(F.col("m") / MEMBER_BLOCK).cast("int").alias("mb"), F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("qb"))
    spread = seen.join(open_buckets, "key")
    part = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    span = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    queries = spread.where("asks").select("key", "id", "label", "asks", part("qb").alias("qi"), span("mb").alias("mi"))
    members = spread.select("key", "id", "label", F.lit(False).alias("asks"), part("mb").alias("mi"), span("qb").alias("qi"))
    work = queries.unionByName(members).join(cand, "id").select("key", "qi", "mi", "id", "label", "asks", "text")
    more = ws.table("more", work.groupBy("key", "qi", "mi").applyInArrow(lambda t: _link_block(t, percent, n), "u long, v long"), few)

    final = connected_components(stars.unionByName(more), ws, "last")
    for name in ("inc", "led", "cand", "open", "first", "live", "star-near"):
        ws.drop(name)
    # Each class with its component. Few classes can hold more than a thousandth of the rows; those go to every task,
    # and the rows of no other class are many. Blank texts and null ids join nothing.
    owned = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "rows", F.coalesce("root", "rep").alias("owner"))
    owned = ws.table("owned", owned, few)
    is_hot = F.col("rows") > count // HOT_CLASSES
    hot = owned.where(is_hot).select("digest", F.col("owner").alias("hot_owner"))
    met = sig.where("n > 0 AND id IS NOT NULL").select("id", "digest", "n").join(F.broadcast(hot), "digest", "left")
    rest = met.where("hot_owner IS NULL").drop("hot_owner").join(owned.where(~is_hot).select("digest", "owner"), "digest")
    out = met.where("hot_owner IS NOT NULL").select("id", "n", F.col("hot_owner").alias("owner")).unionByName(rest.select("id", "n", "owner"))
    alone = sig.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("owner"))
    out = ids.given(out.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("owner").alias("component_id")), id_col, "component_id")
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
