"""Tries of conversations by their turns: double arrays in shards of the sorted sequences, shared nodes merged."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.runs import laid_runs, whole_runs
from docloom.llm.workspace import Workspace

#: A turn in a packed sequence: 16 bytes of a digest of role and text, and the text's length in 4 bytes.
TURN = 20
SHARD_TURNS = 200_000
#: Sequences are dealt to shards by so many of their first turns.
RANGE_TURNS = 1024
BLOCK_TURNS = 50_000
NO_IDS = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """A trie in two arrays: a child by ``code`` of the node at slot ``s`` is at ``base[s] + code`` and has ``check`` s.

    Nodes are packed level by level. An only child takes the lowest free slot. Several children take the first place
    at which all their slots are free, out of the next few free slots, or else the end of the arrays.
    """

    TRIES = 16

    def __init__(self, size: int):
        self.base = np.zeros(size + 1, np.int64)
        self.check = np.full(size + 1, -1, np.int64)
        self.check[0] = 0
        self.low, self.end = 1, 1

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self, n: int) -> np.ndarray:
        """The n lowest free slots."""
        span = 2 * n + 64
        while True:
            self._grow(self.low + span)
            found = np.flatnonzero(self.check[self.low : self.low + span] < 0)
            if len(found) >= n:
                return found[:n] + self.low
            span *= 2

    def pack(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Gives slots to children, which are distinct and grouped by parent."""
        if not len(parents):
            return
        heads = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        counts = np.diff(np.append(heads, len(parents)))
        for at, n in zip(heads[counts > 1], counts[counts > 1], strict=True):
            own = codes[at : at + n]
            lowest = int(own.min())
            for slot in self._free(self.TRIES):
                self._grow(int(slot - lowest + own.max()) + 1)
                if (self.check[slot - lowest + own] < 0).all():
                    break
            else:
                slot = self.end
            self._take(parents[at : at + 1], np.array([slot - lowest]), own)
        only = heads[counts == 1]
        slots = self._free(len(only))
        self._take(parents[only], slots - codes[only], codes[only])
        if len(slots):
            self.low = int(slots[-1]) + 1

    def _take(self, parents: np.ndarray, bases: np.ndarray, codes: np.ndarray) -> None:
        slots = bases + codes
        if len(slots):
            self._grow(int(slots.max()) + 1)
            self.base[parents] = bases
            self.check[slots] = parents
            self.end = max(self.end, int(slots.max()) + 1)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of nodes by codes; -1 where there is none."""
        slots = self.base[nodes] + codes
        inside = (slots > 0) & (slots < self.end)
        return np.where(inside & (self.check[np.where(inside, slots, 0)] == nodes), slots, -1)


def _dense(sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all turns, their text lengths, each sequence's first turn (one more than sequences), and its length.

    Codes count the distinct turns in the order in which they first appear, level by level, so that the children of a
    node have codes near each other.
    """
    sizes = np.array([len(s) // TURN for s in sequences], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"".join(sequences), np.uint8).reshape(-1, TURN)
    halves = np.ascontiguousarray(raw[:, :16]).view(np.uint64).reshape(-1, 2)
    length = np.ascontiguousarray(raw[:, 16:]).view(">u4").ravel().astype(np.int64)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (halves[order][1:] != halves[order][:-1]).any(axis=1)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    depth = np.arange(len(order)) - np.repeat(first[:-1], sizes)
    by_level = np.argsort(depth, kind="stable")
    _, appears = np.unique(group[by_level], return_index=True)
    rank = np.empty(len(appears), np.int64)
    rank[np.argsort(appears, kind="stable")] = np.arange(len(appears))
    return rank[group], length, first, sizes


class ShardTrie:
    """The trie of sorted distinct sequences: slots by level, and sums over the sequences that pass a node.

    ``before`` and ``after`` say how many turns the first and last sequence share with the neighbouring shards (-1 for no
    neighbour). Nodes on these stretches exist in several shards; the first of them owns the node, and counts it.
    """

    def __init__(self, sequences: list[bytes], weights: np.ndarray, ids: np.ndarray, before: int, after: int):
        codes, lengths, first, sizes = _dense(sequences)
        self.trie = DoubleArray(len(codes))
        levels = [np.zeros(len(sequences), np.int64)]
        rows = [np.arange(len(sequences))]
        for d in range(int(sizes.max(initial=0))):
            on = sizes[rows[d]] > d
            row, node = rows[d][on], levels[d][on]
            code = codes[first[row] + d]
            head = np.ones(len(row), bool)
            head[1:] = (node[1:] != node[:-1]) | (code[1:] != code[:-1])
            self.trie.pack(node[head], code[head])
            rows.append(row)
            levels.append(self.trie.step(node, code))
        n = self.trie.end
        self.n, self.least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        self.depth, self.length = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.ends = np.full(n, -1, np.int64)
        self.key: dict[int, bytes] = {}
        owned = np.ones(n, bool)
        leaf, self.children = np.ones(n, bool), np.zeros(n, np.int64)
        slots, last = [], len(sequences) - 1
        for d, (row, node) in enumerate(zip(rows, levels, strict=True)):
            np.add.at(self.n, node, weights[row])
            np.minimum.at(self.least, node, ids[row])
            slots.append(np.unique(node))
            self.depth[slots[-1]] = d
            if d:
                self.length[node] = lengths[first[row] + d - 1]
            done = sizes[row] == d
            self.ends[node[done]] = row[done]
            if d <= before:
                owned[node[0]] = False
            # Rows of a level are sorted, so sequence 0 comes first in each level it reaches, and the last one last.
            for at, shared in ((0, before), (last, after)):
                if d <= shared and len(node):
                    self.key.setdefault(int(node[0 if at == 0 else -1]), hashlib.sha256(sequences[at][: d * TURN]).digest())
        self.nodes = np.concatenate(slots)
        parents = self.trie.check[:n]
        inner = self.nodes[self.depth[self.nodes] > 0]
        leaf[parents[inner]] = False
        np.add.at(self.children, parents[inner], owned[inner])
        if sizes[last] <= after:
            leaf[levels[int(sizes[last])][-1]] = False  # it goes on in the next shard
        self.leaves = leaf.astype(np.int64)
        self.saved = (self.n - owned) * self.length
        for level in reversed(slots[1:]):
            np.add.at(self.leaves, parents[level], self.leaves[level])
            np.add.at(self.saved, parents[level], self.saved[level])


_NODES = "node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _shard_nodes(left: pa.Table, right: pa.Table) -> pa.Table:
    """Nodes of one shard; ``node`` and ``parent`` name those that other shards may have too."""
    names = [c.split(" ")[0] for c in _NODES.split(", ")]
    rows = sorted(zip(left["seq"].to_pylist(), left["n"].to_pylist(), left["least"].to_pylist(), left["ends"].to_pylist(), strict=True))
    before, after = (int(right[c][0].as_py()) for c in ("before", "after"))
    trie = ShardTrie([r[0] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), before, after)
    at = trie.nodes
    parent = trie.trie.check[at]
    top = trie.depth[at] == 0
    key = [trie.key.get(s) for s in at.tolist()]
    above = [None if t else trie.key.get(s) for s, t in zip(parent.tolist(), top, strict=True)]
    ends = [rows[e][3] if e >= 0 else None for e in trie.ends[at].tolist()]
    columns = [pa.array(key, pa.binary()), pa.array(above, pa.binary()), trie.least[at], trie.depth[at], pa.array(trie.least[parent], mask=top), trie.n[at], trie.children[at], trie.leaves[at], trie.saved[at], pa.array(ends, pa.string())]
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _shared_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many turns two sequences have in common from their start."""
    for batch in batches:
        out = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            n = min(len(a), len(b))
            differs = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
            out.append((int(differs[0]) if len(differs) else n) // TURN)
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("other"), pa.array(out, pa.int64())], names=["shard", "other", "shared"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of keys whose values come in several pieces, key by key and in order; no piece is kept."""
    key, state, n, least, rows = None, None, 0, 0, []
    for batch in batches:
        for k, m, v in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "value")), strict=True):
            if k != key:
                if state:
                    rows.append((key, n, least, state.hexdigest()))
                key, state, n, least = k, hashlib.sha256(), 0, int(v[: v.index(b",")])
                state.update(v[:-1])
            else:
                state.update(b"," + v[:-1])
            n += m
    if state:
        rows.append((key, n, least, state.hexdigest()))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["key", "n", "least", "ends"])


def turn_sequences(turns: DataFrame, ws: Workspace, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, seq): each conversation's turns in order, packed in ``TURN`` bytes each.

    A turn is told by 128 bits of a digest of its role and text (null is empty). Turns are in the order of their number,
    null first; equal numbers in the order of their role, then of their digest. Rows without a conversation are left out.
    A conversation may have a third of all turns: rows are dealt by ranges of conversation and turn. It is one packed row in
    the end, of at most 2**30 bytes (53 million turns); a longer one is refused with an error.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    record = F.unhex(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.length(text).cast("long")), 8, "0")))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("key"), F.col(turn_col).alias("at"), role.alias("role"), record.alias("value"))
    pieces = laid_runs(ws, "turns", rows, ["at", "role", "value"], ws.tasks(rows.count(), BLOCK_TURNS))
    return ws.table("sequences", whole_runs(pieces).select(F.col("key").alias("conv_id"), F.col("value").alias("seq")))


def share_openings(sequences: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % every, where h = crc32(c) % most.

    Fewer turns than h are all taken, an absent conversation gives none. One conversation opens at most ``every``
    others, so no key of the join is frequent.
    """
    heads = sequences.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.expr(f"substring(seq, 1, {TURN * most})").alias("head"))
    own = sequences.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", F.expr(f"cast(crc32(encode(cast(conv_id AS string), 'UTF-8')) % {most} AS int)"))
    joined = own.join(heads, "base", "left")
    return joined.select("conv_id", F.expr(f"concat(coalesce(substring(head, 1, {TURN} * h), X''), substring(seq, {TURN} * h + 1))").alias("seq"))


def prefix_trie(sequences: DataFrame, ws: Workspace) -> DataFrame:
    """A row for each distinct prefix of the packed sequences: see ``conversation_trie``."""
    keyed = ws.table("keyed", sequences.select("conv_id", "seq", F.unhex(F.sha2("seq", 256)).alias("key")))
    rows, turns = keyed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("seq")), F.lit(0)) / TURN).first()
    ids = keyed.select("key", "conv_id", F.encode(F.concat(F.col("conv_id").cast("string"), F.lit(",")), "UTF-8").alias("value"))
    pieces = laid_runs(ws, "ids", ids, ["conv_id"], ws.tasks(rows, BLOCK_TURNS))
    whole = pieces.where("NOT edge").select("key", "n", F.expr("cast(substring_index(decode(value, 'UTF-8'), ',', 1) AS long)").alias("least"), F.expr("sha2(substring(value, 1, length(value) - 1), 256)").alias("ends"))
    cut = pieces.where("edge").select("key", "part", "n", "value").repartition("key").sortWithinPartitions("key", "part")
    members = whole.unionByName(cut.mapInArrow(_digests, "key binary, n long, least long, ends string"))
    distinct = keyed.groupBy("key").agg(F.first("seq").alias("seq")).join(members, "key")
    ranged = distinct.repartitionByRange(ws.tasks(int(turns), SHARD_TURNS, 1), F.expr(f"substring(seq, 1, {TURN * RANGE_TURNS})"))
    shards = ws.table("shards", ranged.select(F.spark_partition_id().alias("shard"), "seq", "n", "least", "ends"))
    ends = ws.table("ends", shards.groupBy("shard").agg(F.min("seq").alias("low"), F.max("seq").alias("high")))
    # The order of the shards is one number for each; only these numbers meet in one task.
    order = ends.select("shard", F.lag("shard").over(Window.orderBy("shard")).alias("other")).where("other IS NOT NULL")
    pairs = order.join(ends.select("shard", F.col("low").alias("a")), "shard").join(ends.select(F.col("shard").alias("other"), F.col("high").alias("b")), "other")
    shared = ws.table("shared", pairs.select("shard", "other", "a", "b").mapInArrow(_shared_turns, "shard int, other int, shared long"))
    bounds = ends.select("shard").join(shared.select("shard", F.col("shared").alias("before")), "shard", "left").join(shared.select(F.col("other").alias("shard"), F.col("shared").alias("after")), "shard", "left").fillna(-1)
    nodes = ws.table("nodes", shards.groupBy("shard").cogroup(bounds.groupBy("shard")).applyInArrow(_shard_nodes, _NODES))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    upper = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    upper = ws.table("upper", upper)
    above = upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    rim = nodes.where("node IS NULL AND parent IS NOT NULL").drop("parent_conv_id").join(above, "parent")
    top = upper.join(above, "parent", "left")
    own = nodes.where("node IS NULL AND parent IS NULL")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256")]
    return own.select(columns).unionByName(rim.select(columns)).unionByName(top.select(columns))


def conversation_trie(turns: DataFrame, openings: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Returns a row for each distinct prefix of the conversations, from the empty one: (conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    A node is named by its depth and by the smallest conversation that passes it, whose first turns it stands for. Members
    are the conversations that begin with it; ``n_leaves`` and ``saved_tokens`` are sums over its subtree, the latter of
    (members - 1) times the code points of a node's last text; ``ends_sha256`` is the digest of the ids that end there, in
    numeric order, joined by commas. ``openings`` shares the openings of conversations first (``share_openings``).

    Equal conversations meet before the tries, so a group of copies of any size is one sequence; a digest of ids is
    streamed. Sequences are sorted into shards, so a frequent opening spreads over many of them. A shard packs a double
    array over dense ids of its turns and walks it. Two shards can share only nodes on the two sequences that meet
    at their border; those nodes are named, owned by the first shard that has them, and merged over all shards.

    Defined cases: a null role or text is empty; null turns come first, ties are in the order of role and digest; repeated
    rows are turns of their own; rows without a conversation are left out; an empty text is a turn; an empty table gives
    an empty result; texts are read once and are not kept; further columns are ignored. Ids are whole numbers. Sequences
    that agree in their first 1,024 turns are in one shard.
    """
    ws = Workspace(turns.sparkSession, "prefix-trie")
    sequences = turn_sequences(turns, ws, conv_col, turn_col, role_col, text_col)
    return prefix_trie(share_openings(sequences) if openings else sequences, ws)
