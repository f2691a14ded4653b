"""Exact removal of repeated word spans, over a de Bruijn graph of word windows.

Windows of ``n`` words are the edges of the graph. Only windows whose minimizer (the least hash among their shorter
k-mers) occurs in several documents can repeat, so those are found first. The remaining edges are joined with the
smallest document that holds them, which gives each a source coordinate; edges that follow one another both in the
document and in the source are a nonbranching path and compact into one span, and each span is verified word by word
at its source coordinate before its words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.node_ids import NodeIds
from docloom.llm.packing import by_id, pack_ints, ragged_binary, unpack_ints
from docloom.llm.textblocks import mix64, rows_of, span_hashes, text_slices, whole_windows, window_hashes, word_spans
from docloom.llm.workspace import Workspace

WINDOW, KMER = 13, 6
BLOCK_BYTES = 16 << 20
BUCKET_BYTES = 16 << 20
#: What a block tells its own ids goes in pieces of so many entries, each to a bucket of its own.
TOLD_ENTRIES = 1 << 15

_HIT = np.dtype([("pos", np.int64), ("src", np.int64), ("at", np.int64)])
_PATH = np.dtype([("pos", np.int64), ("src", np.int64), ("at", np.int64), ("edges", np.int64)])
_SPAN = np.dtype([("pos", np.int64), ("len", np.int64), ("check", "V16")])
_ASK = np.dtype([("at", np.int64), ("id", np.int64), ("pos", np.int64), ("len", np.int64), ("check", "V16")])
#: Bases of the window hash: where a window's smallest source proves to be another text's, all is done with the next.
WINDOW_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def _least_kmers(words: np.ndarray, n: int, k: int) -> np.ndarray:
    """For each n-word window, the least hash among its k-word windows."""
    kmers = window_hashes(words, k)
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    least = kmers[:size].copy()
    for j in range(1, n - k + 1):
        np.minimum(least, kmers[j : j + size], out=least)
    return least


def _bucket_cuts(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of ascending hashes, and the cuts between them."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    return bucket[cuts[:-1]], cuts


def _starts(sorted_hashes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(sorted_hashes[1:] != sorted_hashes[:-1]) + 1])


def _message(kind: int, routes: list[int], columns: list[list[bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(routes, pa.int32()), pa.array([kind] * len(routes), pa.int32()), *[pa.array(c, pa.binary()) for c in columns]],
        names=["route", "kind", *[f"c{i}" for i in range(len(columns))]],
    )


def _told(kind: int, task: int, block: int, buckets: int, columns: list[np.ndarray], most: int = TOLD_ENTRIES) -> pa.RecordBatch:
    """Entries that need no answer, in pieces of at most ``most``, dealt by a hash of task, block and piece."""
    cuts = list(range(0, len(columns[0]), most))
    seed = mix64(np.array([task << 32 | block], np.uint64))
    routes = mix64(seed + np.arange(len(cuts), dtype=np.uint64)) % np.uint64(buckets)
    pack = lambda x: x.tobytes() if x.dtype == np.uint64 else pack_ints(x)
    return _message(kind, routes.astype(np.int64).tolist(), [[pack(x[a : a + most]) for a in cuts] for x in columns])


def _task() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def _dealt(ids: np.ndarray, body: np.ndarray, groups: int) -> pa.Table:
    """(part, ids, body): the entries packed by part, a hash of the id."""
    part, cuts, (ids, body) = by_id((mix64(ids.astype(np.uint64)) % np.uint64(groups)).astype(np.int64), ids, body)
    packed = [pack_ints(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"part": pa.array(part, pa.int64()), "ids": pa.array(packed, pa.binary()), "body": ragged_binary(body, cuts)})


def _gathered(table: pa.Table, kind: np.dtype | type) -> tuple[np.ndarray, np.ndarray]:
    ids = [unpack_ints(x) for x in table.column("ids").to_pylist()]
    body = [np.frombuffer(x, kind) for x in table.column("body").to_pylist()]
    return np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0, kind), *body])


def _gather_marks(table: pa.Table) -> pa.Table:
    """(key, marks): all marks of each id of a part."""
    owner, cuts, (marks,) = by_id(*_gathered(table, np.uint64))
    return pa.table({"key": pa.array(owner, pa.int64()), "marks": ragged_binary(marks, cuts)})


def _gather_paths(table: pa.Table) -> pa.Table:
    """(key, paths): each id's edges, those that follow one another in document and source compacted to one path."""
    ids, hits = _gathered(table, _HIT)
    order = np.lexsort((hits["at"], hits["src"], hits["pos"], ids))
    ids, hits = ids[order], hits[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (np.diff(hits["pos"]) != 1) | (np.diff(hits["src"]) != 0) | (np.diff(hits["at"]) != 1)
    heads = np.flatnonzero(new)
    paths = np.zeros(len(heads), _PATH)
    for name in ("pos", "src", "at"):
        paths[name] = hits[name][heads]
    paths["edges"] = np.diff(np.append(heads, len(ids)))
    owner, cuts, (paths,) = by_id(ids[heads], paths)
    return pa.table({"key": pa.array(owner, pa.int64()), "paths": ragged_binary(paths, cuts)})


def _send_minimizers(batches: Iterator[pa.RecordBatch], buckets: int, n: int, k: int) -> Iterator[pa.RecordBatch]:
    """Per block of text: each minimizer once with its smallest id (kind 0) or, if several ids of the block hold it,
    without (kind 1); and to those ids, that it repeats (kind 2)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = turn = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal turn
        hashes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        if not len(hashes):
            return
        order = np.argsort(hashes, kind="stable")
        hashes, ids = hashes[order], ids[order]
        cut = _starts(hashes)
        low, high = np.minimum.reduceat(ids, cut), np.maximum.reduceat(ids, cut)
        many = low != high
        for kind, pick in ((0, ~many), (1, many)):
            if pick.any():
                own, own_ids = hashes[cut[pick]], low[pick]
                routes, cuts = _bucket_cuts(own, buckets)
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield _message(kind, routes.tolist(), [[own[a:b].tobytes() for a, b in spans], [pack_ints(own_ids[a:b]) if not kind else b"" for a, b in spans]])
        told = np.repeat(many, np.diff(np.append(cut, len(hashes))))
        if told.any():
            turn += 1
            yield _told(2, _task(), turn, buckets, [hashes[told], ids[told]])

    for batch in batches:
        row_ids = batch.column("id").to_numpy()
        for lo, _, buf, offs in text_slices(batch.column("text")):
            starts, ends, first = word_spans(buf, offs)
            at = whole_windows(first, n)
            least = _least_kmers(span_hashes(buf, starts, ends), n, k)[at]
            rows = rows_of(first)[at]
            new = np.ones(len(at), bool)
            new[1:] = (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])
            held.append((least[new], row_ids[lo:][rows[new]]))
            size += len(buf)
            if size >= BLOCK_BYTES:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def _answer_minimizers(table: pa.Table, groups: int) -> pa.Table:
    """The minimizers of a bucket that several ids hold, for each id that asked."""
    kinds = table.column("kind").to_pylist()
    hashes = [np.frombuffer(x, np.uint64) for x in table.column("c0").to_pylist()]
    ids = [unpack_ints(x) for x in table.column("c1").to_pylist()]
    pick = lambda col, kind, dtype: np.concatenate([np.zeros(0, dtype), *[c for c, x in zip(col, kinds, strict=True) if x == kind]])
    h, i = pick(hashes, 0, np.uint64), pick(ids, 0, np.int64)
    if len(h):
        order = np.argsort(h, kind="stable")
        h, i = h[order], i[order]
        cut = _starts(h)
        repeated = (np.minimum.reduceat(i, cut) != np.maximum.reduceat(i, cut)) | np.isin(h[cut], pick(hashes, 1, np.uint64))
        asked = np.repeat(repeated, np.diff(np.append(cut, len(h))))
        h, i = h[asked], i[asked]
    h, i = np.concatenate([h, pick(hashes, 2, np.uint64)]), np.concatenate([i, pick(ids, 2, np.int64)])
    return _dealt(i, h, groups)


def _send_windows(batches: Iterator[pa.RecordBatch], buckets: int, n: int, k: int, base: int = WINDOW_BASES[0]) -> Iterator[pa.RecordBatch]:
    """Per block of text: each possibly repeated window of the block's smallest id (kind 0); for the block's other ids
    that hold it, where its source is (kind 1)."""
    held: list[tuple[np.ndarray, ...]] = []
    size = turn = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal turn
        hashes, ids, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        if not len(hashes):
            return
        order = np.lexsort((pos, ids, hashes))
        hashes, ids, pos = hashes[order], ids[order], pos[order]
        cut = _starts(hashes)
        sizes = np.diff(np.append(cut, len(hashes)))
        src, at = np.repeat(ids[cut], sizes), np.repeat(pos[cut], sizes)
        later = ids != src
        asks = ~later
        own, own_ids, own_pos = hashes[asks], ids[asks], pos[asks]
        routes, cuts = _bucket_cuts(own, buckets)
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        yield _message(0, routes.tolist(), [[own[a:b].tobytes() for a, b in spans], [pack_ints(own_ids[a:b]) for a, b in spans], [pack_ints(own_pos[a:b]) for a, b in spans], [b""] * len(spans)])
        if later.any():
            turn += 1
            yield _told(1, _task(), turn, buckets, [x[later] for x in (ids, pos, src, at)])

    for batch in batches:
        row_ids, marks = batch.column("key").to_numpy(), batch.column("marks")
        for lo, hi, buf, offs in text_slices(batch.column("text")):
            starts, ends, first = word_spans(buf, offs)
            words = span_hashes(buf, starts, ends)
            at = whole_windows(first, n)
            rows = rows_of(first)[at]
            least = _least_kmers(words, n, k)[at]
            keep = np.zeros(len(at), bool)
            edge = np.searchsorted(rows, np.arange(hi - lo + 1))
            for r in range(hi - lo):
                keep[edge[r] : edge[r + 1]] = np.isin(least[edge[r] : edge[r + 1]], np.frombuffer(marks[lo + r].as_py(), np.uint64))
            at, rows = at[keep], rows[keep]
            held.append((window_hashes(words, n, base)[at], row_ids[lo:][rows], at - first[rows]))
            size += len(buf)
            if size >= BLOCK_BYTES:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def _answer_windows(table: pa.Table, groups: int) -> pa.Table:
    """The windows of a bucket that a smaller id holds, with the source coordinate of its first."""
    kinds = table.column("kind").to_pylist()
    columns = [table.column(f"c{i}").to_pylist() for i in range(4)]
    pick = lambda c, kind, read, dtype: np.concatenate([np.zeros(0, dtype), *[read(x) for x, y in zip(columns[c], kinds, strict=True) if y == kind]])
    h = pick(0, 0, lambda x: np.frombuffer(x, np.uint64), np.uint64)
    ids, pos = pick(1, 0, unpack_ints, np.int64), pick(2, 0, unpack_ints, np.int64)
    told = [pick(c, 1, unpack_ints, np.int64) for c in range(4)]
    if len(h):
        order = np.lexsort((pos, ids, h))
        h, ids, pos = h[order], ids[order], pos[order]
        cut = _starts(h)
        sizes = np.diff(np.append(cut, len(h)))
        src, at = np.repeat(ids[cut], sizes), np.repeat(pos[cut], sizes)
        later = ids != src
        told = [np.concatenate([x, y[later]]) for x, y in zip(told, (ids, pos, src, at), strict=True)]
    hits = np.zeros(len(told[0]), _HIT)
    hits["pos"], hits["src"], hits["at"] = told[1:]
    return _dealt(told[0], hits, groups)


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words, each followed by one space, and the offset of each (one more entry than words)."""
    sizes = ends - starts + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    take = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    out = buf[np.minimum(take, max(0, len(buf) - 1))] if len(buf) else np.zeros(0, np.uint8)
    out[offsets[1:] - 1] = 32
    return out.tobytes(), offsets


def _check(text: bytes, offsets: np.ndarray, a: int, b: int) -> bytes:
    return hashlib.blake2b(text[offsets[a] : offsets[b] - 1], digest_size=16).digest()


def _fingerprint(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The paths as spans with a digest of the span's words, packed by source: (key, asks), bounded by a slice of text."""
    for batch in batches:
        ids, paths = batch.column("key").to_numpy(), batch.column("paths")
        for lo, hi, buf, offs in text_slices(batch.column("text")):
            starts, ends, first = word_spans(buf, offs)
            text, offsets = _joined(buf, starts, ends)
            sources: list[int] = []
            rows: list[tuple] = []
            for r in range(hi - lo):
                have = int(first[r + 1] - first[r])
                for path in np.frombuffer(paths[lo + r].as_py(), _PATH):
                    pos, size = int(path["pos"]), int(path["edges"]) + n - 1
                    if pos + size <= have:
                        sources.append(int(path["src"]))
                        rows.append((int(path["at"]), int(ids[lo + r]), pos, size, _check(text, offsets, first[r] + pos, first[r] + pos + size)))
            owner, cuts, (packed,) = by_id(np.array(sources, np.int64), np.array(rows, _ASK))
            yield from pa.table({"key": pa.array(owner, pa.int64()), "asks": ragged_binary(packed, cuts)}).to_batches()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, spans, failed): the spans whose words stand at the source coordinate, by their own row, and how many do not."""
    for batch in batches:
        asks = batch.column("asks")
        for lo, hi, buf, offs in text_slices(batch.column("text")):
            starts, ends, first = word_spans(buf, offs)
            text, offsets = _joined(buf, starts, ends)
            ids: list[int] = []
            good: list[tuple] = []
            failed: list[int] = []
            for r in range(hi - lo):
                have = int(first[r + 1] - first[r])
                for s in np.frombuffer(asks[lo + r].as_py(), _ASK):
                    at, size, check = int(s["at"]), int(s["len"]), s["check"].tobytes()
                    a = int(first[r]) + at
                    if at + size <= have and _check(text, offsets, a, a + size) == check:
                        ids.append(int(s["id"]))
                        good.append((int(s["pos"]), size, check))
                    else:
                        failed.append(int(s["id"]))
            owner, cuts, (packed,) = by_id(np.array(ids, np.int64), np.array(good, _SPAN))
            proven = pa.table({"key": pa.array(owner, pa.int64()), "spans": ragged_binary(packed, cuts), "failed": pa.array([0] * len(owner), pa.int64())})
            lost = pa.table({"key": pa.array(failed, pa.int64()), "spans": pa.array([b""] * len(failed), pa.binary()), "failed": pa.array([1] * len(failed), pa.int64())})
            yield from pa.concat_tables([proven, lost]).to_batches()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans") if "spans" in batch.schema.names else None
        for lo, hi, buf, offs in text_slices(batch.column("text")):
            starts, ends, first = word_spans(buf, offs)
            gone = np.zeros(len(starts), bool)
            for r in range(hi - lo):
                known = spans[lo + r].as_py() if spans is not None else None
                if known:
                    a, b = int(first[r]), int(first[r + 1])
                    text, offsets = _joined(buf, starts[a:b], ends[a:b])
                    for s in np.concatenate([np.frombuffer(x, _SPAN) for x in known]):
                        pos, end = int(s["pos"]), int(s["pos"] + s["len"])
                        if end <= b - a and _check(text, offsets, pos, end) == s["check"].tobytes():
                            gone[a + pos : a + end] = True
            kept = ~gone
            text, offsets = _joined(buf, starts[kept], ends[kept])
            edge = np.concatenate([[0], np.cumsum(kept)])[first]
            texts = [text[offsets[a] : max(offsets[a], offsets[b] - 1)].decode() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            n_words = np.diff(first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_words - np.diff(edge), pa.int64()), pa.array(texts, pa.string())],
                names=["id", "n_words", "n_removed", "kept_text"],
            )


def _proven_spans(texts: DataFrame, buckets: int, n: int, k: int, base: int) -> DataFrame:
    """(key, spans, failed): the verified repeated spans of each row of (key, id, text), and how many failed."""
    asks = texts.mapInArrow(lambda it: _send_minimizers(it, buckets, n, k), "route int, kind int, c0 binary, c1 binary")
    dealt = "part long, ids binary, body binary"
    marks = asks.groupBy("route").applyInArrow(lambda t: _answer_minimizers(t, buckets), dealt).groupBy("part").applyInArrow(_gather_marks, "key long, marks binary")
    edges = texts.hint("merge").join(marks, "key").sortWithinPartitions("key")
    asks = edges.mapInArrow(lambda it: _send_windows(it, buckets, n, k, base), "route int, kind int, c0 binary, c1 binary, c2 binary, c3 binary")
    paths = asks.groupBy("route").applyInArrow(lambda t: _answer_windows(t, buckets), dealt).groupBy("part").applyInArrow(_gather_paths, "key long, paths binary")
    # What rows ask of a source is packed where they are, so a source that very many share gets few, bounded rows.
    spans = texts.hint("merge").join(paths, "key").mapInArrow(lambda it: _fingerprint(it, n), "key long, asks binary")
    return texts.hint("merge").join(spans, "key").mapInArrow(_verify, "key long, spans binary, failed long")


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW, k: int = KMER) -> DataFrame:
    """Returns (id, n_words, n_removed, kept_text) for every row.

    A word goes if it lies in a window of n words that also starts in a row with a smaller id; kept words are joined
    by one space. Traffic is packed: a block of text sends each distinct window once, so a passage that a third of all
    rows share costs one entry a block, and buckets by hash hold equal shares whatever repeats; what a block knows to
    repeat without asking is cut into bounded pieces that are spread over all buckets. Every span is compared with its
    source before it goes; should any differ (two windows of one hash), all is done again with another hash and what
    both prove is joined. If spans differ under every hash, an error is raised and nothing is returned. Ids may be of any
    type that has an order.

    Defined cases: a null or blank text has no words; texts of fewer than n words lose none; rows with null id keep
    all words, are no source and join nothing; rows that share an id are one document, and none is a source for
    another; of several sources the smallest id and its first place count; a text of any length is taken whole, in
    memory proportional to it; a span goes only from a row whose own words match it; an empty table gives an empty
    result; further columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "spans")
    ids = NodeIds(docs, id_col, ws)
    given = ids.numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    # All joins deal the same columns of the same rows by the same key, so the texts are shuffled once for each hash.
    texts = given.where("id IS NOT NULL").withColumn("key", F.col("id"))
    proven = None
    for turn, base in enumerate(WINDOW_BASES):
        found = ws.table(f"proven-{turn}", _proven_spans(texts, buckets, n, k, base))
        proven = found if proven is None else proven.unionByName(found)
        if not found.where("failed > 0").head(1):
            break
    else:
        raise RuntimeError(f"under none of {len(WINDOW_BASES)} hashes do all spans equal their sources; words of equal hash are in the texts")
    # A row's spans are no more than its windows.
    proven = proven.where("failed = 0").groupBy("key").agg(F.collect_list("spans").alias("spans"))
    schema = "id long, n_words long, n_removed long, kept_text string"
    out = texts.hint("merge").join(proven, "key", "left").mapInArrow(_remove, schema)
    out = out.unionByName(given.where("id IS NULL").mapInArrow(_remove, schema))
    return ids.given(out, "id").withColumnRenamed("id", id_col)
