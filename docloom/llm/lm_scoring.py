"""Language-model scoring by stupid backoff over n-gram count tables partitioned by hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.packing import pack_ints, unpack_ints
from docloom.llm.textblocks import rows_of, span_hashes, text_slices, window_hashes, word_spans

ORDER, BACKOFF, LEAST = 3, 0.4, 2
PART_BYTES = 8 << 20
_ALL = np.zeros(1, np.uint64)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys: the first whole, then differences in as few bytes as the largest needs.

    The differences' highest bytes are alike, so these are kept together and compressed.
    """
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    planes = np.ascontiguousarray(gaps).view(np.uint8).reshape(-1, 8)
    high = pa.compress(planes[:, width - 1].tobytes(), "zstd", asbytes=True)
    head = np.array([keys[0], width, len(gaps), len(high)], np.uint64).tobytes()
    return head + high + np.ascontiguousarray(planes[:, : width - 1]).tobytes()


def _unpack_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    first, width, count, high = np.frombuffer(data, np.uint64, 4)
    width, count, high = int(width), int(count), int(high)
    gaps = np.zeros((count, 8), np.uint8)
    gaps[:, width - 1] = np.frombuffer(pa.decompress(data[32 : 32 + high], decompressed_size=count, codec="zstd", asbytes=True), np.uint8)
    gaps[:, : width - 1] = np.frombuffer(data, np.uint8, offset=32 + high).reshape(count, width - 1)
    return first + np.concatenate([np.zeros(1, np.uint64), np.cumsum(gaps.view(np.uint64).ravel(), dtype=np.uint64)])


def _pack_counts(values: np.ndarray) -> bytes:
    raw = pack_ints(values)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpack_counts(data: bytes) -> np.ndarray:
    size = int(np.frombuffer(data, np.int64, 1)[0])
    return unpack_ints(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True))


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part in one batch as one row: ids, text sizes and the compressed texts."""
    for batch in batches:
        part = batch.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        cut = np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1, [len(part)]]) if len(part) else np.zeros(1, int)
        rows = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            take = pa.array(order[a:b])
            texts = pc.fill_null(batch.column("text").take(take), "").cast(pa.large_binary())
            body = b"".join(texts.to_pylist())
            sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
            rows.append((part[order[a]], batch.column("id").take(take), pack_ints(sizes), len(body), pa.compress(body, "zstd", asbytes=True)))
        parts, ids, sizes, raw, bodies = zip(*rows, strict=True) if rows else ([],) * 5
        held = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.concat_arrays(ids)) if rows else pa.array([], pa.list_(batch.schema.field("id").type))
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), held, pa.array(sizes, pa.binary()), pa.array(raw, pa.int64()), pa.array(bodies, pa.binary())], names=["part", "ids", "sizes", "raw", "body"])


def _texts(table: pa.Table) -> pa.ChunkedArray:
    """The texts of a part's packed rows, in the order of their ids."""
    chunks = []
    for sizes, raw, body in zip(*(table.column(c).to_pylist() for c in ("sizes", "raw", "body")), strict=True):
        offsets = np.concatenate([[0], np.cumsum(unpack_ints(sizes))]).astype(np.int64)
        data = pa.decompress(body, decompressed_size=raw, codec="zstd")
        chunks.append(pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), data))
    return pa.chunked_array(chunks, pa.large_string())


def _grams(texts: pa.ChunkedArray, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams that begin at each word for n = 1..order (0 where they cross rows), words' rows, counts."""
    grams: list[list[np.ndarray]] = [[] for _ in range(order)]
    rows, sizes, base = [], [], 0
    for _, _, buf, offs in text_slices(texts):
        starts, ends, first = word_spans(buf, offs)
        words = span_hashes(buf, starts, ends, lower=True)
        row = rows_of(first)
        for n in range(1, order + 1):
            out = np.zeros(len(words), np.uint64)
            if len(words) >= n:
                inside = row[n - 1 :] == row[: len(row) - n + 1]
                out[: len(inside)][inside] = np.maximum(window_hashes(words, n)[inside], np.uint64(1))
            grams[n - 1].append(out)
        rows.append(row + base)
        sizes.append(np.diff(first))
        base += len(offs) - 1
    cat = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs])
    return [cat(g, np.uint64) for g in grams], cat(rows, np.int64), cat(sizes, np.int64)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of ascending keys begins, and the end."""
    bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def _count_part(table: pa.Table, buckets: int, order: int) -> pa.Table:
    """The distinct n-grams of a part of the rows with their counts, dealt to buckets; key 0 counts all words."""
    grams, _, sizes = _grams(_texts(table), order)
    keys, counts = np.unique(np.concatenate([*grams, _ALL]), return_counts=True)
    counts[0] = sizes.sum()
    cut = _cuts(keys, buckets)
    full = [b for b in range(buckets) if cut[b + 1] > cut[b]]
    part = table.column("part")[0].as_py()
    return pa.table(
        {
            "bucket": pa.array(full, pa.int32()),
            "part": pa.array([part] * len(full), pa.int64()),
            "keys": pa.array([_pack_keys(keys[cut[b] : cut[b + 1]]) for b in full], pa.binary()),
            "counts": pa.array([_pack_counts(counts[cut[b] : cut[b + 1]]) for b in full], pa.binary()),
        }
    )


def _total_bucket(table: pa.Table) -> pa.Table:
    """A bucket's count table, joined back to what each part asked for."""
    keys = [_unpack_keys(x) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([_unpack_counts(x) for x in table.column("counts").to_pylist()])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, counts)
    cut = np.cumsum([0, *[len(k) for k in keys]])
    return pa.table(
        {
            "bucket": table.column("bucket"),
            "part": table.column("part"),
            "totals": pa.array([_pack_counts(total[place[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
        }
    )


def _score_part(rows: pa.Table, answers: pa.Table, buckets: int, order: int, backoff: float, least: int) -> pa.Table:
    grams, row, sizes = _grams(_texts(rows), order)
    keys, place = np.unique(np.concatenate([*grams, _ALL]), return_inverse=True)
    cut = _cuts(keys, buckets)
    totals = np.zeros(len(keys), np.int64)
    for b, packed in zip(answers.column("bucket").to_pylist(), answers.column("totals").to_pylist(), strict=True):
        totals[cut[b] : cut[b + 1]] = _unpack_counts(packed)
    whole = max(1, int(totals[0]))
    totals[0] = 0
    seen = totals[place[:-1]].reshape(order, len(row))
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    score = np.log(np.maximum(seen[0], 1) / whole)
    level = np.ones(len(row), np.int64)
    # From the longest context down: the longest n-gram in the table decides, each step down costs one backoff.
    longest = np.minimum(at + 1, order)
    score += np.log(backoff) * (longest - 1)
    for n in range(2, order + 1):
        end = np.flatnonzero(longest >= n)
        have = seen[n - 1][end - n + 1]
        found = have >= least
        end = end[found]
        context = seen[n - 2][end - n + 1]
        score[end] = np.log(have[found] / context) + np.log(backoff) * (longest[end] - n)
        level[end] = n
    out = {"id": pa.chunked_array([c.flatten() for c in rows.column("ids").chunks]), "n_words": pa.array(sizes)}
    for n in range(1, order + 1):
        out[f"n_order{n}"] = pa.array(np.bincount(row[level == n], minlength=len(sizes)).astype(np.int64))
    out["log_score"] = pa.array(np.bincount(row, weights=score, minlength=len(sizes)))
    return pa.table(out)


def score_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, least: int = LEAST, part_bytes: int = PART_BYTES) -> DataFrame:
    """Returns (id, n_words, n_order1.., log_score, mean_log_score) for every row, against the table's own n-grams.

    The count tables hold n-grams (A-Z lower-cased words) that occur at least ``least`` times; single words all count.
    Rows are dealt, packed and compressed, to parts of about ``part_bytes``; a part sends each distinct n-gram once with its count to the
    bucket of its hash, where counts are summed and joined back to what each part asked, so a very frequent n-gram
    costs one entry a part. The score of a word is its longest n-gram's share of its context, times ``backoff`` for
    each step down; an n-gram's key is its whole 64-bit hash; ``n_orderN`` says how many words were scored by n-grams of N words.

    Defined cases: a null or blank text has no words, score 0 and a null mean; repeated rows and null ids each give a
    row; an empty table gives an empty result; further columns are ignored.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = buckets = max(1, -(-total // part_bytes))
    kind = given.schema["id"].dataType.simpleString()
    dealt = given.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts))).mapInArrow(_pack_texts, f"part long, ids array<{kind}>, sizes binary, raw long, body binary")
    asked = dealt.groupBy("part").applyInArrow(lambda t: _count_part(t, buckets, order), "bucket int, part long, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(_total_bucket, "bucket int, part long, totals binary")
    schema = f"id {kind}, n_words long, " + ", ".join(f"n_order{n} long" for n in range(1, order + 1)) + ", log_score double"
    scored = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(lambda a, b: _score_part(a, b, buckets, order, backoff, least), schema)
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.withColumnRenamed("id", id_col).withColumn("mean_log_score", mean)
