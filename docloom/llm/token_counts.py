"""Exact byte-level BPE token counts by rank-synchronous array merging."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_ENTRIES = 400_000

# Fixed value: the byte-level pre-tokenizer's published pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeTable:
    """The merges of a tokenizer file as sorted arrays: (left, right) -> rank and merged symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        keys = left << 32 | right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bytes = np.array([vocab[s] for s in _byte_symbols()], np.int64)
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], len(self.keys))

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each non-empty piece when every merge has been applied.

        All pieces are one ragged array. In each round every piece applies its lowest-rank pair at all its places, left
        to right without overlap; pieces without a pair leave the array.
        """
        none = len(self.keys)
        out = np.zeros(len(pieces), np.int64)
        sizes = np.array([len(p) for p in pieces], np.int64)
        symbols = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(symbols), none, np.int64)
        stale = np.arange(max(0, len(symbols) - 1))
        while len(symbols):
            inner = stale[owner[stale] == owner[stale + 1]]
            rank[stale] = none
            rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lengths = np.diff(np.append(heads, len(symbols)))
            best = np.minimum.reduceat(rank, heads)
            done = best == none
            out[owner[heads[done]]] = lengths[done]
            if done.all():
                break
            lowest = np.repeat(best, lengths)
            hit = np.flatnonzero((rank == lowest) & (lowest < none))
            # In a run of overlapping places, every second one merges.
            run = np.concatenate([[True], np.diff(hit) != 1])
            start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            live = np.repeat(~done, lengths)
            live[hit + 1] = False
            place = np.cumsum(live) - 1
            touched = place[hit]
            symbols, owner, rank = symbols[live], owner[live], rank[live]
            rank[touched] = none
            before = touched[touched > 0] - 1
            stale = np.unique(np.concatenate([before, touched]))
            stale = stale[stale < len(symbols) - 1]
            rank[-1:] = none
        return out


@lru_cache(maxsize=2)
def _table(path: str) -> MergeTable:
    return MergeTable(path)


def _count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table = _table(path)
    find = regex.compile(PRE_TOKEN).findall
    cut = regex.compile("|".join(map(regex.escape, table.special))) if table.special else None
    known: dict[str, int] = {}
    for batch in batches:
        texts = batch.column("text")
        sizes, counts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            new = list({t for _, tokens in held for t in tokens if t not in known})
            found = dict(zip(new, table.count([t.encode() for t in new]).tolist(), strict=True)) if new else {}
            known.update(found)
            for row, tokens in held:
                counts[row] += sum(map(known.__getitem__, tokens))
            held.clear()
            if len(known) > CACHE_ENTRIES:
                known.clear()

        for row in range(len(texts)):
            text = texts[row].as_py() or ""
            sizes[row] = len(text.encode())
            parts = [text]
            if cut and any(s in text for s in table.special):
                parts = cut.split(text)
                counts[row] += len(parts) - 1
            for part in parts:
                held.append((row, find(part)))
            size += sizes[row]
            if size >= 1 << 20:
                settle()
                size = 0
        settle()
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(counts)], names=["id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Returns (id, n_bytes, n_tokens, over_limit) for every row, as the tokenizer file's own library would count.

    Whole texts are split by the byte-level pattern, special strings count as one token each, and distinct pre-tokens
    are merged together once per batch; a worker keeps a bounded cache of counts. ``tokenizer_path`` must exist on
    every executor.

    Defined cases: a null text is empty and has no tokens; an empty table gives an empty result; repeated rows and
    null ids each give a row; a very long pre-token is one more ragged row; further columns are ignored.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    out = given.mapInArrow(lambda it: _count_batches(it, tokenizer_path), f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col).withColumn("over_limit", F.col("n_tokens") > limit)
