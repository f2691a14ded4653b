import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docloom.llm import queries
from docloom.llm.sequence_packing import LevelArray, WindowPacker, pack_sequences
from docloom.llm.token_ids import text_encoder
from tests.llm import brute

BPE = public_tokenizers.path("byte_bpe_50k.json")
PADDED = public_tokenizers.path("word_bpe_49k.json")


def assert_packed(rows, documents, size=1024):
    """Every id lies in one piece, offsets have no gaps, and no sequence needs padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for name, copies in documents.items():
        got = sorted(pieces.pop(name), key=lambda r: r.start)
        assert {r.doc_tokens for r in got} == {len(ids) for ids in copies}
        covered = [0] * len(copies[0])
        for r in got:
            part = np.frombuffer(bytes(r.ids), "<u4").tolist()
            assert part == copies[0][r.start : r.start + r.length]
            for k in range(r.start, r.start + r.length):
                covered[k] += 1
        assert set(covered) == {len(copies)}
    assert not pieces
    for held in sequences.values():
        fill = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == fill and r.length > 0
            fill += r.length
        assert fill <= size and not fill & (fill - 1)


def plain_levels(items, size):
    """The rule, level by level, with the whole sum of squares each time."""
    count, out = [0] * (size + 1), []
    for item in items:
        best = None
        for level in range(size - item + 1):
            if level and not count[level]:
                continue
            after = count[:]
            after[level] -= level > 0
            after[level + item] += level + item < size
            cost = sum(n * n for n in after)
            if best is None or cost <= best[0]:
                best = (cost, level, after)
        count = best[2]
        out.append(best[1])
    return out


def test_levels_are_those_of_the_plain_rule():
    rng = random.Random(3)
    for size, spread in ((16, 16), (32, 9), (64, 64)):
        items = [rng.randint(1, spread) for _ in range(400)]
        levels, got = LevelArray(size), []
        for item in items:
            got.append(level := levels.place(item))
            levels.change(level, -1)
            levels.change(level + item, 1)
        assert got == plain_levels(items, size)


@pytest.mark.parametrize("most_open", [1, 7, 4096])
def test_every_id_lies_in_one_window_and_few_stay_open(most_open):
    rng = np.random.default_rng(most_open)
    packer, windows, documents = WindowPacker(64, most_open), [], []
    for row in range(900):
        ids = rng.integers(0, 9, rng.choice([1, 40, 41, 64, 200])).astype(np.uint32)
        documents.append(ids)
        windows += packer.add(row, ids)
        assert packer.open <= most_open
    windows += packer.settle()
    back = [[] for _ in documents]
    for window in windows:
        fill = sum(len(p[2]) for p in window)
        assert fill <= 64 and not fill & (fill - 1)
        for row, start, ids in window:
            back[row].append((start, ids.tolist()))
    assert [[x for _, part in sorted(b) for x in part] for b in back] == [d.tolist() for d in documents]


def test_few_documents_are_cut_when_sizes_fit():
    rng = np.random.default_rng(1)
    packer, windows = WindowPacker(), []
    for row in range(20_000):
        windows += packer.add(row, np.zeros(int(rng.integers(1, 700)), np.uint32))
    windows += packer.settle()
    assert sum(map(len, windows)) < 20_000 * 1.03


def test_ids_are_the_librarys():
    rng = random.Random(11)
    library = Tokenizer.from_file(BPE)
    encode = text_encoder(BPE)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "7", "中", "🙂", "<|endoftext|>", "<|end", "...", " ", " ", "\x00", "don't"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [" " * 1_200_000 + "a", "x" * 200_000]
    for t in texts:
        assert encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
    other = Tokenizer.from_file(PADDED)
    assert text_encoder(PADDED)("Some words, <|endoftext|>").tolist() == other.encode("Some words, <|endoftext|>", add_special_tokens=False).ids


@pytest.mark.parametrize("tasks", [1, 5])
def test_awkward_documents_are_packed(spark, tasks):
    rows = brute.awkward_documents()
    library = Tokenizer.from_file(BPE)
    documents = defaultdict(list)
    for r in rows:
        documents[r[0]].append([*library.encode(r[1] or "", add_special_tokens=False).ids, 0])
    docs = spark.createDataFrame(rows, brute.SCHEMA).repartition(tasks)
    assert_packed(pack_sequences(docs, BPE).collect(), documents)
    assert_packed(pack_sequences(docs, BPE, size=16, most_open=3).collect(), documents, 16)
    assert pack_sequences(docs.limit(0), BPE).collect() == []
    with pytest.raises(ValueError):
        pack_sequences(docs, BPE, size=1000)


def test_the_query_packs_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    library = Tokenizer.from_file(BPE)
    documents = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen, fill = defaultdict(int), defaultdict(int)
    for r in queries.op11_pack_sequences(spark, sf).collect():
        part = documents[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(documents[r.doc_id])
        seen[r.doc_id] += r.length
        fill[r.sequence_id] = max(fill[r.sequence_id], r.offset + r.length)
    assert seen == {k: len(v) for k, v in documents.items()}
    assert all(not n & (n - 1) for n in fill.values())
