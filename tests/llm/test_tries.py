import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from docloom.llm import prefix_trie, queries
from docloom.llm.prefix_trie import DoubleArray, conversation_trie

SCHEMA = "conv_id long, turn int, role string, text string, key string, seq int, node string"


def plain_trie(rows, openings):
    """The contract, prefix by prefix."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, role or "", digest), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if openings else 0
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(of) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(of), len(node), parent, len(of), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n, words=3, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.choice([1, 2, 3, longest])):
            turn = rng.choice([t, t, t, None, 0])
            rows.append((c, turn, rng.choice(["user", "user", None, "é"]), rng.choice([None, "", "aé", "b" * 7, *map(str, range(words))]), "k", 1, "x"))
    rows += rows[:5] + [(None, 1, "user", "nobody", "k", 1, "x"), (10_000_000, 0, "user", "alone", "k", 1, "x")]
    return rows


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize(("seed", "shard"), [(1, 200_000), (2, 40), (3, 7)])
@pytest.mark.parametrize("openings", [False, True])
def test_nodes_equal_brute_force(spark, monkeypatch, seed, shard, openings):
    """Also with shards of few turns, so that many nodes lie in several."""
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard)
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", 50)
    rows = conversations(seed, 150, words=2 if seed == 3 else 30)
    assert got(conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), openings)) == plain_trie(rows, openings)


def test_hot_conversations_copies_and_long_texts(spark, monkeypatch):
    """One conversation with a third of all turns, and one sequence that a third of the conversations share."""
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 100)
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", 60)
    rows = [(7, t, "user", f"turn {t % 11}", "k", 1, "x") for t in range(700)]
    rows += [(c, t, "user", f"turn {t}", "k", 1, "x") for c in range(100, 400) for t in range(3)]
    rows += [(c, t, "user", ("turn 0", "y" * 300_000, f"own {c}")[t], "k", 1, "x") for c in range(500, 520) for t in range(3)]
    assert got(conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(4))) == plain_trie(rows, False)


def test_an_empty_table_and_a_lone_turnless_conversation(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(turnless, 0, "user", "gone", "k", 1, "x")]
    assert got(conversation_trie(spark.createDataFrame(rows, SCHEMA), True)) == plain_trie(rows, True) != plain_trie(rows, False)


def test_double_array_finds_its_children_and_no_others():
    rng = np.random.default_rng(4)
    trie = DoubleArray(4)
    known, level = {}, [0]
    for _ in range(6):
        parents, codes = [], []
        for p in level:
            own = rng.choice(500, rng.integers(0, 6), replace=False)
            parents += [p] * len(own)
            codes += own.tolist()
        trie.pack(np.array(parents, np.int64), np.array(codes, np.int64))
        slots = trie.step(np.array(parents, np.int64), np.array(codes, np.int64)).tolist()
        known |= dict(zip(zip(parents, codes, strict=True), slots, strict=True))
        level = slots
    assert -1 not in known.values() and len(set(known.values())) == len(known)
    nodes, codes = np.divmod(rng.integers(0, trie.end * 500, 20_000), 500)
    live = np.isin(nodes, [0, *known.values()])
    for p, c, s in zip(nodes[live].tolist(), codes[live].tolist(), trie.step(nodes[live], codes[live]).tolist(), strict=True):
        assert s == known.get((p, c), -1)


def test_the_query_over_a_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_conversation_trie(spark, sf)) == plain_trie(rows, True)
