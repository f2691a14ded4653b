import math
import random
from collections import defaultdict

import numpy as np
import pytest

from docloom.llm import vector_codes as codes
from docloom.llm.vector_codes import GridCells, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, id int, v int, code string"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = []
    for name, vector, label, *_ in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((name, [math.floor(4096 * float(np.float32(x))) for x in vector], label))
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            taken = defaultdict(list)
            for _, v, _ in kept:
                taken[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*taken[e], strict=True)] if taken[e] else books[p][e] for e in range(len(books[p]))]
    out, by_label = [], defaultdict(int)
    for name, v, label in kept:
        best = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((name, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
        by_label[label] += out[-1][2]
    return sorted((n, c, e, by_label[x]) for n, c, e, x in out), books


def vectors(seed, n, dim=24):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(dim)] for _ in range(9)]
    rows = [(i * 3 - 40, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], rng.choice([None, 1, 1, 2]), 1, 1, "c") for i in range(n)]
    rows += rows[:4] + [(900 + k, v, 1, 1, 1, "c") for k, v in enumerate([None, [None] * dim, [0.1] * (dim - 1) + [float("nan")], [float("-inf")] * dim, [0.0] * dim, [3.5] * dim])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n"), [(1, 200), (2, 9), (3, 60)])
def test_codes_equal_brute_force(spark, seed, n):
    rows = vectors(seed, n)
    got, books = vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(4))
    plain, plain_books = plain_codes(rows)
    assert sorted(map(tuple, got.collect())) == plain and books == plain_books


def test_grid_cells_find_the_nearest_entry_with_ties_and_equal_hashes(monkeypatch):
    rng = np.random.default_rng(5)
    for size, most in ((1, 1 << 16), (3, 64), (8, 1 << 16)):
        book = rng.integers(-40, 40, (16, size))
        book[9] = book[2]
        x = rng.integers(-60, 60, (20_000, size))
        away = ((x[:, None, :] - book) ** 2).sum(axis=2)
        for collide in (False, True):
            grid = GridCells(book, most)
            if collide:
                monkeypatch.setattr(grid, "_hash", lambda cells: (cells.sum(axis=1) % 3).astype(np.uint64))
            entry, least = grid.nearest(x)
            assert (entry == away.argmin(axis=1)).all() and (least == away.min(axis=1)).all()
    grid = GridCells(rng.integers(-3000, 3000, (16, 2)))
    grid.nearest(rng.integers(-3000, 3000, (50_000, 2)))
    assert grid.compared < 4 * 50_000 and len(grid.hashes) < 2_000


def test_what_cannot_be_coded_is_refused_or_empty(spark):
    frame = lambda vs: spark.createDataFrame([(i, v, 1, 1, 1, "c") for i, v in enumerate(vs)], SCHEMA)
    for empty in ([], [None, [float("nan")] * 8]):
        got, books = vector_codes(frame(empty))
        assert got.collect() == [] and books == [[]] * 8
    for bad in ([[0.1] * 8, [0.1] * 16], [[0.1] * 9], [[]]):
        with pytest.raises(ValueError):
            vector_codes(frame(bad))
    with pytest.raises(Exception, match="do not fit"):
        vector_codes(frame([[1e30] * 8]))


def test_sums_of_large_components_are_exact():
    rows = np.full((1000, 1), 2**27 - 1, np.int64)
    batch = next(codes._integers(iter([]), 1), None)
    assert batch is None
    grid = GridCells(np.array([[0], [2**27 - 1]]))
    assert grid.nearest(rows)[1].sum() == 0
