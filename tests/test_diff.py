"""Merges of lines, against the merge of plain git."""

import random
import subprocess

import pyarrow as pa

from docloom.operators import diff as D
from docloom.operators.diff import merge_texts


def _git(folder, base, ours, theirs):
    for name, text in (("base", base), ("ours", ours), ("theirs", theirs)):
        (folder / name).write_text(text)
    done = subprocess.run(["git", "merge-file", "-p", "--diff3", "-L", "ours", "-L", "base", "-L", "theirs", "ours", "base", "theirs"], cwd=folder, capture_output=True, text=True)
    return done.stdout, done.returncode


def test_merged_lines_are_those_of_git(spark, tmp_path):
    draw = random.Random(5)

    def changed(lines):
        out = []
        for line in lines:
            what = draw.random()
            out += [] if what < 0.06 else [line, f"new {draw.randrange(999)}"] if what < 0.12 else [f"{line} x{draw.randrange(2)}"] if what < 0.2 else [line]
        return out

    base = [f"line {k}" for k in range(12)]
    rows = [(n, *("".join(f"{line}\n" for line in side) for side in (base, changed(base), changed(base)))) for n in range(60)]
    found = {r.id: (r.merged, r.conflicts) for r in merge_texts(spark.createDataFrame(rows, "id int, b string, o string, t string"), "b", "o", "t").collect()}
    assert len(found) == len(rows) and {n for _, n in found.values()} >= {0, 1, 2}
    for n, *texts in rows:
        assert found[n] == _git(tmp_path, *texts), n


def test_empty_null_and_one_sided_texts(spark):
    rows = [(1, None, None, None), (2, "a", "a", "b"), (3, "a", "b", "a"), (4, "a", None, ""), (5, "a\nb\nc", "A\nb\nc", "a\nb\nC"), (6, None, "a", "b"), (7, "a", "b", "b")]
    got = {r.id: (r.merged, r.conflicts) for r in merge_texts(spark.createDataFrame(rows, "id int, b string, o string, t string"), "b", "o", "t").collect()}
    assert got.pop(6)[1] == 1
    assert got == {1: ("", 0), 2: ("b", 0), 3: ("b", 0), 4: ("", 0), 5: ("A\nb\nC", 0), 7: ("b", 0)}


def test_merged_texts_leave_a_task_before_a_batch_is_through(spark):
    texts = [f"{k}\n" + "x" * (1 << 20) for k in range(12)]
    batch = pa.RecordBatch.from_pydict({"b": texts, "id": list(range(12)), "o": [f"o{t}" for t in texts], "t": [f"{t}\nt" for t in texts]})
    found = list(D._merged(iter([batch.slice(0, 0), batch]), (0, 2, 3)))
    assert len(found) == 3 and sum(f.num_rows for f in found) == 12
    assert [r for f in found for r in f.column("id").to_pylist()] == list(range(12))
    assert [r for f in found for r in f.column("merged").to_pylist()] == [f"o{t}\nt" for t in texts]
    rows = merge_texts(spark.createDataFrame([(1, "a\nb\nc", "A\nb\nc", "a\nb\nC")], "id int, b string, o string, t string"), "b", "o", "t")
    assert "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString()
