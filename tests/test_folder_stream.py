import time

import pytest

from docloom.streaming import folder as W


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, W.ROCKSDB)
    yield
    spark.conf.set(key, before)


def _until(done, seconds=60):
    end = time.time() + seconds
    while time.time() < end and not done():
        time.sleep(0.2)
    assert done()


def test_polls_restart_from_their_offsets_and_hash_what_is_there(spark, tmp_path):
    src, ckpt, seen = tmp_path / "in", str(tmp_path / "ckpt"), []
    src.mkdir()
    (src / "a.md").write_text("one")
    (src / "skip.txt").write_text("no")

    def start():
        stream = W.observations(spark, str(src), "*.md", 0.1)
        return stream.writeStream.option("checkpointLocation", ckpt).foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).start()

    q = start()
    _until(lambda: any(r[0] == "a.md" for r in seen))
    q.stop()
    first = max(r[1] for r in seen)
    (src / "a.md").write_text("longer than before")
    (src / "b.md").write_text("new")
    q = start()
    _until(lambda: {"a.md", "b.md"} <= {r[0] for r in seen if r[1] > first})
    q.stop()
    assert {r[0] for r in seen} == {"a.md", "b.md"}
    assert len({r[3] for r in seen if r[0] == "a.md"}) == 2
    polls = [r[1] for r in seen if r[0] == "a.md"]
    assert polls == sorted(polls) and len(set(polls)) == len(polls)  # no poll comes twice


def test_a_growing_file_rests_once_and_a_new_one_of_its_name_again(spark, tmp_path, rocksdb):
    src, ckpt, out = tmp_path / "in", str(tmp_path / "ckpt"), []
    src.mkdir()

    def start():
        stream = W.at_rest(W.observations(spark, str(src), "*", 0.1), 4000)
        return stream.writeStream.outputMode("append").option("checkpointLocation", ckpt).foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).start()

    (src / "a").write_text("1")
    q = start()
    time.sleep(2)
    (src / "a").write_text("12")
    _until(lambda: out)
    assert [(r[0], r[2]) for r in out] == [("a", 2)]  # not the content that grew
    q.stop()
    (src / "a").unlink()
    q = start()
    (src / "a").write_text("something else")
    _until(lambda: len(out) > 1)
    time.sleep(3)
    q.stop()
    assert [(r[0], r[2]) for r in out] == [("a", 2), ("a", 14)]
