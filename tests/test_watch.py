"""Walks in rounds over skewed trees; polls, bursts that are replayed after a kill, deletions found by state."""

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pathloom.sources import walk
from pathloom.sources.snapshot import SnapshotStore
from pathloom.sources.walk import walked
from pathloom.streaming.index_stream import IndexStream
from pathloom.streaming.watch import Poller, PollLog, watched
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent


def written(root, names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(str(name))


def on_disk(root):
    out = {}
    for folder, folders, files in os.walk(root):
        out.update({f"{folder}/{d}/": 0 for d in folders} | {f"{folder}/{f}": os.lstat(f"{folder}/{f}").st_size for f in files})
    return out


def test_a_skewed_tree_is_everyones_work(spark, tmp_path, monkeypatch):
    """All entries lie under one folder at the end of a chain; later rounds deal them over all tasks."""
    deep = Path("a/b/c/d/e/f")
    written(tmp_path, [deep / f"branch{k}/leaf{j}/file{i}" for k in range(12) for j in range(5) for i in range(6)] + ["lonely.txt"])
    rounds, stored = [], walk.stored
    monkeypatch.setattr(walk, "stored", lambda rows, name: rounds.append(stored(rows, name)) or rounds[-1])
    found = walked(spark, [str(tmp_path)], share=20)
    assert {r.path: r.size for r in found.collect()} == on_disk(tmp_path) and found.count() == len(on_disk(tmp_path))
    assert len(rounds) >= 2
    tasks = Counter(r.file for r in spark.read.parquet(rounds[1]).where("state = 'found'").select(F.col("_metadata.file_name").alias("file")).collect())
    assert len(tasks) >= 3 and max(tasks.values()) <= 0.6 * sum(tasks.values())
    assert [r.path for r in walked(spark, [str(tmp_path)], ["branch*"], share=1).where("path like '%branch%'").collect()] == []


def test_names_that_are_not_utf8(spark, tmp_path):
    odd = os.fsencode(str(tmp_path)) + b"/od\xffd"
    try:
        os.mkdir(odd)
    except OSError:
        pytest.skip("this file system refuses such names")
    for k in range(3):
        os.mkdir(odd + b"/in%d" % k)
        open(odd + b"/in%d/f\xfe" % k, "wb").close()
    shown = sorted(r.path.removeprefix(f"{tmp_path}/") for r in walked(spark, [str(tmp_path)], share=1).collect())
    assert shown == sorted(["od�d/", *(f"od�d/in{k}/" for k in range(3)), *(f"od�d/in{k}/f�" for k in range(3))])


def drained(log, checkpoint, out):
    """Runs the stream over what the log has and returns all its rows so far."""
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/{number}")
    query = watched(log).writeStream.foreachBatch(keep).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [tuple(r) for r in log.spark.read.parquet(f"{out}/*").orderBy("poll", "path").collect()]


def test_changes_and_deletions_come_from_state(spark, tmp_path):
    log = PollLog(spark, f"file://{tmp_path}/log", buckets=4)
    listing = lambda rows: spark.createDataFrame(rows, "path string, mtime long, size long")
    log.publish(listing([("/a", 1, 1), ("/b", 1, 1), ("/d/", 1, 0), ("/d/x", 1, 1)]))
    first = drained(log, tmp_path / "ck", tmp_path / "out")
    assert first == [(1, p, 1, s, "changed") for p, s in (("/a", 1), ("/b", 1), ("/d/", 0), ("/d/x", 1))]
    log.publish(listing([("/a", 1, 1), ("/b", 2, 1), ("/new", 3, 3)]))
    log.publish(listing([("/b", 2, 1), ("/new", 3, 9)]))  # two polls in one burst
    log.publish(listing([]))
    after = drained(log, tmp_path / "ck", tmp_path / "out")[len(first) :]
    assert after == [(2, "/b", 2, 1, "changed"), (2, "/d/", 0, 0, "gone"), (2, "/d/x", 0, 0, "gone"), (2, "/new", 3, 3, "changed"), (3, "/a", 0, 0, "gone"), (3, "/new", 3, 9, "changed"), (4, "/b", 0, 0, "gone"), (4, "/new", 0, 0, "gone")]
    assert PollLog(spark, f"file://{tmp_path}/log").buckets == 4
    log.prune(1)
    assert log.polls() == [4] and log.publish(listing([("/b", 1, 1)])) == 5


KILLED = """
import os, sys
from pyspark.sql import SparkSession
from pathloom.streaming.watch import PollLog, watched
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "1g").getOrCreate()
base = sys.argv[1]
log = PollLog(spark, f"file://{base}/log", buckets=4)
def dies(batch, number):
    with open(f"{base}/seen", "w") as f:
        f.write("\\n".join(sorted(f"{r.poll}|{r.path}|{r.state}" for r in batch.collect())))
    os._exit(9)
watched(log).writeStream.foreachBatch(dies).option("checkpointLocation", f"{base}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
"""


def test_a_killed_query_sees_the_same_burst_again(spark, tmp_path):
    root = tmp_path / "root"
    written(root, ["kept", "old", "dir/inner"])
    log = PollLog(spark, f"file://{tmp_path}/log", buckets=4)
    log.poll([str(root)])
    drained(log, tmp_path / "ck", tmp_path / "out")
    (root / "old").unlink()
    written(root, ["new"])
    log.poll([str(root)])
    died = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path)], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, timeout=180)
    assert died.returncode == 9, died.stderr[-2000:]
    (root / "new").unlink()  # what is there now differs from what the burst saw
    written(root, ["later"])
    log.poll([str(root)])
    rows = [r for r in drained(log, tmp_path / "ck", tmp_path / "out") if r[0] > 1]
    burst = sorted(f"{poll}|{path}|{state}" for poll, path, _, _, state in rows if poll == 2)
    assert burst == (tmp_path / "seen").read_text().split("\n") and any(b.endswith("old|gone") for b in burst)
    assert {(path.rsplit("/", 1)[1], state) for poll, path, *_, state in rows if poll == 3} >= {("new", "gone"), ("later", "changed")}


def test_many_paths_cost_the_driver_nothing(spark, tmp_path):
    """Polls of 200 000 paths: only the few rows that differ come out of the state."""
    log = PollLog(spark, f"file://{tmp_path}/log", buckets=16)
    paths = spark.range(200_000).select(F.format_string("/data/%d/file-%d", F.col("id") % 500, "id").alias("path"), F.lit(7).cast("long").alias("mtime"), F.col("id").alias("size"), "id")
    log.publish(paths.drop("id"))
    assert len(drained(log, tmp_path / "ck", tmp_path / "out")) == 200_000
    log.publish(paths.where("id not in (5, 77)").withColumn("mtime", F.when(F.col("id") == 123, 8).otherwise(F.col("mtime"))).drop("id"))
    rows = [r for r in drained(log, tmp_path / "ck", tmp_path / "out") if r[0] == 2]
    assert sorted((p.rsplit("-", 1)[1], s) for _, p, _, _, s in rows) == [("123", "changed"), ("5", "gone"), ("77", "gone")]


def test_a_watched_tree_reaches_the_snapshot(spark, tmp_path):
    root = tmp_path / "root"
    written(root, ["one", "sub/two", "sub/three"])
    store, log = SnapshotStore(spark, f"file://{tmp_path}/store"), PollLog(spark, f"file://{tmp_path}/log", buckets=4)
    names = lambda: sorted(r.path.removeprefix(f"{root}/") for r in store.load().collect())

    def caught_up():
        IndexStream(store).start(watched(log), str(tmp_path / "ck"), available_now=True).awaitTermination(120)

    poller = Poller(log, [str(root)], every=3600).start()
    poller.stop()
    assert poller.failed is None and log.polls() == [1]
    caught_up()
    assert names() == ["one", "sub/", "sub/three", "sub/two"]
    (root / "sub/two").unlink()
    written(root, ["four"])
    log.poll([str(root)])
    caught_up()
    assert names() == ["four", "one", "sub/", "sub/three"]
