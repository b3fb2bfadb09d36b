"""The semantic store and its migration, the history that compacts itself, the text cache in use, versions claimed once."""

import json
import os
import threading
import time

import numpy as np
import pytest
from pathloom.cli import index_semantic
from pathloom.operators import semantic
from pathloom.sources import documents, lines, snapshot
from pathloom.sources.documents import TextCache, read_texts
from pathloom.sources.lines import HistoryLog, read_lines, utf8_lines
from pathloom.sources.semantic_store import SemanticStore, packed, unpacked
from pathloom.sources.snapshot import SnapshotStore
from pyspark.sql import functions as F

CHUNK = "path string, mtime long, size long, chunk_ix int, line_start int, vec array<float>"
ROWS = [("/a.md", 1, 9, 0, 1, [0.1, -0.25, 3.0]), ("/a.md", 1, 9, 1, 7, [1.0, 2.0, 65504.0]), ("/b.md", 2, 9, 0, 1, [1e-7, 0.0, -1.0])]


def halves(rows):
    return sorted((p, k, [float(np.float16(x)) for x in v]) for p, _, _, k, _, v in rows)


def stored(df):
    return sorted((r.path, r.chunk_ix, list(r.vec)) for r in df.collect())


def test_vectors_are_kept_as_halves(spark, tmp_path):
    store = SemanticStore(spark, f"file://{tmp_path}/s")
    assert store.load() is None and not store.needs_migration()
    facts = store.publish(spark.createDataFrame(ROWS, CHUNK))
    assert (facts["docs"], facts["chunks"], facts["dim"], facts["version"]) == (2, 3, 3, 1)
    assert stored(store.load()) == halves(ROWS) and store.load(4) is None and store.load(3).count() == 3
    odd = spark.createDataFrame([("/n", 1, 1, 0, 1, None), ("/e", 1, 1, 0, 1, []), ("/x", 1, 1, 0, 1, [1e9])], CHUNK)
    assert {r.path: r.vec for r in unpacked(packed(odd)).collect()} == {"/n": [], "/e": [], "/x": [float("inf")]}
    assert store.publish(spark.createDataFrame([], CHUNK))["dim"] == 3 and store.load().count() == 0


@pytest.mark.parametrize(
    ("row", "rule"),
    [
        (("/a.md", 1, 9, 2, 1, [1.0]), "dimension"), (("/a.md", 1, 9, 2, 1, None), "dimension"), (("/a.md", 1, 9, 1, 1, [1.0, 2.0, 3.0]), "twice"), (("/a.md", 1, 9, 2, 0, [1.0, 2.0, 3.0]), "line numbers"),
        (("/c.md", 1, 9, 1, 1, [1.0, 2.0, 3.0]), "first chunk"), (("/a.md", 5, 9, 2, 1, [1.0, 2.0, 3.0]), "two states"), ((None, 1, 9, 0, 1, [1.0, 2.0, 3.0]), "path"),
    ],
)
def test_unsound_chunks_are_not_published(spark, tmp_path, row, rule):
    store = SemanticStore(spark, f"file://{tmp_path}/s")
    store.publish(spark.createDataFrame(ROWS, CHUNK))
    before = sorted(os.listdir(tmp_path / "s"))
    with pytest.raises(ValueError, match=rule):
        store.publish(spark.createDataFrame([*ROWS, row], CHUNK), dim=3)
    assert stored(store.load()) == halves(ROWS) and sorted(os.listdir(tmp_path / "s")) == before


def test_damaged_and_foreign_stores_load_as_none(spark, tmp_path):
    store = SemanticStore(spark, f"file://{tmp_path}/s")
    store.publish(spark.createDataFrame(ROWS, CHUNK))
    file = tmp_path / "s/CURRENT"
    sound = json.loads(file.read_text())

    def put(**facts):
        (tmp_path / "s/.CURRENT.crc").unlink(missing_ok=True)
        file.write_text(json.dumps(sound | facts))

    for facts in ({"store_version": 3}, {"store_version": "x"}, {"dim": 2}, {"chunks": 4}, {"folder": "v9-none"}):
        put(**facts)
        assert store.load() is None, facts
    put()
    assert store.load().count() == 3
    for part in (tmp_path / "s" / sound["folder"]).glob("part-*"):
        part.write_bytes(b"PAR1 not any more")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert store.load() is None


def test_an_old_store_is_rewritten_without_embedding(spark, tmp_path, monkeypatch):
    old = SnapshotStore(spark, f"file://{tmp_path}/s")
    old.publish(spark.createDataFrame(ROWS, CHUNK), ordered=False)  # version 1: arrays, no declared dimension
    store = SemanticStore(spark, f"file://{tmp_path}/s")
    assert store.needs_migration() and stored(store.load())[0][2] == [float(np.float32(x)) for x in ROWS[0][5]]
    monkeypatch.setattr(semantic, "embedded", lambda *a: pytest.fail("embedded"))
    assert "migrated: 2 documents, 3 chunks" in index_semantic(spark, None, store)
    assert not store.needs_migration() and stored(store.load()) == halves(ROWS) and store.facts()["dim"] == 3


def test_a_build_embeds_each_chunk_once(spark, tmp_path, monkeypatch):
    for k in range(4):
        (tmp_path / f"{k}.md").write_text(f"text of number {k}\n" * 30)
    files = SnapshotStore(spark, f"file://{tmp_path}/files")
    row = lambda k: (str(tmp_path / f"{k}.md"), 5, 10)
    files.publish(spark.createDataFrame([row(k) for k in range(3)], "path string, mtime long, size long"))
    store = SemanticStore(spark, f"file://{tmp_path}/chunks")
    calls = spark.sparkContext.accumulator(0)
    embedded = semantic.embedded

    def counting(chunks, embedder=None):
        @F.udf("string")
        def seen(text):
            calls.add(1)
            return text

        return embedded(chunks.withColumn("text", seen.asNondeterministic()("text")), embedder)

    monkeypatch.setattr(semantic, "embedded", counting)
    assert index_semantic(spark, files, store) == "3 documents, 3 chunks: 3 embedded, 0 unchanged, 0 unreadable" and calls.value == 3
    files.publish(spark.createDataFrame([row(k) for k in range(4)], "path string, mtime long, size long"))
    assert index_semantic(spark, files, store) == "4 documents, 4 chunks: 1 embedded, 3 unchanged, 0 unreadable" and calls.value == 4


def test_one_writer_claims_a_version(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    rows = lambda name: spark.createDataFrame([(name, 1, 1)], "path string, mtime long, size long")
    store.publish(rows("/first"))
    done, gate = {}, threading.Barrier(2)
    claim = SnapshotStore._claim
    monkeypatch.setattr(SnapshotStore, "_claim", lambda self, version: (gate.wait(60), claim(self, version))[1])

    def write(name):
        done[name] = SnapshotStore(spark, f"file://{tmp_path}/s").publish(rows(name), expected=1)

    writers = [threading.Thread(target=write, args=(n,)) for n in ("/one", "/two")]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(done.values(), key=str) == [2, None]
    assert [r.path for r in store.load().collect()] == [n for n, v in done.items() if v == 2]
    monkeypatch.setattr(SnapshotStore, "_claim", claim)
    os.makedirs(tmp_path / "s/claims", exist_ok=True)
    (tmp_path / "s/claims/3").touch()  # of a writer that died
    assert store.publish(rows("/three"), expected=2) is None
    monkeypatch.setattr(snapshot, "CLAIM_SECONDS", -1)
    assert store.publish(rows("/three"), expected=2) == 3 and store.load(2).count() == 1


def test_the_history_compacts_itself(spark, tmp_path):
    log = HistoryLog(spark, f"file://{tmp_path}/h", most=5)
    opens = lambda *rows: spark.createDataFrame(rows, "ts long, count long, path string").coalesce(1)
    assert log.load().count() == 0
    log.append(opens((5, 1, "/a"), (7, 2, "/b\tc")))
    log.append(opens((9, 1, "/a")))
    assert sorted(map(tuple, log.load().collect())) == [(5, 1, "/a"), (7, 2, "/b\tc"), (9, 1, "/a")] and log.base.load() is None
    many = spark.range(20_100).select(F.col("id").alias("ts"), F.lit(1).cast("long").alias("count"), F.format_string("/p%d", F.col("id") % 3).alias("path"))
    log.append(many)
    assert sorted(map(tuple, log.load().collect())) == [(7, 2, "/b\tc"), (9, 2, "/a"), (20_097, 6700, "/p0"), (20_098, 6700, "/p1"), (20_099, 6700, "/p2")]
    assert log._files() == [] and log.base.current()["version"] == 1


def test_opens_appended_during_a_compaction_are_not_lost(spark, tmp_path, monkeypatch):
    log, other = (HistoryLog(spark, f"file://{tmp_path}/h") for _ in range(2))
    opens = lambda *rows: spark.createDataFrame(rows, "ts long, count long, path string").coalesce(1)
    log.append(opens((1, 1, "/a"), (2, 1, "/a")))
    publish = log.base.publish

    def meanwhile(*args, **kw):
        other.append(opens((3, 1, "/a"), (4, 5, "/z")))
        return publish(*args, **kw)

    monkeypatch.setattr(log.base, "publish", meanwhile)
    assert log.compact()
    assert sorted(map(tuple, other.load().collect())) == [(2, 2, "/a"), (3, 1, "/a"), (4, 5, "/z")]
    # two at once: one of them wins, and what it merged is read once even before its files are gone
    monkeypatch.setattr(log.base, "publish", lambda *a, **kw: other.compact() and publish(*a, **kw))
    assert not log.compact() and sorted(map(tuple, log.load().collect())) == [(3, 3, "/a"), (4, 5, "/z")]
    name = other.base.current()["merged"][0]
    (tmp_path / f"h/log/{name}").write_text("9\t9\t/merged-already\n")
    assert "/merged-already" not in {r.path for r in log.load().collect()}


def test_a_second_query_extracts_nothing(spark, tmp_path):
    from test_sources import package

    body = lambda text: package(word__document=f'<w:d xmlns:w="u"><w:t>{text}</w:t></w:d>')
    for name, data in (("a.docx", body("salt")), ("b.docx", b"broken"), ("c.txt", b"plain"), ("d.docx", body("pepper"))):
        (tmp_path / name).write_bytes(data)
    rows = lambda *names, mtime=1: spark.createDataFrame([(str(tmp_path / n), mtime, 5) for n in names], "path string, mtime long, size long")
    cache = TextCache(spark, f"file://{tmp_path}/cache")
    read = lambda df: {os.path.basename(r.path): (r.text, r.error is not None) for r in read_texts(spark, df, cache).collect()}
    want = {"a.docx": ("salt", False), "b.docx": (None, True), "c.txt": ("plain", False)}
    assert read(rows("a.docx", "b.docx", "c.txt")) == want and cache.store.load().count() == 2
    for name in ("a.docx", "b.docx"):  # what was extracted, errors too, is not even opened again
        (tmp_path / name).unlink()
    version = cache.store.current()["version"]
    assert read(rows("a.docx", "b.docx", "c.txt")) == want and cache.store.current()["version"] == version
    assert read(rows("d.docx", "b.docx")) == {"d.docx": ("pepper", False), "b.docx": (None, True)}
    (tmp_path / "d.docx").write_bytes(body("chives"))
    assert read(rows("d.docx")) == {"d.docx": ("pepper", False)} and read(rows("d.docx", mtime=2)) == {"d.docx": ("chives", False)}
    assert cache.store.load().count() == 4 and read(rows("missing.docx", "c.txt")) == {"c.txt": ("plain", False)}
    small = TextCache(spark, f"file://{tmp_path}/small", most=1)
    (tmp_path / "b.docx").write_bytes(b"broken")
    read_texts(spark, rows("b.docx"), small), time.sleep(0.01), read_texts(spark, rows("d.docx"), small)
    assert [os.path.basename(r.path) for r in small.store.load().collect()] == ["d.docx"]


def test_lines_of_streams_and_files(spark, tmp_path, monkeypatch):
    import io

    assert utf8_lines(io.BytesIO("eins\nzwölf\n".encode() + b"bad \xff\nnever seen\n")) == ["eins\n", "zwölf\n"]
    monkeypatch.setattr(lines, "LINE_CAP", 3)
    with pytest.warns(UserWarning, match="first 3 lines"):
        assert lines.from_lines(spark, utf8_lines(io.BytesIO(b"a\n\nb\nc\nd\ne\n"))).count() == 3
    (tmp_path / "l.txt").write_text("\n".join(f"line {k}" if k % 5 else "" for k in range(1000)))
    found = read_lines(spark, str(tmp_path / "l.txt")).orderBy("ord").collect()
    assert [r.path for r in found] == [f"line {k}" for k in range(1000) if k % 5]


def test_previews_read_a_bounded_head(spark, tmp_path):
    huge = tmp_path / "huge"
    with open(huge, "wb") as f:
        f.write("zwölf\n".encode() * 9363 + b"1234567ab\xc3\xa4")  # the cut splits the last character
        f.truncate(10 << 30)  # ten gigabytes of nothing behind it
    for name, data in (("small", "größe\n".encode()), ("odd", b"a\xffb"), ("bin", b"text\0more"), ("late", b"x" * 70_000 + b"\0"), ("none", b"")):
        (tmp_path / name).write_bytes(data)
    rows = spark.createDataFrame([(str(tmp_path / n),) for n in ("huge", "small", "odd", "bin", "late", "none", "missing", ".")], "path string")
    began = time.monotonic()
    found = {os.path.basename(r.path): (r.head, r.binary, r.whole) for r in documents.read_heads(spark, rows, most=9363 * 7 + 10).collect()}
    assert time.monotonic() - began < 20
    assert found.pop("huge") == ("zwölf\n" * 9363 + "1234567ab", False, False) and found.pop("late") == ("x" * (9363 * 7 + 10), False, False)
    assert found == {"small": ("größe\n", False, True), "odd": ("a\ufffdb", False, True), "bin": (None, True, True), "none": ("", False, True)}


def test_a_walk_tells_how_far_it_is(spark, tmp_path):
    from pathloom.sources.walk import walked

    for k in range(30):
        (tmp_path / f"d{k % 6}/e{k}").mkdir(parents=True)
        (tmp_path / f"d{k % 6}/e{k}/f").touch()
    told = []
    rows = walked(spark, [str(tmp_path)], share=5, told=told.append)
    assert [t.rounds for t in told] == list(range(1, len(told) + 1)) and len(told) >= 2
    assert told[-1].entries == rows.count() == 66 and told[-1].folders_left == 0 < told[0].folders_left
    assert [t.seconds for t in told] == sorted(t.seconds for t in told)
