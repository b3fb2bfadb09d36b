"""Walks, documents, snapshots and the change stream on small trees."""

import io
import os
import zipfile
import zlib

import pyarrow as pa
import pytest
from pathloom import config
from pathloom.cli import main
from pathloom.operators.changes import folded
from pathloom.sources import documents
from pathloom.sources.documents import ExtractError, docx_text, pdf_text, with_cache, xlsx_text
from pathloom.sources.lines import append_query, from_lines, read_queries
from pathloom.sources.snapshot import SnapshotStore
from pathloom.sources.walk import listing, walk_stats, walked
from pathloom.streaming.index_stream import IndexStream


def tree(root, files):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", body)
    return out.getvalue()


def test_walk(spark, tmp_path):
    tree(tmp_path, {"maps/lake.svg": "x" * 9, ".cache/key": "", "app/target/out/a.o": "", "app/run.py": "py", "list.csv": "t"})
    os.symlink(tmp_path / "maps", tmp_path / "link")
    rows = walked(spark, [str(tmp_path), "/no/such/root"], ["target"])
    found = {r.path.removeprefix(f"{tmp_path}/"): r.size for r in rows.where("state = 'found'").collect()}
    assert found == {"maps/": 0, "maps/lake.svg": 9, ".cache/": 0, ".cache/key": 0, "app/": 0, "app/run.py": 2, "list.csv": 1}
    assert walk_stats(rows).first().files == 7
    assert [r.name for r in listing(rows, str(tmp_path)).collect()] == [".cache/", "app/", "maps/", "list.csv"]
    twice = [str(tmp_path), str(tmp_path / "maps")]
    assert walked(spark, twice).count() == walked(spark, twice, dedupe=True).count() + 1


def test_office_documents():
    w = 'xmlns:w="urn:w"'
    body = f"<w:document {w}><w:p><w:r><w:t>Salt &lt; pepper</w:t></w:r></w:p><w:p><w:t>Left</w:t><w:tab/><w:t>right</w:t></w:p></w:document>"
    assert docx_text(package(word__document=body, other="<x/>")) == "Salt < pepper\nLeft\tright\n"
    strings = "<sst><si><t>Rain gauge</t></si><si><r><t>Dry </t></r><r><t>season</t></r></si></sst>"
    sheet = '<w><row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>Put in place</t></is></c></row><row/><row><c t="s"><v>1</v></c><c><v>3.5</v></c></row></w>'
    assert xlsx_text(package(xl__sharedStrings=strings, xl__worksheets__sheet1=sheet)) == "Rain gauge\tPut in place\nDry season\t3.5"
    for bad in (b"no zip", package(xl__worksheets__s='<w><row><c t="s"><v>9</v></c></row></w>'), package(word__document="<open>")):
        with pytest.raises(ExtractError):
            (xlsx_text if b"worksheets" in bad else docx_text)(bad)


@pytest.mark.parametrize("packed", [False, True])
def test_pdf(packed):
    stream = b"q BT 1 0 0 1 40 60 Tm /Serif 8 Tf (river \\(Upper\\) le) Tj [(ve) -20 (ls)] TJ 0 -9 TD <41e9> Tj ET Q"
    body, extra = (zlib.compress(stream), b"/Filter /FlateDecode ") if packed else (stream, b"")
    data = b"%PDF-1.4\n1 0 obj\n<< " + extra + b"/Length %d >>\nstream\n" % len(body) + body + b"\nendstream\nendobj\n%%EOF"
    assert pdf_text(data) == "river (Upper) levels\nAé"
    with pytest.raises(ExtractError):
        pdf_text(b"nothing")


def test_extraction_cache_keeps_results_and_errors(spark):
    schema = "path string, mtime long, size long, content binary"
    first, cache = with_cache(spark.createDataFrame([("/a.txt", 1, 2, b"hi"), ("/b.pdf", 1, 1, b"x")], schema), None)
    assert {r.path: (r.text, r.error) for r in first.collect()} == {"/a.txt": ("hi", None), "/b.pdf": (None, "not a PDF")}
    changed, _ = with_cache(spark.createDataFrame([("/a.txt", 1, 2, b"ignored"), ("/b.pdf", 2, 1, b"y")], schema), cache.cache())
    assert {r.path: r.text for r in changed.collect()} == {"/a.txt": "hi", "/b.pdf": None}


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    assert store.load() is None
    rows = spark.createDataFrame([("/b", 1, 0), ("/a", 1, 0), ("/c", 5, 0)], "path string, mtime long, size long")
    assert store.publish(rows) == 1 and [r.path for r in store.load().orderBy("ord").collect()] == ["/c", "/a", "/b"]
    pinned = store.load()
    assert store.publish(rows.limit(1), expected=0) is None and store.publish(rows.where("path = '/c'"), expected=1) == 2
    assert store.load().count() == 1 and pinned.count() == 3
    for damage in ("{", '{"format": 1}', "\xff"):
        (tmp_path / "s/CURRENT").write_bytes(damage.encode("latin-1"))
        assert store.load() is None
    assert store.load_or_build(lambda: rows).count() == 3


def test_folding(spark):
    schema = "path string, mtime long, size long"
    current = spark.createDataFrame([("/a/", 1, 0), ("/a/x", 1, 1), ("/a/y/z", 1, 1), ("/ab", 1, 1), ("/c", 1, 1), ("/d", 1, 1)], schema)
    touched = spark.createDataFrame([("/a",), ("/c",), ("/new",)], "path string")
    fronts = spark.createDataFrame([("/a", 9, 5), ("/new", 9, 7)], schema)  # a folder became a file; /c is gone
    assert {tuple(r) for r in folded(current, touched, fronts).collect()} == {("/a", 9, 5), ("/new", 9, 7), ("/ab", 1, 1), ("/d", 1, 1)}


def test_index_stream(spark, tmp_path):
    root, events = tmp_path / "root", tmp_path / "events"
    tree(root, {"keep.txt": "k", "old.txt": "o", "sub/in.txt": "i"})
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    store.publish(walked(spark, [str(root)]).where("state = 'found'").select("path", "mtime", "size"))
    (root / "old.txt").unlink()
    tree(root, {"new.txt": "nn", "fresh/deep/f.txt": "f", "skip/node_modules/x": "x"})
    events.mkdir()
    touched = [f"{root}/{p}" for p in ("old.txt", "new.txt", "fresh", "skip/node_modules/x")]
    (events / "1.json").write_text("\n".join(f'{{"path": "{p}"}}' for p in touched))
    stream = IndexStream(store, ["node_modules"])
    rows = spark.readStream.schema("path string").json(str(events))
    query = stream.start(rows, str(tmp_path / "ck"), available_now=True)
    query.awaitTermination(90)
    found = [r.path.removeprefix(f"{root}/") for r in store.load().orderBy("ord").collect()]
    assert set(found) == {"new.txt", "fresh/", "fresh/deep/", "fresh/deep/f.txt", "keep.txt", "sub/", "sub/in.txt"}
    assert set(found[:4]) == {"new.txt", "fresh/", "fresh/deep/", "fresh/deep/f.txt"}  # the newest burst stands first


def test_bursts_that_wait_outlive_the_stream(spark, tmp_path):
    root = tmp_path / "root"
    tree(root, {"a.txt": "a", "b.txt": "b"})
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    stream = IndexStream(store, save_every=3600)
    names = lambda: sorted(r.path.removeprefix(f"{root}/") for r in store.load().collect())
    burst = lambda *paths: spark.createDataFrame([(f"{root}/{p}",) for p in paths], "path string")
    stream.fold(burst("a.txt"), 0)
    stream.fold(burst("b.txt"), 1)
    stream.fold(burst("b.txt"), 1)
    assert names() == ["a.txt"] and len(store.waiting()) == 2
    IndexStream(store, save_every=3600).flush()
    assert names() == ["a.txt", "b.txt"] and store.waiting() == []


def test_changes_while_nothing_watched(spark, tmp_path):
    root = tmp_path / "root"
    tree(root, {"gone.txt": "g", "stays.txt": "s", "grows.txt": "1", "dir/in.txt": "i"})
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    rows = walked(spark, [str(root)]).where("state = 'found'").select("path", "mtime", "size")
    store.publish(rows.unionByName(spark.createDataFrame([("/elsewhere/x", 1, 1)], "path string, mtime long, size long")))
    (root / "gone.txt").unlink()
    tree(root, {"grows.txt": "12345", "dir/new.txt": "n"})
    IndexStream(store).reconcile([str(root), "/no/such/root"])
    found = {r.path.removeprefix(f"{root}/"): r for r in store.load().collect()}
    assert set(found) == {"stays.txt", "grows.txt", "dir/", "dir/in.txt", "dir/new.txt", "/elsewhere/x"}
    assert found["grows.txt"].size == 5 and found["grows.txt"].burst == found["dir/new.txt"].burst == 2 and found["stays.txt"].burst == 0


def test_lines_and_queries(spark, tmp_path):
    assert [r.path for r in from_lines(spark, ["b\n", " \n", "a"]).orderBy("ord").collect()] == ["b", "a"]
    for q in ("one", " ", "two"):
        append_query(spark, str(tmp_path / "q"), q)
    assert {r.q for r in read_queries(spark, str(tmp_path / "q")).collect()} == {"one", "two"}


def test_config(tmp_path):
    path = str(tmp_path / "c/config.toml")
    assert config.load_or_create(path).max_content_filesize == 2 << 20 and os.path.exists(path)
    open(path, "w").write('roots = "x"')
    with pytest.raises(ValueError):
        config.load_or_create(path)


def test_command_line(spark, tmp_path, capsys):
    tree(tmp_path / "home", {"big.bin": "x" * 5000, "mid.txt": "some Needle here", "a.md": "m"})
    (tmp_path / "c.toml").write_text(f'roots = ["{tmp_path}/home"]\nindex_dir = "{tmp_path}/index"\n')
    run = lambda *a: main(["--config", str(tmp_path / "c.toml"), *a], spark)
    assert run("--reindex") == 0 and "indexed 3 files" in capsys.readouterr().out
    assert run("--big", "2") == 0 and capsys.readouterr().out.split()[:3] == ["5.0", "KB", f"{tmp_path}/home/big.bin"]
    assert run("-p", "mid") == 0 and capsys.readouterr().out.split()[0].endswith("mid.txt")
    assert run("-p", "> needle") == 0 and capsys.readouterr().out.strip().endswith("mid.txt:1:some Needle here")
    assert run("-p", "ext:txt", "mid") == 0 and capsys.readouterr().out.split() == [f"{tmp_path}/home/mid.txt"]
    assert run("--pick", "mid") == 0 and capsys.readouterr().out.split() == [f"{tmp_path}/home/mid.txt"] and run("--pick", "nosuchname") == 1 and run("-p") == 2
    assert run("-p", "nosuchname") == 1 and run("-p", "> [x") == 2


def test_files_are_extracted_slice_by_slice():
    rows = [b"x" * 10, None, b"", b"y" * (3 << 20), b"z"] + [b"w"] * 600
    parts = list(documents.slices(pa.RecordBatch.from_pydict({"content": pa.array(rows, pa.binary())}), "content"))
    assert [x for p in parts for x in p.column("content").to_pylist()] == rows
    assert max(p.num_rows for p in parts) <= documents.SLICE_ROWS and [p.num_rows for p in parts[:2]] == [3, 1]
