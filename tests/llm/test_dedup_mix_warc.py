"""Exact dedup, mixing and WARC packages against brute force, with nulls, repeats, empty tables and clashing columns."""

import hashlib
import io
import random
import re
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pytest
from pathloom.llm import archives, fuse_filter
from pathloom.llm.archives import PackageReader, archived
from pathloom.llm.exact_dedup import deduplicated
from pathloom.llm.mixing import mixed

DOCS = "doc_id long, text string, source string, lang string"


def test_fuse_filter_holds_its_keys():
    for n in (0, 1, 2, 3, 10, 1000, 70_000):
        keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
        bits = fuse_filter.build(np.concatenate([keys, keys[:5]]))
        assert fuse_filter.contains(bits, keys).all()
        others = np.random.default_rng(n + 1).integers(0, 1 << 63, 20_000, dtype=np.uint64)
        assert fuse_filter.contains(bits, others).mean() < 0.01
        assert n < 1000 or len(bits) < 1.4 * n + 4096


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [(i, r.choice(["a", "b c", "", None, f"own {i}", "long " * 500]), r.choice(["s1", "s2", None]), "en") for i in range(300)]
    return out + [(7, out[7][1], out[7][2], "de"), (None, "b c", "s1", None), (None, "only here", None, None)]


def test_exact_dedup_equals_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"lang": "sha"})  # a name of the operator's own
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[text or ""].append(i)
    want = Counter()
    for i, text, *_ in rows:
        ids = groups[text or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want[i, keep, len(ids), i == keep, hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, deduplicated(docs).collect())) == want


def test_exact_dedup_of_an_empty_table(spark):
    assert deduplicated(spark.createDataFrame([], DOCS)).collect() == []


def targets(rows):
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out, free, rest = {}, set(order), float(sum(sizes.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}, sizes
        for s in over:
            out[s] = 3.0 * sizes[s]
            rest -= out[s]
            free.discard(s)
    return out, sizes


def test_mix_meets_targets(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.choice([0, 3, 10, 40, 400])) if i % 50 else None, r.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"]), "en") for i in range(2000)]
    rows += [(3, rows[3][1], rows[3][2], "de"), (None, "x y", "a", "en"), (9000, "tiny\x0bpair", "one", "en")]
    docs = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"lang": "size"})
    want, sizes = targets(rows)
    got = mixed(docs).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixed(docs.repartition(5)).collect()))
    source = {}
    for i, _, s, _ in rows:
        source.setdefault(i, s)
    taken = Counter()
    for g in got:
        s = source[g.doc_id]
        assert g.source_size == sizes[s] and abs(g.target - want[s]) < 1e-6 * max(1, want[s])
        assert g.taken <= 3 * g["size"] and g.taken == g["size"] * g.copies
        taken[s] += g.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= max(2, 0.02 * want[s]), (s, taken[s], want[s])


def test_mix_of_empty_and_wordless_tables(spark):
    assert mixed(spark.createDataFrame([], DOCS)).collect() == []
    got = mixed(spark.createDataFrame([(1, None, "a", ""), (2, " \n", None, "")], DOCS)).collect()
    assert [(g["size"], g.taken, g.target) for g in got] == [(0, 0, 0.0)] * 2


def test_packages_give_every_page_back(spark, tmp_path):
    pages = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 3000), (1, "http://a2/", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, "m", "none else")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'z' as sha")
    got = archived(table.repartition(3), to=f"file://{tmp_path}").collect()
    firsts = {}
    for i, _, html in pages:
        if i is not None:
            firsts[html or ""] = min(i, firsts.get(html or "", i))
    import base64

    want = Counter()
    for i, url, html in pages:
        body = (html or "").encode()
        first = firsts.get(html or "")
        revisit = first is not None and i != first
        want[i, url, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None, None if revisit else html or ""] += 1
    assert Counter(tuple(g[c] for c in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")) for g in got) == want
    assert archived(table.limit(0)).collect() == []


def test_min_bytes_keeps_small_payloads_apart(spark):
    table = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "y" * 50), (4, "d", "y" * 50)], "page_id long, url string, html string")
    got = {g.page_id: g.record_type for g in archived(table, min_bytes=10).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


@pytest.mark.parametrize("zip64", [False, True])
def test_reader_parses_other_writers_packages(zip64):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with z.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=zip64) as f:
            f.write(b"0123456789" * 10)
        z.writestr("packed.txt", b"abc" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 in it" + b"." * 30
    reader = PackageReader(out, len(out.getvalue()))
    assert reader.read("archive/data.warc.gz", 13, 5) == b"34567"
    with pytest.raises(ValueError):
        reader.read("packed.txt")
    with pytest.raises(ValueError):
        reader.read("archive/data.warc.gz", 98, 5)
    with pytest.raises(ValueError):
        PackageReader(io.BytesIO(b"nothing"), 7)


def test_reader_follows_zip64_records():
    """A package whose 32-bit fields are all full, as beyond 4 GB."""
    import struct

    body, name = b"stored bytes", b"m"
    local = b"PK\3\4" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body))
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    central = b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local) + len(body)
    end64 = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = b"PK\6\7" + struct.pack("<IQI", 0, at + len(central), 1)
    data = local + body + central + end64 + locator + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert PackageReader(io.BytesIO(data), len(data)).read("m") == body


def test_revisit_record_tells_length_without_payload():
    raw = archives.record_bytes(5, "http://x/", b"abc", "D", 2, True)
    fields, http, payload = archives.parsed_record(raw)
    assert fields["WARC-Refers-To"] == "<urn:page:2>" and b"Content-Length: 3" in http and payload == b""
