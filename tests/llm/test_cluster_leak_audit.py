"""Sort-means, winnowing and the divergence audit against brute force, with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pathloom.llm import divergence, winnowing
from pathloom.llm.divergence import audited
from pathloom.llm.sort_means import clustered, reassigned, whole
from pathloom.llm.winnowing import marked

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def means(rows, clusters=16, rounds=3, width=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for k in set(at):
            own = [v for (_, v), a in zip(kept, at) if a == k]
            centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    held = Counter()
    for _, k, d in out:
        held[k] += d
    long = lambda x: x if x < 1 << 63 else None
    return Counter((i, k, long(d), long(held[k]), long(sum(held.values())), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, k, d in out)


@pytest.fixture(scope="module")
def vectors():
    r = random.Random(3)
    middle = [[r.uniform(-3, 3) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + r.gauss(0, 0.4) for x in r.choice(middle)]) for i in range(700)]
    rows += [(800 + i, [float(i % 3)] * 64) for i in range(40)]  # equal vectors and ties
    rows += [(5, rows[7][1]), (5, rows[7][1]), (None, rows[1][1]), (None, [0.5] * 64)]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [float("nan")] * 64), (906, [float("inf")] + [0.0] * 63)]
    return rows


@pytest.mark.parametrize("batch", [10_000, 90])
def test_sort_means_equals_brute_force(spark, vectors, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, cluster int")
        assert Counter(map(tuple, clustered(df).collect())) == means(vectors)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sort_means_of_wide_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    wide = [(i, [1e6 * (i % 3) + i] * 63 + [3e9 * (i % 2)]) for i in range(30)]
    assert Counter(map(tuple, clustered(spark.createDataFrame(wide + [(99, [1e300] * 64)], kind)).collect())) == means(wide)
    few = [(i, [i / 7] * 64) for i in range(5)]
    assert Counter(map(tuple, clustered(spark.createDataFrame(few, kind)).collect())) == means(few)
    assert clustered(spark.createDataFrame([(1, None)], kind)).collect() == []
    assert [int(x) for x in whole(np.array([[-1 / 128, 1e300]]))[0]] == [-1, int(1e300) * 64]


def test_scan_starts_anywhere_and_gives_ties_to_smaller_numbers():
    centroids = np.array([[0] * 64, [2] * 64, *[[1000 * k] * 64 for k in range(1, 9)]], dtype=object)
    rows = np.array([[0] * 64, [1] * 64, [2000] * 64, [1500] * 64], dtype=float)
    for start in range(len(centroids)):
        assert reassigned(rows, centroids, np.full(4, start, dtype=np.int32))[0].tolist() == [0, 0, 3, 2]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(docs, items, span=10):
    words = lambda t: WORD.findall((t or "").translate(SMALL))
    index = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(span, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            index[tuple(w[a : a + n])].add(i)
    sizes, out = {len(k) for k in index}, Counter()
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in index:
                    hit.update(range(a, a + n))
                    found |= index[k]
        names = sorted(str(i) for i in found if i is not None)
        out[d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.fixture(scope="module")
def leaky():
    r = random.Random(8)
    pool = ["the", "The", "ümlaut", "x1", "42", "naïve", "of", "a", "b", "c", "日本"]
    text = lambda n: " ".join(r.choice(pool) for _ in range(n))
    items = [(i, text(r.choice([12, 25, 40]))) for i in range(40)] + [(50, "Only three words"), (51, "zebra"), (52, "..."), (53, None), (54, ""), (None, "nameless item of a few words"), (2, "second text of item two which is long enough to be windows"), (55, "only THREE words"), (56, "a a a a a a a a a a a a")]
    docs = []
    for i in range(300):
        parts = [text(r.choice([0, 3, 30, 90]))]
        for _ in range(r.choice([0, 0, 1, 3])):
            w = (r.choice(items)[1] or "").split()
            a = r.randrange(len(w) + 1)
            parts += ["; ".join(w[a : a + r.choice([5, 9, 10, 11, 30])]), text(5)]
        docs.append((i, " — ".join(parts)))
    docs += [(7, docs[7][1]), (400, None), (401, ""), (402, "!!"), (None, "zebra"), (403, "a " * 5000), (404, ("w" * 70 + " ") * 3 + "zebra"), (405, text(60_000))]
    return docs, items


@pytest.mark.parametrize("blocks", [{}, {"block_windows": 150}])
def test_marks_equal_brute_force(spark, leaky, blocks):
    docs, items = leaky
    frame = spark.createDataFrame([(*d, 1, [1]) for d in docs], "doc_id long, text string, n_words int, runs array<int>").repartition(5)
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, span string")
    want = leaks(docs, items)
    got = marked(frame, bench, **blocks)
    assert Counter(map(tuple, got.drop("runs").collect())) == want
    assert all(sum(r.runs[1::2]) - sum(r.runs[0::2]) == r.n_hit and r.runs == sorted(set(r.runs)) for r in got.collect())


def test_pieces_of_long_texts(monkeypatch, leaky):
    docs, _ = leaky
    for _, text in docs:
        body = (text or "").encode()
        parts = list(winnowing.pieces(body, 10, 64))
        assert b"".join(p[:own] for p, own in parts).translate(winnowing.WORDS) == body.translate(winnowing.WORDS)
    words = [w for w, _ in zip(iter(lambda: random.choice("abcd"), None), range(40_000))]
    index = [winnowing.Index([b" ".join(x.encode() for x in words[17_000:17_010])], np.array([5]), 10)]
    whole_counts, whole_hits = winnowing.looked_up([" ".join(words).encode()], index)
    monkeypatch.setattr(winnowing, "SLICE", 100)
    counts, hits = winnowing.looked_up([b"", " ".join(words).encode(), b"x"], index)
    assert counts == [0, *whole_counts, 1] and 17_000 in np.concatenate([f for f, *_ in hits[1]])
    assert sorted(np.concatenate([f for f, *_ in hits[1]]).tolist()) == sorted(np.concatenate([f for f, *_ in whole_hits[0]]).tolist())


def test_marks_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert marked(docs, bench).collect() == []
    row = marked(spark.createDataFrame([(3, "a b c")], docs.schema), bench.limit(0)).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (3, 0, 0, False)


def test_every_shared_span_has_a_common_fingerprint():
    """The guarantee, whatever surrounds the span, with many equal words."""
    r = random.Random(1)
    for span in range(1, 13):
        k = winnowing.gram_words(span)
        for _ in range(60):
            shared, left, right = (" ".join(r.choice("ab") for _ in range(n)) for n in (span, 7, 9))
            prints = []
            for text in (shared, f"{left} {shared} {right}", f"{right} {shared}"):
                grams = winnowing.range_sums(winnowing.words_of([text.encode()]).hashes, k)
                prints.append({int(grams[a]) for a in winnowing.fingerprints(grams, span + 1 - k)})
            assert prints[0] <= prints[1] and prints[0] <= prints[2]


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audit(rows):
    uses, docs, groups = Counter(), Counter(), set()
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = TERM.findall(text.translate(SMALL))
        groups.add((lang, source))
        for t in terms:
            uses[lang, source, t] += 1
            uses[lang, None, t] += 1
        docs.update((lang, t) for t in set(terms))
    out = Counter()
    for lang in {g[0] for g in groups}:
        kept = [t for (k, t), n in docs.items() if k == lang and n >= 10]
        sources = [s for k, s in groups if k == lang]
        totals = {s: sum(uses[lang, s, t] for t in kept) for s in [*sources, None]}
        share = {(s, t): 1 + 10**9 * (uses[lang, s, t] + 2) // (totals[s] + 2 * len(kept)) for s in totals for t in kept}
        far = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(-sum(far(share[s, t], share[o, t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-far(share[s, t], share[None, t]), t.encode()) for t in kept if uses[lang, s, t] and share[s, t] > share[None, t]]
            for part, best in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out.update((lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(best))
    return out


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    words = ["the", "The", "and", "größe", "Größe", "naïve", "日本語", "x", "don't", "a1b", "zeta", *(f"rare{chr(97 + k)}" for k in range(20))]
    rows = [(r.choice(["en", "de", None, "fr"]), r.choice(["s1", "s2", "s3", None, "hot", "hot", "hot"]), " ".join(r.choices(words, k=r.choice([0, 2, 20, 60])))) for _ in range(500)]
    rows += [rows[3]] * 30 + [("en", "empty", None), ("en", "blank", ""), ("en", "marks", "123 !?"), ("it", "alone", "uno due"), ("pt", "p1", "um"), ("pt", "p2", None), ("es", "solo", "si " * 20), (None, None, None)]
    return rows + [("en", "long", "naïve " * 40_000 + "y" * 30_000 + " the")]


@pytest.mark.parametrize("sizes", [{}, {"side": 2, "cells": 12}, {"cells": 40}])
def test_audit_equals_brute_force(spark, corpus, sizes):
    docs = spark.createDataFrame([(*r, 1, "z") for r in corpus], "lang string, source string, text string, rank int, term string").repartition(4)
    assert Counter(map(tuple, audited(docs, **sizes).collect())) == audit(corpus)


def test_audit_passes_counts_on_when_full(spark, corpus, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    monkeypatch.setattr(divergence, "PIECE", 50)
    import pyarrow as pa

    rows = [(a or "", b or "", c or "") for a, b, c in corpus]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "source", "text"])
    uses, docs = Counter(), Counter()
    for out in divergence._counted(iter([batch])):
        for lang, term, n, sources, counts in zip(*(c.to_pylist() for c in out.columns)):
            docs[lang, term] += n
            for s, k in zip(sources, counts):
                uses[lang, s, term] += k
    want, held = Counter(), Counter()
    for lang, source, text in rows:
        terms = [t.encode() for t in TERM.findall(text.translate(SMALL))]
        want.update((lang, source, t) for t in terms)
        held.update((lang, t) for t in set(terms))
    assert uses == want and docs == held


def test_audit_of_an_empty_table_and_large_counts(spark):
    assert audited(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
    for count, total in ((10**15 - 1, 10**15), (7, 9), (0, 5), (123456789012345, 987654321098765)):
        assert divergence.scaled(np.array([count]), np.array([total])).tolist() == [10**9 * count // total]


def test_new_operators_match_their_sql(spark):
    import duckdb

    from pathloom.llm import queries

    folder = "/root/testdata/sf0.001"
    base = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    for name in ("op11_sort_means", "op12_decontamination", "op13_divergence"):
        got = queries.QUERIES[name](spark, folder)
        want = base.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
        assert Counter(map(tuple, got.collect())) == Counter(want), name
