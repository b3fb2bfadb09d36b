"""Jaccard join, vantage-point search and repeated spans against brute force."""

import hashlib
import random
import re
import sys

import numpy as np
import pytest
from pathloom.llm import jaccard_join, metric_cells, vantage, word_hash
from pathloom.llm.components import components
from pathloom.llm.jaccard_join import SLOT_BITS, joined, pivots, shingle_sets
from pathloom.llm.repeated_spans import without_repeats
from pathloom.llm.shared import bucketed, dropped, written
from pyspark.sql import functions as F


@pytest.mark.parametrize("bound", [250_000, 20])
def test_components(spark, monkeypatch, bound):
    """In one task, and contracted by shuffles first."""
    monkeypatch.setattr(sys.modules["pathloom.llm.components"], "TASK_LINKS", bound)
    r = random.Random(1)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(200, 260)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = {g.node: g.comp for g in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if near[k] != {k}}


def brute_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return ({tuple(w)} if w else set()) if len(w) < 4 else {tuple(w[k : k + 4]) for k in range(len(w) - 3)}


def brute_components(rows):
    ids = [i for i, _ in rows if i is not None]
    sets = [(i, brute_sets(t)) for i, t in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    text = lambda n: [word() for _ in range(n)]
    passage = text(40)
    rows = []
    for n in (8, 20, 60, 63, 66, 70, 120, 400):
        base = text(n)
        for edits in (0, 0, 1, 1, 2, 3, n // 20, n // 12, n // 30, n // 8):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy + (text(edits) if r.random() < 0.3 else [])))
    rows += [" ".join(text(r.randint(5, 60)) + passage + text(r.randint(0, 30))) for _ in range(60)]
    rows += ["", None, " \n", "one two", "ONE two", "one two three", "a b c d", "a b c d", None]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("stars", "part", "tile"), [(2, 1500, 512), (0, 9, 512), (0, 1500, 8)])
def test_join_equals_brute_force(spark, monkeypatch, stars, part, tile):
    """Also with no pivot made from cells before they are split, with small blocks, and with small tiles, so that Voronoi cells recurse."""
    monkeypatch.setattr(jaccard_join, "STARS", stars)
    monkeypatch.setattr(jaccard_join, "PART", part)
    monkeypatch.setattr(metric_cells, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "CHUNK", 300)
    rows = [*corpus(), (None, "a b c d"), (3, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as sid", "'x' as n")
    got = sorted(((g.doc_id, g.n_shingles, g.component_id) for g in joined(docs).collect()), key=repr)
    assert got == brute_components(rows)


def test_join_of_many_copies_about_the_threshold(spark, monkeypatch):
    """A third of all rows lie just above or just below the threshold from each other, and one is very long."""
    monkeypatch.setattr(jaccard_join, "PART", 200)
    monkeypatch.setattr(metric_cells, "TILE", 64)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(103)]
    rows = []
    for k in range(320):
        copy = list(base)
        for at in r.sample(range(0, 100, 5), (1, 2, 3, 4)[k % 4]):
            copy[at] = word()
        rows.append(" ".join(copy))
    rows += [" ".join(word() for _ in range(r.randint(1, 90))) for _ in range(300)]
    rows += [" ".join(word() for _ in range(200_000))] * 2
    rows = list(enumerate(rows))
    got = sorted(((g.doc_id, g.n_shingles, g.component_id) for g in joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()), key=repr)
    assert got[-2:] and got == brute_components(rows)


def test_near_copies_are_not_sent_once_for_each_cell(spark, monkeypatch):
    """Whole sets that reach the tasks of the last round: a few times each, however many cells they share."""
    moved, links = [], jaccard_join.cell_links
    monkeypatch.setattr(jaccard_join, "cell_links", lambda blocks, *a: moved.append((blocks.count(), blocks.select("sid").distinct().count())) or links(blocks, *a))
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(3):
        base = [word() for _ in range(103)]
        for k in range(60):
            copy = list(base)
            for at in r.sample(range(0, 100, 5), (1, 2, 3, 4)[k % 4]):
                copy[at] = word()
            rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    got = sorted(((g.doc_id, g.n_shingles, g.component_id) for g in joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()), key=repr)
    assert got == brute_components(rows)
    assert moved[-1][1] > 20 and moved[-1][0] <= 3 * moved[-1][1]


@pytest.mark.parametrize("part", [4000, 12])
def test_gathered_blocks_keep_every_meeting(spark, monkeypatch, part):
    """All pairs of two components that shared a block share one, also where a company is dealt in parts; blocks with nothing in common stay."""
    monkeypatch.setattr(jaccard_join, "PART", part)
    r = random.Random(11)
    comp = {sid: sid // 3 if sid < 30 else -1 if sid < 60 else sid for sid in range(200)}
    of = {b: r.sample(range(90), 60) if b < 25 else [100 + 4 * (b - 25) + k for k in range(4)] for b in range(50)}
    rows = [(b, sid, comp[sid], 50) for b, sids in of.items() for sid in sids]
    meet = lambda of: {(x, y) for sids in of.values() for x in sids for y in sids if x < y and comp[x] != comp[y]}
    kind = "block long, sid long, comp long, n long"
    got = jaccard_join.gathered(written(spark.createDataFrame(rows, kind), "blocks")).collect()
    after = {}
    for g in got:
        assert g.sid not in after.setdefault(g.block, set()) and (g.comp, g.n) == (comp[g.sid], 50)
        after[g.block].add(g.sid)
    assert meet(after) >= meet(of) and len(got) < (len(rows) / 2 if part == 4000 else len(rows))
    assert {frozenset(sids) for b, sids in of.items() if b >= 25} <= {frozenset(s) for s in after.values()}
    assert max(map(len, after.values())) <= (60 if part == 12 else 90)
    assert jaccard_join.gathered(written(spark.createDataFrame([], kind), "blocks")).collect() == []


def test_voronoi_cells_hold_every_link():
    r = np.random.default_rng(8)
    base = [np.unique(r.integers(0, 4000, 60)) for _ in range(6)]
    sets = []
    for k in range(400):
        x = base[k % 6]
        sets.append(np.unique(np.concatenate((r.choice(x, len(x) - r.integers(0, 8), replace=False), r.integers(0, 4000, r.integers(0, 6))))).astype(np.uint64))
    cells = metric_cells.Cells(sets, np.arange(len(sets)), 85)
    members = np.arange(len(sets))
    found = [set(c.tolist()) for c in cells.split(members, members[::57])]
    shared = cells.overlaps(members, members)
    assert all(shared[a, b] == len(np.intersect1d(sets[a], sets[b])) for a in range(0, 400, 37) for b in range(400) if a != b)
    size = np.array([len(s) for s in sets])
    linked = np.argwhere(100 * shared >= 85 * (size[:, None] + size[None] - shared))
    assert len(linked) > 1000 and all(any(a in c and b in c for c in found) for a, b in linked.tolist())
    assert sum(map(len, found)) < 3 * len(sets)


def test_words_of_a_pattern_that_wrapping_polynomials_confuse():
    a = "".join("ab"[k.bit_count() % 2] for k in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    x, y = shingle_sets([a.encode(), b.encode()])
    assert not np.array_equal(x, y)


def test_join_of_an_empty_table(spark):
    assert joined(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_linked_sets_share_a_cell():
    r = np.random.default_rng(3)
    counts = r.integers(0, 3, 1 << SLOT_BITS).astype(np.uint32)
    for n in (6, 7, 20, 54, 55, 63, 64, 75, 80, 96, 130, 380, 400, 1000):
        for _ in range(15):
            x = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
            y = x
            for _ in range(300):  # as different as a link allows
                k = r.integers(len(y))
                z = np.delete(y, k) if r.random() < 0.5 else np.unique(np.append(np.delete(y, k), r.integers(0, 1 << 64, 1, dtype=np.uint64)))
                if 100 * len(np.intersect1d(x, z)) < 85 * len(np.union1d(x, z)):
                    break
                y = z
            near = pivots(x, counts), pivots(y, counts)
            assert len(np.intersect1d(*near))
            near = [(v >> np.uint64(32)).astype(np.uint32) for v in near]
            assert jaccard_join.most_shared(near[0], len(x), near[1], len(y), counts) >= len(np.intersect1d(x, y))
            lasts = [jaccard_join.last_key(v, counts) for v in near]
            assert metric_cells.partnered(list(near), np.array([len(x), len(y)]), lasts, np.array([1, 2]), 85).all()
            z = np.unique(np.concatenate((r.permutation(x)[: n // 4], r.integers(0, 1 << 64, n - n // 4, dtype=np.uint64))))
            if n >= 130:  # a quarter in common: ruled out
                near = [(v >> np.uint64(32)).astype(np.uint32) for v in (pivots(x, counts), pivots(z, counts))]
                bound = jaccard_join.most_shared(near[0], len(x), near[1], len(z), counts)
                assert 100 * bound < 85 * (len(x) + len(z) - bound)


def test_shingles_equal_definition():
    texts = ["A b c D e", "a B C d e", "x", "x y", "y x", "", "a b c d e f g a b c d", "é É ñ K k"]
    sets = shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in sets] == [len(brute_sets(t)) for t in texts]
    assert (sets[0] == sets[1]).all() and not np.array_equal(sets[3], sets[4])


def brute_nearest(rows):
    fit = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    fit = [(i, v / np.abs(v).max()) for i, v in fit]  # else squares of tiny vectors vanish
    out = {}
    for i, v in fit:
        if i % 50 == 0:
            others = [(-float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), j) for j, w in fit if j != i and len(w) == len(v)]
            out[i] = [(j, -s) for s, j in sorted((round(s, 12), j) for s, j in others)[:5]]
    return out


def test_search_is_exact_at_factor_one_and_near_it_below(spark):
    r = np.random.default_rng(2)
    rows = [(int(i), r.normal(size=8).round(3).tolist()) for i in range(900)]
    rows += [(1000 + k, rows[50][1]) for k in range(12)]  # more equal vectors than are asked for
    rows += [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] * 8), (2150, [1.0, None] + [0.0] * 6), (2200, []), (None, rows[0][1]), (2250, [1.0, 2.0]), (2251, [2.0, 1.0]), (2300, [1e-200] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as shard")
    want = brute_nearest(rows)
    for relax, least in ((1.0, 1.0), (vantage.RELAX, 0.9)):
        got = {}
        for g in vantage.nearest(table, relax=relax, shard_rows=300, block_rows=7).collect():
            got.setdefault(g.query_id, {})[g.rank] = (g.vec_id, g.score)
        assert got.keys() == {k for k, v in want.items() if v}
        hits = [got[q].get(k + 1, (None,))[0] == j for q in want for k, (j, _) in enumerate(want[q])]
        assert np.mean(hits) >= least
        assert all(abs(got[q][k + 1][1] - s) < 1e-9 for q in want for k, (j, s) in enumerate(want[q]) if relax == 1)
    assert vantage.nearest(table.limit(0)).collect() == []


def test_copies_of_a_query_come_in_the_order_of_their_ids():
    for seed in range(20):
        r = np.random.default_rng(seed)
        data = r.normal(size=(600, 64))
        same = r.choice(600, 80, replace=False)
        data[same] = data[same[0]]
        tree = vantage.Tree(np.arange(600), data, leaf=32, seed=seed)
        for relax in (1.0, vantage.RELAX):
            unit = vantage.unit_rows(data[same])
            where, scores = tree.search(same, unit, 5, relax, data[same])
            for q, at in zip(same, where):
                assert tree.ids[at].tolist() == sorted(set(same.tolist()) - {q})[:5]
            assert len({s for s in scores.ravel()}) == 1


def test_trees_prune_where_vectors_lie_in_groups():
    r = np.random.default_rng(3)
    centres = r.normal(size=(120, 32))
    data = centres[r.integers(120, size=12_000)] + 0.1 * r.normal(size=(12_000, 32))
    asked = np.arange(0, 12_000, 50)
    tree, unit = vantage.Tree(np.arange(12_000), data), vantage.unit_rows(data)
    where, _ = tree.search(asked, unit[asked], 5, vantage.RELAX, data[asked])
    all_pairs = unit[asked] @ unit.T
    all_pairs[np.arange(len(asked)), asked] = -2
    want = np.argsort(-all_pairs, axis=1, kind="stable")[:, :5]
    recall = np.mean([len(set(tree.ids[w]) & set(x)) / 5 for w, x in zip(where, want)])
    assert recall >= 0.9 and tree.visited < 0.5 * len(asked) * len(data)
    print(recall, tree.visited / (len(asked) * len(data)))


def brute_spans(rows, span):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        fresh = set()
        for s in range(len(b) - span + 1):
            w = b[s : s + span]
            if w in seen or w in fresh:
                gone[s : s + span] = b"\1" * span
            fresh.add(w)
        seen |= fresh
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def span_corpus():
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefghé ") for _ in range(n))
    passage, line = text(300), text(104)
    rows = [text(r.randint(50, 400)) + (passage[r.randint(0, 100) : r.randint(200, 300)] if k % 3 == 0 else "") + text(r.randint(0, 90)) + (line if k % 2 else "") + text(30) for k in range(60)]
    rows += [rows[3]] * 5 + ["ab" * 300, "xyz" * 100 + "q", None, "", "a" * 99, "a" * 100, "a" * 101, rows[4][:99], rows[4][:100]]
    rows += [rows[5][:150] + "#" + rows[5][150:], rows[6].replace("a", "A", 3)]
    return list(enumerate(rows))


@pytest.mark.parametrize(("hot", "piece"), [(50_000, 512 << 10), (5, 512 << 10), (50_000, 256)])
def test_repeated_spans_equal_brute_force(spark, monkeypatch, hot, piece):
    """Also with every shared gram hot, and with texts read in small pieces."""
    from pathloom.llm import repeated_spans

    monkeypatch.setattr(repeated_spans, "PIECE", piece)
    monkeypatch.setattr(repeated_spans, "CHUNK", 500)
    rows = span_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 as row")
    got = sorted((tuple(g) for g in without_repeats(docs, hot_gram=hot).collect()), key=repr)
    assert got == brute_spans(rows, 100)


def test_range_hashes():
    data = np.frombuffer(bytes(random.Random(2).choices(b"ab", k=3000)) * 2, dtype=np.uint8)
    starts = np.arange(0, 2800, 7)
    for hashes in (word_hash.prime_hashes, lambda d, a, b: word_hash.range_hashes(word_hash.prefix_hashes(d), a, b)):
        assert (hashes(data, starts, starts + 160) == hashes(data, starts + 3000, starts + 3160)).all()
        assert len(np.unique(hashes(data, starts, starts + 160))) == len(starts)


def test_repeated_spans_of_odd_ids(spark):
    rows = [(2, "b" * 50 + "c" * 120), (2, "a" * 40 + "c" * 120), (None, "c" * 130), (1, "d" * 10), (2, "a" * 40 + "c" * 120)]
    got = sorted((tuple(g) for g in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute_spans(rows, 100)
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []




def test_tables_in_buckets_are_joined_where_they_lie(spark):
    first = bucketed(spark.range(50).select(F.col("id").alias("sid"), (F.col("id") * 2).alias("n")), "sets", "sid")
    both = bucketed(spark.range(40, 60).selectExpr("id + 10 AS sid", "id AS n").unionByName(spark.range(60, 62).selectExpr("id AS sid", "id AS n")), "sets", "sid", first)
    assert both.count() == both.select("sid").distinct().count() == 70
    pairs = spark.range(200).selectExpr("id % 70 AS sid", "id AS k").hint("merge")
    found = pairs.join(both, "sid")
    assert found.count() == 200
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # the pairs alone
    dropped(both)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sets_")]
