"""Requests, predicates, ranking, content, history and semantic search on table-driven cases."""

import math
import random

import pytest
from pathloom.functions import fuzzy
from pathloom.functions.calc import evaluate, shown
from pathloom.operators import changes, content, history, rank, semantic
from pathloom.operators.predicates import exclude_regex, predicate, quiet
from pathloom.plans.search import Corpus, filter_lines, plan, script_search
from pathloom.request import InvalidPattern, java_pattern, parse, parse_filters, parse_size
from pyspark.sql import functions as F

NOW = 1_000_000


def index(spark, paths, meta=None):
    rows = [(p, *(meta[k] if meta else (0, 0)), k) for k, p in enumerate(paths)]
    return spark.createDataFrame(rows, "path string, mtime long, size long, ord long")


def ids(rows):
    return [r.ord for r in rows.orderBy("rank").collect()]


@pytest.mark.parametrize(
    ("text", "exts", "rest"),
    [("dir:lake swim", (), "dir:lake swim"), ("tide ext:GPX ext:.kml chart", ("gpx", "kml"), "tide chart"), ("smaller:tiny kind:poem larger:9xb changed:ago salt", (), "smaller:tiny kind:poem larger:9xb changed:ago salt"), ("low   tide", (), "low   tide"), ("ext: low   tide", (), "ext: low   tide"), ("ext:gpx low   tide", ("gpx",), "low tide")],
)
def test_filter_tokens(text, exts, rest):
    filters, left = parse_filters(text, NOW)
    assert (filters.exts, left) == (exts, rest)


def test_filter_values():
    f, rest = parse_filters("harbour kind:video larger:30kb changed:2w smaller:4mb wall", NOW + 400_000)
    assert (f.changed_after, f.min_size, f.max_size, rest) == (NOW + 400_000 - 1_209_600, 30_000, 4_000_000, "harbour wall") and "mkv" in f.exts and "png" not in f.exts
    assert parse_size("1.5kb") == 1500 and parse_size("nan") is None and parse_size("-1") is None and parse_size("inf") == (1 << 63) - 1
    assert parse_filters("changed:-1d x", NOW)[0].changed_after == NOW + 86_400 and parse_filters("path:Tide path:PIER gauge", NOW)[0].path_terms == ("tide", "pier")


@pytest.mark.parametrize(
    ("text", "options", "mode", "pattern"),
    [(">  low tide ", {}, "content", "low tide "), (">pier", {"regex": True}, "content", "pier"), (">", {"regex": True}, "content", ""), ("=7%4", {}, "calc", "7%4"), ("= ", {}, "calc", ""), ("?where the tide turns", {}, "semantic", "where the tide turns"), ("=7%4", {"script": True}, "fuzzy", "=7%4"), ("> pier", {"lines": True}, "fuzzy", "> pier"), ("?pier", {"lines": True, "regex": True}, "regex", "?pier"), ("pier", {"regex": True, "script": True}, "fuzzy", "pier")],
)
def test_modes(text, options, mode, pattern):
    request = parse(text, NOW, **options)
    assert (request.mode, request.pattern) == (mode, pattern)


def test_calculator():
    good = {"6*7-2": "40", "6*(7-2)": "30", "17%5": "2", "9/4": "2.25", "3^1^5": "3", "-5^2": "-25", "(-5)^2": "25", ".25*8": "2", "---6": "-6", "2/3": "0.6666666667", "-9%4": "-1", "4^-1": "0.25", " 8 + 9 ": "17", "2*-3*4": "-24", "2^-2+1": "1.25", "-" * 301 + "4": "-4", "(" * 900 + "5" + ")" * 900: "5"}
    assert {k: shown(evaluate(k)) for k in good} == good
    assert all(evaluate(x) is None for x in ("5 -", "pi", "3/0", "", "4 4", "(8", ".", "+6", "2e3", "9^999", "()", "7)", "٣+1", "3(4)"))


def test_ranking_cases(spark):
    def found(paths, query, **options):
        return ids(rank.filename_search(index(spark, paths), parse(query, NOW, regex=options.pop("regex", False)), **options))

    assert found(["/p", "/q", "/r", "/s"], "", limit=3) == [0, 1, 2]
    assert found(["/home/lib/under/most/paths/x.csv", "/home/our-lump.csv"], "lump")[0] == 1
    both = ["/w/NOTICE.txt", "/w/notice-old.txt"]
    assert len(found(both, "notice")) == 2 and found(both, "NOTICE") == [0]
    assert found(["/t/scan_17.png", "/t/scan.gif", "/u/17.png"], r"scan_\d+\.png$", regex=True) == [0]
    four = ["/k/m.csv", "/k/m.log", "/k/in/", "/z/n.csv"]
    assert found(four, "ext:csv path:k") == [0] and found(four, "dir:") == [2] and found(four, "") == [0, 1, 3]
    assert found(["/v/harbour.doc", "/v/harb_our.doc"], "harbour") == [0, 1] and found(["/v/harbour.doc", "/v/harb_our.doc"], "'harbour") == [0]
    assert found(["/harbour/old/names.csv", "/else/harbour.doc"], "harbour")[0] == 1
    boosts = spark.createDataFrame([("/w/plan-2.txt", 50)], "path string, boost int")
    pair = ["/w/plan-1.txt", "/w/plan-2.txt"]
    assert found(pair, "plan", boosts=boosts)[0] == 1 and found(pair, "", boosts=boosts) == [1, 0] and found(pair, "plan", boosts=boosts, regex=True) == [1, 0]
    assert found(["/x/a.txt"], "!a") == [] and found(["/x/b.txt", "/x/c.md"], "b$ ^/x") == [] and found(["/x/b.txt", "/x/c.md"], ".md$ ^/x") == [1]


def test_strong_part_and_quiet_places(spark):
    """Rows of quiet places score two fifths and stand behind the fold, unless the query names a path or there are no others."""

    def graded(paths, query, **options):
        return [(r.ord, r.is_strong) for r in rank.filename_search(index(spark, paths), parse(query, NOW), **options).orderBy("rank").collect()]

    tides = ["/sea/.old/tide-table.csv", "/sea/charts/tide-table.csv", "/sea/Library/tide-table.csv", "/sea/charts/tide-table-2.csv"]
    found = graded(tides, "tidetable")
    assert [k for k, strong in found if strong] == [1, 3] and {k for k, strong in found if not strong} == {0, 2}
    assert dict(graded(tides, "sea/tide")) == dict.fromkeys(range(4), True)
    assert all(strong for _, strong in graded(tides[::2], "tidetable"))
    assert dict(graded(tides, "tidetable", quiet_patterns=("charts",))) == {0: True, 1: False, 2: True, 3: False}
    assert graded(tides, "") == [(1, True), (3, True), (0, False), (2, False)]
    scattered = [f"/t{k}/i{k}/d{k}/e{k}/t{k}a{k}b/l{k}e.csv" for k in range(40)]
    found = graded([*scattered, "/tidetable", "/a/tidetable.csv", "/a/b/my-tidetable"], "tidetable")
    assert {k for k, _ in found[:3]} == {40, 41, 42} and sum(strong for _, strong in found) == rank.MIN_KEEP and len(found) == 43
    strong, every = script_search(spark, Corpus(index(spark, tides[:1])), "", NOW)
    assert strong.count() == 0 and every.count() == 1


def test_one_pass_equals_ranking_of_scored_rows(spark):
    r = random.Random(11)
    paths = [r.choice(["/w/", "/w/.hid/", "/Library/"]) + "".join(r.choice("abcé/_") for _ in range(r.randint(1, 9))) + "x" for _ in range(400)]
    rows = index(spark, paths).repartition(9)
    boosts = spark.createDataFrame([(p, 7 * k) for k, p in enumerate(sorted(set(paths))[::5])], "path string, boost int")
    columns = ["rank", "ord", "path", "score", "is_strong", "recent_open"]
    for query, limit, demote in (("ab", 7, True), ("ab", 7, False), ("a b", 500, True), ("zzz", 500, True), ("x$", 30, True), ("é", 500, False)):
        total = F.expr("score + coalesce(boost, 0)")
        graded = rank.boosted(rank.scored(rows, query), boosts).withColumn("is_quiet", quiet(rank.QUIET))
        graded = graded.withColumn("score", F.when(F.col("is_quiet") & F.lit(demote), F.floor(total * 2 / 5)).otherwise(total))
        want = rank.strong_part(graded, demote=demote, limit=limit).withColumn("recent_open", F.col("boost").isNotNull())
        found = rank.fuzzy_ranked(rows, query, boosts=boosts, demote=demote, limit=limit)
        assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow graded") == 1


def test_changes_of_few_and_many_paths(spark, monkeypatch):
    rows = index(spark, ["/a/b/c.txt", "/a/b", "/a/bc.txt", "/a/b/d/e.txt", "/f/", "/f/g.txt", "/fg.txt", "/h"])
    for few in (1000, 0):
        monkeypatch.setattr(changes, "FEW", few)
        left = lambda *gone: sorted(r.path for r in changes.without(rows, spark.createDataFrame([(g,) for g in gone], "path string")).collect())
        assert left("/a/b/", "/h") == ["/a/bc.txt", "/f/", "/f/g.txt", "/fg.txt"]
        assert left("/f") == ["/a/b", "/a/b/c.txt", "/a/b/d/e.txt", "/a/bc.txt", "/fg.txt", "/h"]
        assert len(left(None, "/none")) == len(left()) == 8 and left("/") == []


def brute_score(text, pattern, bonus):
    best = {}

    def at(j, i):
        if (j, i) not in best:
            if text[i] != pattern[j]:
                best[j, i] = -math.inf
            elif j == 0:
                best[j, i] = fuzzy.MATCH + 2 * bonus[i]
            else:
                best[j, i] = max([at(j - 1, k) + fuzzy.MATCH + (max(bonus[i], fuzzy.CONSECUTIVE) if k == i - 1 else bonus[i] - fuzzy.OPEN - fuzzy.EXTEND * (i - k - 2)) for k in range(i)], default=-math.inf)
        return best[j, i]

    return max((at(len(pattern) - 1, i) for i in range(len(text))), default=-math.inf)


def test_scorer_equals_brute_force():
    r = random.Random(6)
    for _ in range(150):
        texts = ["".join(r.choice("abAB/_-1é") for _ in range(r.randint(0, 12))) for _ in range(6)]
        pattern = "".join(r.choice("ab1/é") for _ in range(r.randint(1, 4)))
        bonus = fuzzy.bonuses(texts)
        want = [brute_score(t.lower(), pattern, bonus[k].tolist()) for k, t in enumerate(texts)]
        assert fuzzy.scores(texts, pattern).tolist() == [-1 if w == -math.inf else w for w in want]
    assert fuzzy.positions("/pier/low-tide.gpx", "tide") == [10, 11, 12, 13] and fuzzy.positions("pier", "tide") == []


def test_patterns():
    for bad in ("[unclosed", "(?=x)", r"(a)\1", "a++", "(?<!x)y"):
        with pytest.raises(InvalidPattern):
            java_pattern(bad)
    assert java_pattern("ab") == "(?iu)ab" and java_pattern("Ab") == "Ab" and java_pattern(r"\\1") == r"(?iu)\\1"


def test_pattern_dialect(spark):
    for bad in ("x{,3}", "[+--]", r"\Qa\E", "(?>a)", "[[:letters:]]", "\\"):
        with pytest.raises(InvalidPattern):
            java_pattern(bad)
    rows = spark.createDataFrame([(x,) for x in ("naïve 7", "tab\there", "Ωmega", "a]b", "+*", "x\ry", "٣")], "path string")

    def matched(pattern):
        return [r.path for r in rows.where(F.col("path").rlike(java_pattern(pattern))).collect()]

    assert matched(r"^\w+ \d$") == ["naïve 7"] and matched("(?P<sign_1>[*+])[*]$") == ["+*"] and matched("[]]b") == ["a]b"]
    assert matched(r"\p{Greek}") == ["Ωmega"] and matched("[[:space:]]h") == ["tab\there"] and matched("x.y") == ["x\ry"]
    assert matched(r"^\pL{2}[[:^alpha:]]v") == ["naïve 7"] and matched(r"^\d$") == ["٣"] and matched("[[:digit:]]") == ["naïve 7"]


def test_accents_and_escapes(spark):
    paths = ["/a/résumé.pdf", "/a/resume.pdf", "/a/RÉSUMÉ.txt", "/b/!keep/cost$", "/b/two words", "/b/^up"]

    def found(query):
        return sorted(ids(rank.filename_search(index(spark, paths), parse(query, NOW))))

    assert found("resume") == found("'resume") == [0, 1, 2] and found("résumé") == [0, 2] and found("RESUME") == [2]
    assert found("!resume") == [3, 4, 5] and found(r"\!keep") == [3] and found(r"cost\$") == [3] and found(r"'two\ w") == [4] and found(r"\^up") == [5]
    assert found("resume.pdf$") == [0, 1] and fuzzy.positions("/a/résumé.pdf", "resume") == [3, 4, 5, 6, 7, 8]
    assert [a.kind for a in fuzzy.atoms("'x$ !x !x$ ^x")] == ["whole", "exact", "suffix", "prefix"]


def test_whole_texts_are_filtered_before_lines(spark):
    texts = ["", "\n", "ab\r\ncd", "ab\n\n\n", "x\nab", "abc"]
    rows = spark.createDataFrame([(f"/{k}.txt", 0, 1, t) for k, t in enumerate(texts)], "path string, mtime long, size long, text string")

    def lines(pattern):
        return {(r.path, r.line_number) for r in content.grep(rows, pattern).collect()}

    assert lines("ab$") == {("/2.txt", 1), ("/3.txt", 1), ("/4.txt", 2)} and lines("^$") == {("/1.txt", 1), ("/3.txt", 2), ("/3.txt", 3)}
    assert lines("^c") == {("/2.txt", 2)} and lines("b[^x]c") == set()
    assert "(?ium)" in content._hits(rows, "swell", parse("", NOW).filters, 20, 1 << 20)._jdf.queryExecution().optimizedPlan().toString()


def test_content(spark):
    """Numbered lines in index order, at most twenty a file; folders, null texts, large and binary files are left out, extracted documents aren't."""
    kind = "path string, mtime long, size long, text string"
    texts = [
        ("/log/monday", 3, 50, "calm\n\nSwell from the west\t \ncalm again\r\nswell\r\n"), ("/log/tuesday", 2, 50, "swell, swell and SWELL"), ("/log/raw", 9, 50, "\0swell"), ("/log/huge", 9, 2000, "swell"),
        ("/log/chart.PDF", 1, 2000, "of the swell"), ("/log/week", 5, 50, "".join(f"swell {k}\n" for k in range(55))), ("/log/swell/", 9, 0, "swell"), ("/log/unread", 9, 50, None),
    ]
    rows = spark.createDataFrame(texts, kind)
    found = [tuple(r) for r in content.grep(rows, "swell", max_bytes=1999).collect()]
    assert found == [*(("/log/week", k + 1, f"swell {k}") for k in range(20)), ("/log/monday", 3, "Swell from the west"), ("/log/monday", 5, "swell"), ("/log/tuesday", 1, "swell, swell and SWELL"), ("/log/chart.PDF", 1, "of the swell")]
    assert [tuple(r)[:2] for r in content.grep(rows, "SWELL", max_bytes=1999).collect()] == [("/log/tuesday", 1)]
    assert [r.line for r in content.grep(rows, "swell", limit=2, max_bytes=1999).collect()] == ["swell 0", "swell 1"]
    assert content.line_numbers(rows.where("path = '/log/monday'")).count() == 5


def test_size_bound_of_line_search_comes_with_the_corpus(spark):
    texts = spark.createDataFrame([("/big.txt", 0, 50, "swell"), ("/small.txt", 0, 6, "swell")], "path string, mtime long, size long, text string")
    hits = lambda most: {r.path for r in script_search(spark, Corpus(texts, texts, max_bytes=most), "> swell", NOW)[0].collect()}
    assert hits(10) == {"/small.txt"} and hits(50) == {"/big.txt", "/small.txt"}


def test_history(spark):
    lines = spark.createDataFrame([(x,) for x in ("100\t1\t/a\tb", "x\t1\t/c", "5\t2", "", "200\t3\t/a\tb", "1\t-1\t/z")], "value string")
    opens = history.parsed(lines)
    assert [tuple(r) for r in history.compacted(opens).collect()] == [(200, 4, "/a\tb")]
    ages = [(NOW - 1800, 48), (NOW - 5 * 3600, 40), (NOW - 3 * 86_400, 28), (NOW - 60 * 86_400, 16), (NOW + 99, 48)]
    got = history.boosts(spark.createDataFrame([(ts, 1, f"/{k}") for k, (ts, _) in enumerate(ages)], "ts long, count long, path string"), NOW)
    assert {r.path: r.boost for r in got.collect()} == {f"/{k}": b + 4 for k, (_, b) in enumerate(ages)}
    queries = spark.createDataFrame(list(enumerate(["alpha", "beta", "alpha", " "])), "seq long, q string")
    assert [r.q for r in history.last_queries(queries).collect()] == ["beta", "alpha"]


def test_chunks_keep_their_rules():
    """Windows are found again in the text by their line and content; each rule is checked on its own."""
    r = random.Random(8)
    for size, target, overlap in [(0, 9, 2), (5, 9, 2), (300, 20, 6), (300, 40, 0), (2600, 1000, 200), (900, 33, 32), (50, 1, 0), (400, 0, 5)]:
        text = "".join(r.choice("xy.\n ") for _ in range(size))
        found = semantic.cut_chunks(text, target, overlap)
        covered, at = set(), -1
        for line, window in found:
            begins = [k for k in range(at + 1, len(text)) if text.startswith(window, k) and 1 + text.count("\n", 0, k) == line]
            at = begins[0]
            end = at + len(window)
            covered |= set(range(at, end))
            assert 0 < len(window) <= target and window.strip()
            assert end == len(text) or len(window) == target or window.endswith("\n") and len(window) > target * 3 // 4
        assert target == 0 or all(text[k].isspace() for k in range(len(text)) if k not in covered)
    text = "\n".join("line %d of a text" % k for k in range(400))
    windows = semantic.cut_chunks(text)
    assert all(w.endswith("\n") for _, w in windows[:-1]) and all(a[-semantic.OVERLAP :] == b[: semantic.OVERLAP] for (_, a), (_, b) in zip(windows, windows[1:]))
    kept = semantic.kept_chunks(1000)
    assert len(set(kept)) == 256 and kept[0] == 0 and kept[-1] == 999


def test_lines_of_a_text_that_ends_in_blank_ones(spark):
    texts = spark.createDataFrame([("/a.txt", 0, 9, 0, "a\n\n\nb\n\n\n"), ("/b.txt", 0, 9, 1, "no\r\nyes it is\r\n"), ("/c.txt", 0, 9, 2, "x" * (70 << 10) + "\nyes\n\0yes\n")], "path string, mtime long, size long, ord long, text string")
    hits = lambda pattern: [(h.path, h.line_number) for h in content.grep(texts, pattern).collect()]
    assert [n for p, n in hits("^$") if p == "/a.txt"] == [2, 3, 5, 6]
    assert hits("yes$") == [("/c.txt", 2)] and hits("^yes") == [("/b.txt", 2), ("/c.txt", 2)] and hits("is$") == [("/b.txt", 2)]
    assert content.whole_text_pattern(r"\Ayes") is None and content.whole_text_pattern("(?i)a") == "(?im)a"


def test_semantic_build_and_search(spark):
    notes = {"/n/boats.txt": "oars and sails\nmend the sails before the oars", "/n/bread.org": "flour yeast salt", "/n/blank.txt": "\n \t", "/n/oars.py": "oars = 2", "/n/soup.html": "salt leek and barley"}
    texts = spark.createDataFrame([(p, 4, len(t), t) for p, t in notes.items()], "path string, mtime long, size long, text string")
    chunks, counts = semantic.built(texts)
    assert {r.status: r["count"] for r in counts.collect()} == {"embedded": 3, "skipped": 1}
    chunks = chunks.cache()
    best = lambda query: [r.path for r in plan(spark, Corpus(texts, texts, chunks), parse(query, NOW)).orderBy("rank").collect()]
    assert best("?sails oars")[0] == "/n/boats.txt" and best("? yeast")[0] == "/n/bread.org" and set(best("? leek")) == {"/n/boats.txt", "/n/bread.org", "/n/soup.html"}
    changed = texts.where("path <> '/n/blank.txt'").withColumn("mtime", F.when(F.col("path") == "/n/soup.html", 5).otherwise(F.col("mtime")))
    _, again = semantic.built(changed, chunks)
    assert {r.status: r["count"] for r in again.collect()} == {"embedded": 1, "reused": 2}
    assert semantic.best_chunks(chunks, [0.5] * 63).count() == 0


def test_lines_and_calc_modes(spark):
    lines = index(spark, ["oar, left", "sail", "oar, right", "> oar"])
    assert ids(filter_lines(spark, lines, "oar,", NOW)) == [0, 2] and ids(filter_lines(spark, lines, "> oar", NOW)) == [3] and ids(filter_lines(spark, lines, "", NOW)) == [0, 1, 2, 3]
    shown_for = lambda text: [tuple(r) for r in plan(spark, Corpus(lines), parse(text, NOW)).collect()]
    assert shown_for("= 9-4*2") == [("9-4*2", "1")] and shown_for("=oar") == []


def test_excludes():
    import re

    p = re.compile(exclude_regex(["node_modules", "Library/Caches", "*.tmp"]))
    assert all(p.match(x) for x in ("/a/node_modules/", "/a/node_modules/x/y.js", "/u/Library/Caches/z", "/x/a.tmp")) and not p.match("/a/node_modules2/x")
    with pytest.raises(ValueError):
        exclude_regex(["a[b"])


def test_plans(spark, tmp_path):
    index(spark, [f"/f{k}.md" for k in range(9)]).write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")

    def text(rows):
        return rows._jdf.queryExecution().executedPlan().toString()

    big = text(rank.big_files(files))
    assert "TakeOrderedAndProject" in big and "CartesianProduct" not in big
    scoped = text(files.where(predicate(parse("larger:1kb changed:1d", NOW).filters)))
    assert "GreaterThanOrEqual(size,1000)" in scoped and "GreaterThanOrEqual(mtime" in scoped
    scored = text(rank.scored(files.where("size > 3"), "fmd"))
    assert scored.count("ArrowEvalPython") == 1 and "GreaterThan(size,3)" in scored  # native filters run below the scorer
    assert "ReadSchema: struct<size:bigint>" in text(files.agg(F.sum("size")))


def test_registered_functions(spark):
    from pathloom.functions.register import register

    register(spark)
    row = spark.sql("SELECT calc_eval('2^3^2') AS a, fuzzy_score('/pier/low-tide.gpx', 'tide') > 0 AS b, match_positions('/pier/low-tide.gpx', 'tide') AS c, size(chunk_text('x')) AS d, extract_text('a.txt', cast('hi' AS binary)) AS e, extract_text('a.pdf', cast('hi' AS binary)) AS f").first()
    assert tuple(row) == ("512", True, [10, 11, 12, 13], 1, "hi", None)


def test_hash_vectors_split_a_text_once(spark):
    column = semantic.hash_vector(F.col("text"))
    assert str(column).count("split(") == 1
    rows = spark.createDataFrame([("a b A",), ("",), (None,)], "text string").select(column.alias("v")).collect()
    assert sorted(x for x in rows[0].v if x) == [pytest.approx(1 / 5**0.5), pytest.approx(2 / 5**0.5)] and len(rows[0].v) == 64
    assert rows[1].v == rows[2].v == [0.0] * 64
