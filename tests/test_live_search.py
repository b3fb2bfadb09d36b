"""Early stop of line search, hits as they are found, the newest query only."""

import threading
import time

import pytest
from pathloom.operators import content
from pathloom.plans.search import Corpus, plan
from pathloom.request import parse
from pathloom.session import LiveSearch, SearchSession
from pyspark.sql import functions as F

NOW = 1_706_745_600


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """2 000 files in index order over many Parquet files, each with a common word, some with a rare one."""
    folder = str(tmp_path_factory.mktemp("texts") / "t")
    body = F.concat(F.lit("first line\nthe common word here\n"), F.when(F.col("id") % 400 == 399, "a rarity\n").otherwise(""), F.lit("common again\n"))
    rows = spark.range(2000).select(F.format_string("/t/file-%04d.%s", "id", F.when(F.col("id") % 2 == 0, "txt").otherwise("md")).alias("path"), (9000 - F.floor(F.col("id") / 3)).alias("mtime"), F.lit(60).cast("long").alias("size"), F.col("id").alias("ord"), body.alias("text"))
    rows.repartitionByRange(16, "ord").sortWithinPartitions("ord").write.parquet(folder)
    return spark.read.parquet(folder)


def as_tuples(df):
    return [tuple(r) for r in df.select("path", "line_number", "line").collect()]


@pytest.mark.parametrize("ordinals", [True, False])
@pytest.mark.parametrize(("pattern", "filters", "limit"), [("common", "", 100), ("rarity", "", 3), ("rarity", "", 99), ("common", "ext:md ", 70), ("absent", "", 5)])
def test_first_hits_are_those_of_the_whole_search(texts, ordinals, pattern, filters, limit):
    rows = texts if ordinals else texts.drop("ord")
    request = parse(f"> {filters}{pattern}", NOW)
    want = as_tuples(content.grep(rows, request.pattern, request.filters))[:limit]
    assert as_tuples(content.grep(rows, request.pattern, request.filters, limit=limit)) == want
    pieces = list(content.first_hits(rows, request.pattern, request.filters, limit=limit))
    assert [p.hits for p in pieces] == sorted(p.hits for p in pieces) and pieces[-1].hits == len(want)
    assert all(p.files == (1000 if filters else 2000) for p in pieces)
    if pattern == "common":  # a common word reads a small, counted share
        assert pieces[-1].files_read <= 0.1 * 2000
    if pattern == "absent":
        assert len(pieces) == 4 and pieces[-1].files_read == 2000


def test_stretches_are_ranges_that_scans_skip_by(texts):
    stretches, _ = content._stretches(texts, content.SHARES)
    plan_text = texts.where(stretches[1])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" not in plan_text and "GreaterThan(ord" in plan_text and "LessThanOrEqual(ord" in plan_text


def test_first_hits_of_no_or_timeless_files(spark, texts):
    kind = "path string, mtime long, size long, text string"
    assert content.grep(spark.createDataFrame([], kind), "x", limit=5).collect() == []
    rows = spark.createDataFrame([("/b", None, 1, "x"), ("/a", None, 1, "x"), ("/c", 5, 1, "x")], kind)
    assert [r.path for r in content.grep(rows, "x", limit=9).collect()] == ["/c", "/a", "/b"]
    assert as_tuples(plan(spark, Corpus(texts, texts), parse("> common", NOW), content_limit=5)) == as_tuples(content.grep(texts, "common"))[:5]


def test_a_reader_that_stops_starts_no_further_job(texts):
    began = content.first_hits(texts, "absent")
    first = next(began)
    assert first.files_read < 100 and first.files == 2000
    began.close()


def test_hits_of_a_stale_query_end(spark, texts):
    session = SearchSession(spark, Corpus(texts, texts))
    found = session.hits("> common")
    assert next(found).line == "the common word here"
    session.search("anything")
    assert list(found) == []
    assert [r.rank for r in session.hits("file-0007")][:1] == [1]


def test_only_the_newest_text_is_searched(spark, texts):
    shown, failed, done = [], [], threading.Event()

    def show(text, rows):
        shown.append((text, len(rows)))
        done.set()

    live = LiveSearch(SearchSession(spark, Corpus(texts, texts)), show, lambda text, e: (failed.append(text), done.set()))
    began = time.monotonic()
    for text in ("> r", "> ra", "> rari", "> rarity"):
        live.submit(text)
        time.sleep(0.02)
    assert done.wait(60) and time.monotonic() - began >= 0.3
    assert live.started == ["> rarity"] and shown[-1] == ("> rarity", 5) and not failed
    done.clear()
    live.submit("> [x")
    assert done.wait(60) and failed == ["> [x"]
    done.clear()
    live.submit("file-1999")
    assert done.wait(60) and shown[-1] == ("file-1999", 1)
    live.close()
