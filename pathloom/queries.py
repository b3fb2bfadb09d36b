"""The registered queries of the engine over the test tables, and their SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import columns as fn
from .functions.calc import shown_values
from .functions.fuzzy import Atom
from .operators import changes, content, history, rank, semantic
from .operators.predicates import atom_predicate, predicate, quiet
from .plans.search import Corpus, filter_lines, script_search
from .request import Filters, parse
from .schema import FILES_SQL, NOW
from .sources.documents import extracted, packed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FILES = f"WITH files AS ({FILES_SQL}), dirs AS (SELECT regexp_extract(path, '^(.*/)[^/]+$', 1) AS path, max(mtime) AS mtime, 0::BIGINT AS size FROM files GROUP BY 1), index AS (SELECT path, mtime, size FROM files UNION ALL SELECT * FROM dirs), loud AS (SELECT * FROM index WHERE NOT path LIKE '%/')"
OPENS = "opens AS (SELECT floor(epoch(ts))::BIGINT AS ts, 1::BIGINT AS n, path FROM events JOIN files ON user_id = doc_id WHERE event_type = 'view'), boosts AS (SELECT path, (CASE WHEN {now} - max(ts) < 3600 THEN 48 WHEN {now} - max(ts) < 86400 THEN 40 WHEN {now} - max(ts) < 604800 THEN 28 ELSE 16 END + least(sum(n), 10) * 4)::INT AS boost FROM opens GROUP BY path)".replace("{now}", str(NOW))
QUIET_SQL = "(contains(path, '/Library/') OR contains(path, '/.'))"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _index(spark: SparkSession, d: str) -> DataFrame:
    return schema.with_dirs(schema.files(spark, d))


def _boosts(spark: SparkSession, d: str) -> DataFrame:
    return history.boosts(schema.opens(spark, d), NOW)


def _filtered(text: str, where: str) -> None:
    """A filter query of its own name and SQL."""
    name, words = text.split("|")

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _index(spark, d).where(predicate(parse(words, NOW).filters)).select("path", "mtime", "size")

    run.__name__ = name
    query(f"{FILES} SELECT path, mtime, size FROM index WHERE {where}")(run)


EXT = "lower(regexp_extract(path, '\\.([^./]*)$', 1))"
_filtered("filter_ext|ext:md ext:.RS", f"NOT path LIKE '%/' AND {EXT} IN ('md', 'rs')")
_filtered("filter_kind|kind:image kind:archive", f"NOT path LIKE '%/' AND {EXT} IN ('png', 'zip')")
_filtered("filter_path|path:SRC1 path:/de/", "NOT path LIKE '%/' AND contains(path, 'src1') AND contains(path, '/de/')")
_filtered("filter_changed|changed:8w", f"NOT path LIKE '%/' AND mtime >= {NOW} - 8 * 604800")
_filtered("filter_size|larger:1kb smaller:2.5kb", "NOT path LIKE '%/' AND size BETWEEN 1000 AND 2500")
_filtered("filter_combo|kind:doc larger:1kb changed:9w path:en", f"NOT path LIKE '%/' AND {EXT} IN ('txt', 'md', 'pdf', 'docx') AND size >= 1000 AND mtime >= {NOW} - 9 * 604800 AND contains(path, 'en')")
_filtered("filter_dirs|dir: path:src1", "path LIKE '%/' AND contains(path, 'src1')")


@query(f"{FILES} SELECT row_number() OVER (ORDER BY size DESC, mtime DESC, path) AS rank, path, size FROM loud QUALIFY rank <= 20")
def big_files(spark: SparkSession, d: str) -> DataFrame:
    return rank.big_files(_index(spark, d)).select("rank", "path", "size")


@query(f"{FILES} SELECT row_number() OVER (ORDER BY mtime DESC, path) AS rank, path FROM loud WHERE regexp_matches(path, '(?i)src1\\d/doc-\\d+\\.(md|rs)$') QUALIFY rank <= 500")
def regex_path(spark: SparkSession, d: str) -> DataFrame:
    return rank.filename_search(_index(spark, d), parse(r"src1\d/doc-\d+\.(md|rs)$", NOW, regex=True)).select("rank", "path")


@query(f"{FILES}, {OPENS} SELECT row_number() OVER (ORDER BY coalesce(boost, 0) DESC, mtime DESC, path) AS rank, path, boost, boost IS NOT NULL AS recent_open FROM loud LEFT JOIN boosts USING (path) WHERE regexp_matches(path, 'doc-\\d*7\\.') QUALIFY rank <= 500")
def regex_path_boosted(spark: SparkSession, d: str) -> DataFrame:
    return rank.regex_ranked(_index(spark, d).where(predicate(Filters())), r"doc-\d*7\.", boosts=_boosts(spark, d)).select("rank", "path", "boost", "recent_open")


HEAD = "row_number() OVER (ORDER BY bucket, CASE WHEN bucket = 0 THEN boost END DESC NULLS LAST, mtime DESC, path) AS rank, path, bucket < 2 AS is_strong"


@query(f"{FILES}, b AS (SELECT *, NULL AS boost, CASE WHEN {QUIET_SQL} THEN 2 ELSE 1 END AS bucket FROM loud) SELECT {HEAD} FROM b QUALIFY rank <= 500")
def head_empty_query(spark: SparkSession, d: str) -> DataFrame:
    return rank.head(_index(spark, d).where(predicate(Filters()))).select("rank", "path", "is_strong")


BOOSTED_HEAD = f"{FILES}, {OPENS}, b AS (SELECT loud.*, boost, CASE WHEN boost IS NOT NULL THEN 0 WHEN {QUIET_SQL} THEN 2 ELSE 1 END AS bucket FROM loud LEFT JOIN boosts USING (path))"


@query(f"{BOOSTED_HEAD} SELECT {HEAD}, boost FROM b QUALIFY rank <= 500")
def head_quiet_boosted(spark: SparkSession, d: str) -> DataFrame:
    return rank.filename_search(_index(spark, d), parse("", NOW), boosts=_boosts(spark, d)).select("rank", "path", "is_strong", "boost")


@query(f"{BOOSTED_HEAD}, h AS (SELECT {HEAD}, boost FROM b QUALIFY rank <= 200) SELECT rank, path, CASE WHEN min((boost IS NOT NULL)::INT) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) = 1 THEN 'recent opens' ELSE 'recently modified' END AS section FROM h")
def launch_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = rank.filename_search(_index(spark, d), parse("", NOW), boosts=_boosts(spark, d), limit=200)
    return rank.launch_sections(rows).select("rank", "path", "section")


def _atom(name: str, atom: Atom, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _index(spark, d).where(predicate(Filters()) & atom_predicate(atom)).select("path")

    run.__name__ = name
    query(f"{FILES} SELECT path FROM loud WHERE {where}")(run)


_atom("atom_exact", Atom("src1", "exact"), "contains(path, 'src1')")
_atom("atom_prefix", Atom("/home/de", "prefix"), "starts_with(path, '/home/de')")
_atom("atom_suffix", Atom("7.rs", "suffix"), "ends_with(path, '7.rs')")
_atom("atom_exclude", Atom("/en/", "exact", negative=True), "NOT contains(path, '/en/')")
_atom("fuzzy_match_set", Atom("hes9m"), "regexp_matches(path, 'h.*e.*s.*9.*m')")


@query()
def fuzzy_ranked(spark: SparkSession, d: str) -> DataFrame:
    rows = rank.filename_search(_index(spark, d), parse("src9 doc", NOW), boosts=_boosts(spark, d))
    return rows.select("rank", "path", "score", "is_strong", "recent_open")


@query()
def fuzzy_strong(spark: SparkSession, d: str) -> DataFrame:
    return script_search(spark, Corpus(_index(spark, d)), "ext:md doc1 !src2", NOW)[0].select("rank", "path", "score")


@query(
    f"""{FILES}, s AS (SELECT path, mtime, CASE WHEN {QUIET_SQL} THEN (doc_id * 37 % 500) * 2 // 5 ELSE doc_id * 37 % 500 END AS score, {QUIET_SQL} AS is_quiet FROM files),
    f AS (SELECT count(*) AS n, count(*) FILTER (NOT is_quiet) AS loud, max(score) AS best, max(score) FILTER (NOT is_quiet) AS loud_best FROM s),
    g AS (SELECT loud > 0 AND loud < n AS mixed, CASE WHEN loud > 0 AND loud < n THEN loud ELSE n END AS block, (CASE WHEN loud > 0 AND loud < n THEN loud_best ELSE best END) // 2 AS low FROM f),
    c AS (SELECT greatest(count(*) FILTER ((NOT mixed OR NOT is_quiet) AND score >= low), least(8, any_value(block))) AS strong FROM s, g)
    SELECT row_number() OVER (ORDER BY is_quiet, score DESC, mtime DESC, path) AS rank, path, score, rank <= (SELECT strong FROM c) AS is_strong FROM s QUALIFY rank <= 500"""
)
def fuzzy_floor_given_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = schema.files(spark, d).withColumn("is_quiet", quiet())
    raw = F.col("doc_id") * 37 % 500
    rows = rows.withColumn("score", F.when(F.col("is_quiet"), F.expr("(doc_id * 37 % 500) * 2 div 5")).otherwise(raw))
    return rank.strong_part(rows).select("rank", "path", "score", "is_strong")


def _grep_sql(pattern: str, where: str = "true", limit: str = "") -> str:
    texts = FILES_SQL.replace("doc_id,\n", "doc_id, text,\n", 1)
    return f"""WITH texts AS (SELECT path, mtime, size, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS parts FROM ({texts}) WHERE text IS NOT NULL AND size <= 2097152 AND {where}),
    l AS (SELECT path, mtime, unnest(range(1, len(parts) + 1)) AS line_number, unnest(parts) AS line FROM texts),
    m AS (SELECT * FROM l WHERE regexp_matches(line, '{pattern}') QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_number) <= 20)
    SELECT path, line_number, regexp_replace(line, '\\s+$', '') AS line FROM m {limit}"""


@query(_grep_sql("(?i)\\bth(e|at) an[a-z]+\\b"))
def content_grep(spark: SparkSession, d: str) -> DataFrame:
    return content.grep(schema.doc_text(spark, d), r"\bth(e|at) an[a-z]+\b")


@query(_grep_sql("(?i)tion of", f"{EXT} IN ('md', 'txt') AND size >= 1000"))
def content_grep_scoped(spark: SparkSession, d: str) -> DataFrame:
    request = parse("> ext:md ext:txt larger:1kb tion of", NOW)
    return content.grep(schema.doc_text(spark, d), request.pattern, request.filters)


@query(_grep_sql("(?i)e"))
def content_cap20(spark: SparkSession, d: str) -> DataFrame:
    return content.grep(schema.doc_text(spark, d), "e")


@query(_grep_sql("The", limit="ORDER BY mtime DESC, path, line_number LIMIT 1000"))
def content_limit1000(spark: SparkSession, d: str) -> DataFrame:
    return content.grep(schema.doc_text(spark, d), "The", limit=content.CONTENT_LIMIT)


@query(f"{FILES}, {OPENS} SELECT path, boost FROM boosts")
def frecency_boosts(spark: SparkSession, d: str) -> DataFrame:
    return _boosts(spark, d)


@query(f"{FILES}, {OPENS} SELECT max(ts) AS ts, sum(n)::BIGINT AS count, path FROM opens GROUP BY path")
def history_compact(spark: SparkSession, d: str) -> DataFrame:
    return history.compacted(schema.opens(spark, d))


@query("SELECT seq, q FROM (SELECT max(conv_id * 10000 + turn) AS seq, text AS q FROM conversations WHERE trim(text) <> '' GROUP BY text) ORDER BY seq DESC LIMIT 100")
def query_history(spark: SparkSession, d: str) -> DataFrame:
    turns = schema.table(spark, d, "conversations").select((F.col("conv_id") * 10000 + F.col("turn")).alias("seq"), F.col("text").alias("q"))
    return history.last_queries(turns)


BEST = """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
    c AS (SELECT vec_id // 5 AS doc, vec_id % 5 AS ix, vec_id % 5 * 20 + 1 AS line_start, list_dot_product(embedding::DOUBLE[], q) AS score FROM embeddings, q WHERE embedding IS NOT NULL),
    best AS (SELECT doc, line_start, score FROM c QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, ix) = 1)"""


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(schema.chunks(spark, d).where("doc = 0 and chunk_ix = 0").first().vec)


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.round("score", 6))


@query(f"{BEST} SELECT doc, line_start, round(score, 6) AS score FROM best")
def semantic_best_chunk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(semantic.best_chunks(schema.chunks(spark, d), _query_vector(spark, d), "doc"))


@query(f"{BEST} SELECT row_number() OVER (ORDER BY score DESC, doc) AS rank, doc, line_start, round(score, 6) AS score FROM best QUALIFY rank <= 100")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(semantic.semantic_search(schema.chunks(spark, d), _query_vector(spark, d), doc="doc")).select("rank", "doc", "line_start", "score")


@query(f"{BEST}, files AS ({FILES_SQL}), t AS (SELECT best.*, path FROM best JOIN files ON doc = doc_id ORDER BY score DESC, doc LIMIT 400), f AS (SELECT * FROM t WHERE {EXT} IN ('md', 'txt', 'pdf')) SELECT row_number() OVER (ORDER BY score DESC, doc) AS rank, path, line_start, round(score, 6) AS score FROM f QUALIFY rank <= 100")
def semantic_filtered_overfetch(spark: SparkSession, d: str) -> DataFrame:
    files = schema.files(spark, d).withColumnRenamed("doc_id", "doc")
    filters = parse("? ext:md ext:txt ext:pdf x", NOW).filters
    return _rounded(semantic.semantic_search(schema.chunks(spark, d), _query_vector(spark, d), filters, files=files, doc="doc")).select("rank", "path", "line_start", "score")


@query(
    f"""{BEST}, files AS ({FILES_SQL.replace("doc_id,", "doc_id, text,", 1)}), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc) AS rank FROM best QUALIFY rank <= 100),
    s AS (SELECT rank, path, printf('%.0f', least(greatest(score, 0), 1) * 100) || '% match' AS label, regexp_replace(string_split(text, chr(10))[line_start], '^\\s+|\\s+$', '', 'g') AS snip FROM r JOIN files ON doc = doc_id)
    SELECT rank, path, CASE WHEN rank <= 24 AND coalesce(snip, '') <> '' THEN substr(snip, 1, 160) ELSE label END AS label FROM s"""
)
def semantic_labels(spark: SparkSession, d: str) -> DataFrame:
    ranked = semantic.semantic_search(schema.chunks(spark, d), _query_vector(spark, d), doc="doc")
    texts = schema.doc_text(spark, d)
    rows = ranked.join(texts.select(F.col("doc_id").alias("doc"), "path"), "doc")
    return semantic.labelled(rows, texts).select("rank", "path", "label")


@query(f"{FILES}, prior AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN mtime + 1 ELSE mtime END AS mtime, size FROM files WHERE doc_id % 5 <> 0) SELECT f.path, CASE WHEN p.path IS NULL THEN 'embedded' ELSE 'reused' END AS status FROM files f LEFT JOIN prior p ON f.path = p.path AND f.mtime = p.mtime AND f.size = p.size")
def semantic_incremental_split(spark: SparkSession, d: str) -> DataFrame:
    files = schema.files(spark, d)
    prior = files.where("doc_id % 5 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 3 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return semantic.split_for_build(files, prior).select("path", "status")


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return semantic.chunked(schema.doc_text(spark, d).select("path", "text"))


@query(
    """WITH c AS (SELECT l_suppkey AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS chunk_ix FROM lineitem),
    n AS (SELECT doc, count(*) AS n FROM c GROUP BY doc),
    k AS (SELECT DISTINCT doc, CASE WHEN n <= 256 THEN k ELSE k * (n - 1) // 255 END AS chunk_ix FROM n, (SELECT unnest(range(0, 256)) AS k) WHERE n > 256 OR k < n)
    SELECT doc, chunk_ix FROM k"""
)
def sample_chunks(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = schema.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.row_number().over(order) - 1).cast("long").alias("chunk_ix"))
    return semantic.sampled(rows, doc="doc").select("doc", "chunk_ix")


@query()
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    return semantic.embedded(schema.table(spark, d, "pages").select("page_id", F.col("url").alias("text"))).select("page_id", "vec")


@query(
    f"""{FILES}, e AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'modify' END AS kind, path FROM events JOIN files ON user_id = doc_id WHERE event_type <> 'view'),
    t AS (SELECT path, max(seq) AS seq, arg_max(kind, seq) AS kind FROM e GROUP BY path)
    SELECT path, {NOW} + seq AS mtime, seq AS size FROM t WHERE kind <> 'delete'
    UNION ALL SELECT path, mtime, size FROM index WHERE path NOT IN (SELECT path FROM t) AND NOT EXISTS (SELECT 1 FROM t WHERE starts_with(index.path, t.path || '/'))"""
)
def snapshot_fold(spark: SparkSession, d: str) -> DataFrame:
    last = changes.last_changes(schema.fs_events(spark, d))
    fronts = last.where("kind <> 'delete'").select("path", (F.lit(NOW) + F.col("seq")).alias("mtime"), F.col("seq").alias("size"))
    return changes.folded(_index(spark, d), last, fronts)


@query("SELECT row_number() OVER (ORDER BY conv_id, turn, text) AS rank, text AS path FROM conversations WHERE trim(text) <> '' AND NOT text LIKE '%/' AND regexp_matches(text, '(?i)tion.*the') QUALIFY rank <= 500")
def filter_lines_regex(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    turns = schema.lines(spark, d).where(F.trim("path") != "")
    rows = turns.withColumn("ord", F.struct("conv_id", "turn", "path")).withColumn("mtime", F.lit(0)).withColumn("size", F.lit(0))
    found = filter_lines(spark, rows, "tion.*the", NOW, regex=True).select("path", "ord")
    return found.select(F.row_number().over(Window.orderBy("ord")).cast("long").alias("rank"), "path")


@query(
    f"""{FILES} SELECT path, regexp_extract(path, '([^/]*)/*$', 1) AS name, regexp_extract(path, '^(.*?)[^/]*/?$', 1) AS parent,
    CASE WHEN path LIKE '%/' THEN 'DIR' ELSE upper({EXT}) END AS label, CASE WHEN path LIKE '%/' THEN 'DIR' ELSE substr(upper({EXT}), 1, 4) END AS badge,
    CASE {EXT} WHEN 'png' THEN 'image' WHEN 'mp4' THEN 'video' WHEN 'zip' THEN 'archive' WHEN 'rs' THEN 'code' WHEN '' THEN NULL ELSE 'doc' END AS kind,
    CASE WHEN size < 1000 THEN size || ' B' ELSE printf('%.1f KB', floor(size / 100.0 + 0.5) / 10) END AS shown_size,
    CASE WHEN {NOW} - mtime < 60 THEN 'just now' WHEN {NOW} - mtime < 3600 THEN ({NOW} - mtime) // 60 || 'm' WHEN {NOW} - mtime < 86400 THEN ({NOW} - mtime) // 3600 || 'h' ELSE ({NOW} - mtime) // 86400 || 'd' END AS age,
    CASE WHEN starts_with(path, '/home/') THEN '~' || substr(path, 6) ELSE path END AS short FROM index"""
)
def scalar_labels(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return _index(spark, d).select(
        "path", fn.basename(path).alias("name"), fn.parent(path).alias("parent"), fn.kind_label(path).alias("label"), fn.badge(path).alias("badge"), fn.kind_of(fn.extension(path)).alias("kind"),
        fn.human_size(F.col("size")).alias("shown_size"), fn.row_age(F.col("mtime"), NOW).alias("age"), fn.shorten_home(path, "/home").alias("short"),
    )


@query("SELECT l_orderkey, l_linenumber, q || '*(' || l_linenumber || '+2)-7%3^2/-4' AS expression, CASE WHEN v = floor(v) THEN (v::BIGINT)::VARCHAR ELSE v::VARCHAR END AS result FROM (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q, l_quantity::BIGINT * (l_linenumber + 2) + 7 / 4.0 AS v FROM lineitem)")
def calc_eval(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("string")
    def calc(texts: pd.Series) -> pd.Series:
        return shown_values(texts)

    q = F.col("l_quantity").cast("long").cast("string")
    rows = schema.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(q, F.lit("*("), F.col("l_linenumber").cast("string"), F.lit("+2)-7%3^2/-4")).alias("expression"))
    return rows.withColumn("result", calc("expression"))


def docx_bytes(text: str) -> bytes:
    """A minimal DOCX of a text's lines."""
    body = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@query("SELECT doc_id, text || chr(10) AS text FROM documents WHERE doc_id % 8 = 7")
def extract_docx(spark: SparkSession, d: str) -> DataFrame:
    texts = schema.doc_text(spark, d).where("doc_id % 8 = 7").select("doc_id", "path", "text")  # the adapter's .docx files
    return extracted(packed(texts, docx_bytes)).select("doc_id", "text")


@query(f"{FILES} SELECT regexp_extract(path, '([^/]*/?)$', 1) AS name, path LIKE '%/' AS is_dir FROM index WHERE regexp_extract(path, '^(.*?)[^/]*/?$', 1) = '/home/en/src1/' ORDER BY path LIKE '%/' DESC, name LIMIT 200")
def folder_listing(spark: SparkSession, d: str) -> DataFrame:
    from .sources.walk import listing

    return listing(_index(spark, d), "/home/en/src1").select("name", fn.is_dir(F.col("path")).alias("is_dir"))


@query(f"{FILES} SELECT quality, count(*) AS hits FROM files JOIN labels USING (doc_id) WHERE {EXT} IN ('md', 'txt') GROUP BY quality")
def hits_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Composability: hits of a filter joined with another table."""
    found = schema.files(spark, d).where(predicate(parse("ext:md ext:txt", NOW).filters))
    return found.join(schema.table(spark, d, "labels"), "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("hits"))
