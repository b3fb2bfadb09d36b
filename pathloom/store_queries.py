"""Registered queries of the stores, streams, extractors and labels over the test tables, and their SQL."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import columns as fn
from .functions.fuzzy import atoms
from .operators import content, rank, semantic
from .operators.predicates import atom_predicate, not_excluded, predicate
from .queries import BEST, BOOSTED_HEAD, EXT, FILES, HEAD, OPENS, _boosts, _grep_sql, _index, chunk_documents, docx_bytes, query
from .request import Filters, parse
from .schema import FILES_SQL, NOW
from .sources.documents import TextCache, extracted, is_extracted, packed
from .sources.lines import HistoryLog, hits_as_lines
from .sources.scratch import scratch_path
from .sources.semantic_store import SemanticStore
from .sources.snapshot import SnapshotStore
from .streaming.watch import PollLog, watched

TEXTS_SQL = FILES_SQL.replace("doc_id,\n", "doc_id, text,\n", 1)


@query(f"{FILES} SELECT row_number() OVER (ORDER BY mtime DESC, path) AS place, path, mtime, size FROM index")
def snapshot_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The index published and loaded again; places follow from the stored ordinals."""
    from pyspark.sql import Window

    store = SnapshotStore(spark, scratch_path(spark, "index"))
    rows = store.load_or_build(lambda: _index(spark, d))
    part = Window.partitionBy(F.shiftright("ord", 33))  # ordinals grow by range partition: places by partition, then within it
    sizes = rows.groupBy(F.shiftright("ord", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    placed = rows.withColumn("part", F.shiftright("ord", 33)).withColumn("within", F.row_number().over(part.orderBy("ord"))).join(F.broadcast(before), "part")
    return placed.select((F.col("before") + F.col("within")).cast("long").alias("place"), "path", "mtime", "size")


@query(
    f"""{FILES}, first AS (SELECT * FROM index WHERE NOT (contains(path, '/src1') AND size % 3 = 0)), second AS (SELECT path, CASE WHEN size % 5 = 1 THEN mtime + 9 ELSE mtime END AS mtime, size FROM index WHERE NOT (contains(path, '/de/') AND size % 7 = 2))
    SELECT 1::BIGINT AS poll, path, mtime, size, 'changed' AS state FROM first
    UNION ALL SELECT 2::BIGINT, s.path, s.mtime, s.size, 'changed' FROM second s LEFT JOIN first f USING (path) WHERE f.path IS NULL OR f.mtime <> s.mtime OR f.size <> s.size
    UNION ALL SELECT 2::BIGINT, path, 0::BIGINT, 0::BIGINT, 'gone' FROM first WHERE path NOT IN (SELECT path FROM second)"""
)
def poll_changes(spark: SparkSession, d: str) -> DataFrame:
    """Two listings of the index as polls; the watcher's stream tells what is new, changed and gone from its state."""
    index, base = _index(spark, d), scratch_path(spark, "polls")
    log = PollLog(spark, f"{base}/log", buckets=16)
    log.publish(index.where("not (contains(path, '/src1') and size % 3 = 0)"))
    log.publish(index.where("not (contains(path, '/de/') and size % 7 = 2)").withColumn("mtime", F.when(F.col("size") % 5 == 1, F.col("mtime") + 9).otherwise(F.col("mtime"))))
    out = watched(log).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query(f"{FILES}, {OPENS} SELECT max(ts) AS ts, sum(n)::BIGINT AS count, path FROM opens GROUP BY path")
def history_merged(spark: SparkSession, d: str) -> DataFrame:
    """Opens appended in two parts, the first of which was compacted; read back and summed."""
    from .operators.history import compacted

    log, opens = HistoryLog(spark, scratch_path(spark, "history")), schema.opens(spark, d)
    log.append(opens.where("ts % 2 = 0"))
    log.compact()
    log.append(opens.where("ts % 2 <> 0"))
    return compacted(log.load())


@query("SELECT count(DISTINCT vec_id // 5) AS docs, count(*) AS chunks, 64::BIGINT AS dim FROM embeddings WHERE embedding IS NOT NULL")
def semantic_totals(spark: SparkSession, d: str) -> DataFrame:
    """What the semantic store says of the chunks it was given, after it has checked them."""
    store = SemanticStore(spark, scratch_path(spark, "vectors"))
    facts = store.publish(_chunks(spark, d))
    return spark.createDataFrame([(facts["docs"], facts["chunks"], facts["dim"])], "docs long, chunks long, dim long")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = schema.chunks(spark, d).where("vec is not null")
    return rows.select(F.col("doc").cast("string").alias("path"), F.lit(1).alias("mtime"), F.lit(1).alias("size"), "chunk_ix", "line_start", "vec")


@query("SELECT (vec_id // 5)::VARCHAR AS path, (vec_id % 5)::INT AS chunk_ix, (vec_id % 5 * 20 + 1)::INT AS line_start, len(embedding)::INT AS dim, TRUE AS near FROM embeddings WHERE embedding IS NOT NULL")
def semantic_store_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chunks read back from the store; half precision is within 1/1024 of what went in."""
    store = SemanticStore(spark, scratch_path(spark, "vectors"))
    store.publish(_chunks(spark, d))
    given = _chunks(spark, d).select("path", F.col("chunk_ix").cast("int"), F.col("vec").alias("given"))
    near = F.forall(F.zip_with("vec", "given", lambda a, b: F.abs(a - b) <= F.greatest(F.abs(b) / 1024, F.lit(1e-7))), lambda x: x)
    return store.load().join(given, ["path", "chunk_ix"]).select("path", "chunk_ix", "line_start", F.size("vec").alias("dim"), near.alias("near"))


def _as_files(texts: DataFrame, build) -> DataFrame:
    """Texts packed as files of a kind, by the adapter."""
    return packed(texts.select("doc_id", "path", "mtime", "size", "text"), build)


def xlsx_bytes(text: str) -> bytes:
    """A sheet of a text's lines: words by tab stops, every second cell as a shared string."""
    rows, shared = [], []
    for line in text.split("\n"):
        cells = []
        for k, word in enumerate(line.split(" ")):
            if k % 2:
                cells.append(f'<c t="s"><v>{len(shared)}</v></c>')
                shared.append(f"<si><t>{escape(word)}</t></si>")
            else:
                cells.append(f'<c t="inlineStr"><is><t>{escape(word)}</t></is></c>')
        rows.append(f"<row>{''.join(cells)}</row>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/sharedStrings.xml", f"<sst>{''.join(shared)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet>{''.join(rows)}</worksheet>")
    return out.getvalue()


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, pos, array_to_string(list_filter(string_split(line, ' '), lambda x: x <> ''), chr(9)) AS cells FROM l)
    SELECT doc_id, coalesce(string_agg(cells, chr(10) ORDER BY pos) FILTER (cells <> ''), '') AS text FROM c GROUP BY doc_id"""
)
def extract_xlsx(spark: SparkSession, d: str) -> DataFrame:
    """Every text as a sheet, and back: empty cells and rows are left out."""
    texts = schema.doc_text(spark, d).where("text is not null").withColumn("path", F.concat("path", F.lit(".xlsx")))
    return extracted(_as_files(texts, xlsx_bytes)).select("doc_id", "text")


def pdf_bytes(text: str) -> bytes:
    """A file of pages of fifty lines, objects out of order, texts by a character map of two-byte codes."""
    import zlib

    lines = text.split("\n")
    chars = sorted(set(text) - {"\n"})
    code = {ord(c): f"{k + 1:04x}" for k, c in enumerate(chars)}
    pairs = [f"<{code[ord(c)]}> <{c.encode('utf-16-be').hex()}>\n" for c in chars]
    cmap = "".join(f"{len(part)} beginbfchar\n{''.join(part)}endbfchar\n" for part in (pairs[a : a + 100] for a in range(0, len(pairs), 100))).encode()
    pages = [lines[a : a + 50] for a in range(0, len(lines), 50)]
    stream = lambda body: b"<< /Filter /FlateDecode /Length %d >>\nstream\n" % len(z := zlib.compress(body, 1)) + z + b"\nendstream"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /ToUnicode 4 0 R >>", 4: stream(cmap)}
    for k, page in enumerate(pages):
        shown = " ".join(f"1 0 0 1 30 {600 - 11 * j} Tm <{line.translate(code)}> Tj" for j, line in enumerate(page))
        objects[10 + 2 * k] = b"<< /Type /Page /Contents %d 0 R >>" % (11 + 2 * k)
        objects[11 + 2 * k] = stream(f"BT /F 9 Tf {shown} ET".encode())
    objects[2] = b"<< /Resources << /Font << /F 3 0 R >> >> /Kids [%s] >>" % b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages)))
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, objects[k]) for k in sorted(objects, reverse=True))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '\\n+', chr(10), 'g'), '^\\n|\\n$', '', 'g') AS text FROM documents WHERE text IS NOT NULL")
def extract_pdf(spark: SparkSession, d: str) -> DataFrame:
    """Every text as a PDF, and back: pages in the order of their tree; empty lines show nothing."""
    texts = schema.doc_text(spark, d).where("text is not null").withColumn("path", F.concat("path", F.lit(".pdf")))
    return extracted(_as_files(texts, pdf_bytes)).select("doc_id", "text")


@query("SELECT doc_id, text || chr(10) AS text FROM documents WHERE text IS NOT NULL")
def text_cache(spark: SparkSession, d: str) -> DataFrame:
    """Documents through the cache twice: what the first query extracted is all that the second one reads."""
    texts = schema.doc_text(spark, d).where("text is not null").withColumn("path", F.concat("path", F.lit(".docx")))
    cache = TextCache(spark, scratch_path(spark, "cache"), most=1 << 40)
    files = _as_files(texts, docx_bytes)
    cache.texts(files.where("doc_id % 3 > 0"), extracted)
    again = cache.texts(files.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.col("content"))), extracted)
    return texts.select("doc_id", "path").join(again, "path").select("doc_id", "text")


@query(
    """SELECT doc_id, repeat('▰', k) || repeat('▱', 5 - k) AS bar, CASE WHEN n_chars % 3 = 0 THEN 0 ELSE least(doc_id * 30 // (n_chars % 3 * 400), 30) END AS cells, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 79) || '…' END AS clipped
    FROM (SELECT *, round(least(n_chars % 131 / 125.0, 1) * 5)::INT AS k FROM documents)"""
)
def row_decoration(spark: SparkSession, d: str) -> DataFrame:
    docs = schema.table(spark, d, "documents")
    n = F.col("n_chars").cast("long")
    return docs.select("doc_id", fn.score_bar((n % 131) / 125.0).alias("bar"), fn.gauge_cells(F.col("doc_id"), n % 3 * 400, 30).alias("cells"), fn.clip_chars(F.col("text"), 80).alias("clipped"))


@query("SELECT doc_id, CASE WHEN m <> '' THEN strpos(text, m) - 1 ELSE -1 END AS first, CASE WHEN m <> '' THEN strpos(text, m) - 1 + length(m) ELSE -1 END AS last FROM (SELECT doc_id, text, regexp_extract(text, '[0-9]+') AS m FROM documents)")
def first_matches(spark: SparkSession, d: str) -> DataFrame:
    found = fn.first_match(F.col("text"), "[0-9]+")
    return schema.table(spark, d, "documents").select("doc_id", *(F.coalesce(found[side].cast("long"), F.lit(-1)).alias(name) for side, name in (("start", "first"), ("end", "last"))))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[1:100], chr(10)) AS head, array_to_string(string_split(text, chr(10))[5:44], chr(10)) AS around FROM documents")
def preview_windows(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return schema.table(spark, d, "documents").select("doc_id", F.array_join(fn.preview(text, None), "\n").alias("head"), F.array_join(fn.preview(text, 10), "\n").alias("around"))


STRONG = f"""{FILES}, s AS (SELECT path, mtime, doc_id * 37 % 500 AS score FROM files), c AS (SELECT greatest(count(*) FILTER (score >= (SELECT max(score) // 2 FROM s)), least(8, count(*))) AS strong FROM s),
    r AS (SELECT row_number() OVER (ORDER BY score DESC, mtime DESC, path) AS rank, path, score FROM s QUALIFY rank <= 500)"""


def _strong(spark: SparkSession, d: str) -> DataFrame:
    rows = schema.files(spark, d).withColumns({"is_quiet": F.lit(False), "score": F.col("doc_id") * 37 % 500})
    return rank.strong_part(rows, demote=False)


@query(f"{STRONG} SELECT rank, path, score FROM r WHERE rank <= (SELECT strong FROM c)")
def visible_rows(spark: SparkSession, d: str) -> DataFrame:
    """What stands before the fold."""
    return rank.visible(_strong(spark, d)).select("rank", "path", "score")


@query(f"{STRONG} SELECT count(*) AS shown, count(*) FILTER (rank <= (SELECT strong FROM c)) AS strong FROM r")
def match_counts(spark: SparkSession, d: str) -> DataFrame:
    return _strong(spark, d).agg(F.count(F.lit(1)).alias("shown"), F.count_if("is_strong").alias("strong"))


@query(f"{BOOSTED_HEAD}, h AS (SELECT {HEAD} FROM b QUALIFY rank <= 500) SELECT path, rank FROM h WHERE path IN (SELECT path FROM files WHERE doc_id % 3 = 0)")
def marked_rows(spark: SparkSession, d: str) -> DataFrame:
    """Marked paths among an empty query's rows."""
    rows = rank.filename_search(_index(spark, d), parse("", NOW), boosts=_boosts(spark, d))
    return rank.marked_paths(rows, schema.files(spark, d).where("doc_id % 3 = 0")).select("path", "rank")


@query(f"SELECT path || ':' || line_number || ':' || line AS value FROM ({_grep_sql('(?i)tion of')})")
def printed_lines(spark: SparkSession, d: str) -> DataFrame:
    return hits_as_lines(content.grep(schema.doc_text(spark, d), "tion of"))


@query(f"{BEST} SELECT row_number() OVER (ORDER BY score DESC, doc) AS rank, doc || ':' || line_start || ':' || printf('%.2f', score) AS value FROM best QUALIFY rank <= 100")
def printed_scores(spark: SparkSession, d: str) -> DataFrame:
    q = list(schema.chunks(spark, d).where("doc = 0 and chunk_ix = 0").first().vec)
    found = semantic.semantic_search(schema.chunks(spark, d), q, doc="doc")
    return hits_as_lines(found.withColumn("path", F.col("doc").cast("string")))


@query(f"{FILES} SELECT path FROM loud WHERE contains(path, 'src1') AND ends_with(path, '.md') AND NOT contains(path, '/de/') AND starts_with(path, '/home')")
def atoms_together(spark: SparkSession, d: str) -> DataFrame:
    """All atoms of a query must hold."""
    where = predicate(Filters())
    for atom in atoms("'src1 .md$ !/de/ ^/home"):
        where &= atom_predicate(atom)
    return _index(spark, d).where(where).select("path")


@query(f"{FILES} SELECT path, NOT path LIKE '%/' AND {EXT} IN ('md', 'txt', 'pdf', 'docx') AND size <= 4194304 AS embeds, {EXT} IN ('pdf', 'docx') AS extracts FROM index")
def document_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).select("path", semantic.eligible().alias("embeds"), is_extracted().alias("extracts"))


@query(f"{FILES} SELECT path FROM index WHERE NOT regexp_matches(path, '/src1/|/src1$|\\.zip$|/fr/src')")
def excluded_places(spark: SparkSession, d: str) -> DataFrame:
    """Names, globs and places of several names that an index leaves out."""
    return not_excluded(_index(spark, d), ["src1", "*.zip", "fr/src*"]).select("path")


@query(_grep_sql("(?i)and", f"{EXT} IN ('md', 'rs') AND size >= 500", "ORDER BY mtime DESC, path, line_number LIMIT 200"))
def first_hits_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Line search that stops with the stretch of the index which fills its limit."""
    request = parse("> ext:md ext:rs larger:500b and", NOW)
    return content.grep(schema.doc_text(spark, d), request.pattern, request.filters, limit=200)


def _chunks_sql() -> str:
    """The windows spelt out as a recursion over each text."""
    end = "CASE WHEN {a} + 1000 >= length(text) THEN length(text) WHEN length(regexp_extract(substr(text, {a} + 1, 1000), '(?s)^.*\\n')) > 750 THEN {a} + length(regexp_extract(substr(text, {a} + 1, 1000), '(?s)^.*\\n')) ELSE {a} + 1000 END"
    return f"""WITH RECURSIVE t AS (SELECT path, text FROM ({TEXTS_SQL}) WHERE text <> ''),
    w AS (SELECT path, text, 0::BIGINT AS a, ({end.format(a="0")})::BIGINT AS b FROM t
          UNION ALL SELECT path, text, n AS a, ({end.format(a="n")})::BIGINT AS b FROM (SELECT path, text, greatest(b - 200, a + 1) AS n FROM w WHERE b < length(text))),
    c AS (SELECT path, 1 + a - length(replace(substr(text, 1, a), chr(10), '')) AS line, substr(text, a + 1, b - a) AS text, row_number() OVER (PARTITION BY path ORDER BY a) - 1 AS k, count(*) OVER (PARTITION BY path) AS n FROM w WHERE regexp_matches(substr(text, a + 1, b - a), '\\S'))
    SELECT path, k::INT AS chunk_ix, line::INT AS line_start, text FROM c WHERE n <= 256 OR ceil(k * 255 / (n - 1)) * (n - 1) // 255 = k"""


query(_chunks_sql())(chunk_documents)
