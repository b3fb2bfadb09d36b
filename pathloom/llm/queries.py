"""The registered queries of this folder: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .main_text import extracted

    return extracted(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import scored, trained

    docs = read_table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, read_table(spark, sf_dir, "labels")))


def op3_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_bpe import encoded

    return encoded(read_table(spark, sf_dir, "documents"), piece_model(), with_ids=False, with_text=False)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import joined

    return joined(read_table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vantage import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scanned

    return scanned(read_table(spark, sf_dir, "documents"), with_spans=False)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(read_table(spark, sf_dir, "documents")).drop("copies")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .archives import archived

    return archived(read_table(spark, sf_dir, "pages")).drop("payload", "url")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import deduplicated

    return deduplicated(read_table(spark, sf_dir, "documents"))


def op10_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeated_spans import without_repeats

    return without_repeats(read_table(spark, sf_dir, "documents"))


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sort_means import clustered

    return clustered(read_table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnowing import marked

    return marked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("runs")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audited

    return audited(read_table(spark, sf_dir, "documents"))


def _sort_means_sql(clusters: int, rounds: int) -> str:
    """Lloyd's rounds spelt out: every assignment compares all centroids."""
    steps = [
        f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, v AS c FROM v QUALIFY cluster < {clusters})"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (SELECT vec_id, v, cluster, distance FROM (SELECT vec_id, v, cluster, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS distance FROM v, c{k})
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT cluster, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS i FROM a{k}) GROUP BY cluster, i) GROUP BY cluster),
            c{k + 1} AS (SELECT cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster))""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (cluster)"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES = {f.__name__: f for f in (op1_main_text, op2_quality, op3_piece_bpe, op4_jaccard_join, op5_nearest, op6_secrets, op7_mixing, op8_warc, op9_exact_dedup, op10_repeated_spans, op11_sort_means, op12_decontamination, op13_divergence)}
ORACLES = {
    "op8_warc": """
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id,
                     array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       (list_sum(list_transform(range(5), lambda j: (CASE WHEN substr(bits, k * 5 + j + 1, 1) = '1' THEN 1 ELSE 0 END) * (16 >> j))) + 1)::INT, 1)), '') AS payload_digest
              FROM (SELECT page_id, html, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits FROM pages))
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_sort_means": _sort_means_sql(16, 3),
    "op12_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
        b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM (SELECT item_id, coalesce(text, '') AS text FROM benchmark)),
        i AS (SELECT DISTINCT item_id, n, array_to_string(w[pos:pos + n - 1], ' ') AS words FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
        g AS (SELECT row, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS words FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
        h AS (SELECT row, g.n, pos, item_id FROM g JOIN i USING (n, words)),
        c AS (SELECT row, count(DISTINCT pos) AS hits FROM (SELECT row, unnest(range(pos, pos + n)) AS pos FROM h) GROUP BY row),
        t AS (SELECT row, count(*) AS items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY row)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits, 0) AS n_hit, coalesce(items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, hits IS NOT NULL AS contaminated
        FROM d LEFT JOIN c USING (row) LEFT JOIN t USING (row)
    """,
    "op13_divergence": f"""
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        u AS (SELECT row, lang, source, unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*)::HUGEINT AS uses FROM u GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
        n AS (SELECT lang, sum(uses)::HUGEINT AS total, count(*)::HUGEINT AS terms FROM k GROUP BY lang),
        q AS (SELECT lang, term, 1 + 1000000000 * (uses + 2) // (total + 2 * terms) AS q FROM k JOIN n USING (lang)),
        c AS (SELECT lang, source, term, count(*)::HUGEINT AS uses FROM u JOIN k USING (lang, term) GROUP BY lang, source, term),
        s AS (SELECT lang, source, coalesce(sum(uses), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
        p AS (SELECT s.lang, s.source, k.term, coalesce(c.uses, 0) AS uses, 1 + 1000000000 * (coalesce(c.uses, 0) + 2) // (s.total + 2 * n.terms) AS p
              FROM s JOIN n USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        best AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE uses > 0 AND p > q)
        SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
        UNION ALL SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM best QUALIFY rank <= 10
    """,
}
