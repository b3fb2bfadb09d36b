"""The pipeline against brute force on a small corpus."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pathloom.llm import quality, shared, word_hash
from pathloom.llm.queries import piece_model

import corpus_pipeline


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return ({tuple(w)} if w else set()) if len(w) < 4 else {tuple(w[k : k + 4]) for k in range(len(w) - 3)}


def test_pipeline_equals_brute_force(spark, tmp_path):
    r = random.Random(3)
    words = [f"w{''.join(r.choice('aeiou') for _ in range(4))}" for _ in range(300)]
    good = lambda: "\n".join(" ".join(r.choice(words) for _ in range(15)).capitalize() + "." for _ in range(r.randint(2, 8)))
    bad = lambda: "\n".join(" ".join(r.choice(words) + "$$$" for _ in range(15)) for _ in range(4))
    texts = [bad() if k % 5 == 0 else good() for k in range(150)]
    for k in range(1, 100, 9):
        texts.append(texts[k])
        texts.append(texts[k] + " extra")
    truth = {k: int("$$$" not in t) for k, t in enumerate(texts)}
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)] + [(9000, None, "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, y, 0) for k, y in truth.items() if zlib.crc32(str(k).encode()) % 4 != 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.trained(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = {k: t or "" for k, t, *_ in rows if model.scores([(t or "").encode()])[0][0] >= 0.7}
    assert {k for k in left if k != 9000} == {k for k, y in truth.items() if y}
    last = {}
    for k, t in left.items():
        last[t] = max(k, last.get(t, k))
    left = {k: left[k] for k in last.values()}
    root = {k: k for k in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {k: shingles(t) for k, t in left.items()}
    for a in left:
        for b in left:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    left = {k: t for k, t in left.items() if find(k) == k}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = Counter(g.doc_id for g in got)
    assert copies.keys() <= left.keys() and max(copies.values()) <= 3
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in left.items()}
    whole = sum(size.values())
    for s, weight in (("s0", 5), ("s1", 2), ("s2", 1)):
        own = [k for k in left if k % 3 == int(s[1])]
        taken = sum(copies[k] * size[k] for k in own)
        assert abs(taken - whole * weight / 8) <= max(size[k] for k in own)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for g in got[:40]:
        assert np.frombuffer(bytes(g.ids), "<u4").tolist() == library.encode(left[g.doc_id], add_bos=True, add_eos=True)
    assert [name for name, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_stages_of_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_columns_come_out_as_they_went_in(spark, tmp_path):
    """Names that operators use for their own columns, repeated ids, null texts."""
    clashing = ["sha", "copy", "copies", "size", "target", "taken", "source_size", "score", "predicted", "held_out"]
    rows = [(k, t, "en", "s", 1, *[f"{c}{k}" for c in clashing]) for k, t in ((1, "Some words of a plain line."), (2, "Other words of one more line."), (2, "Third words in a row."), (3, None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clashing))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    given = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= given, name
    assert corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert len(corpus_pipeline.exact_stage(spark, docs, str(tmp_path)).collect()) == 4


def test_workers_get_batches_of_bounded_bytes(spark):
    """The 25 MB of one partition came as one batch before, which the worker and the JVM held several times over."""
    docs = spark.range(2500, numPartitions=1).selectExpr("id", "repeat('word ', 2000) text").union(spark.range(1).selectExpr("id", "repeat('w', 9000000) text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    unset = spark.conf.get(shared.BATCH_CONF, None)
    spark.conf.unset(shared.BATCH_CONF)
    try:
        sizes = [tuple(r) for r in shared.mapped(docs, run, "n long, size long").collect()]
        assert sum(n for n, _ in sizes) == 2501 and max(n for n, _ in sizes) > 1
        assert all(size <= shared.BATCH_BYTES + 20_000 or n == 1 for n, size in sizes)
        spark.conf.set(shared.BATCH_CONF, 1 << 20)  # the session's own bound stays
        sizes = [tuple(r) for r in shared.mapped(docs, run, "n long, size long").collect()]
        assert sum(n for n, _ in sizes) == 2501 and all(size <= (1 << 20) + 20_000 or n == 1 for n, size in sizes)
    finally:
        spark.conf.unset(shared.BATCH_CONF) if unset is None else spark.conf.set(shared.BATCH_CONF, unset)


def test_powers_of_a_long_text_are_not_kept():
    up, down = word_hash.powers(1 << 17)
    for k in (0, 1, 2, 1000, (1 << 17) - 1):
        assert int(up[k]) == pow(int(word_hash.BASE), k, 1 << 64) and int(up[k]) * int(down[k]) % (1 << 64) == 1
    assert word_hash._powers.cache_info().currsize
    shared.returned()
    assert not word_hash._powers.cache_info().currsize
