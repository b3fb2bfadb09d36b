"""How the sources of a language differ in their vocabulary, from dense tiles of groups by terms.

1. Counts.  Tasks count terms and the documents that hold them, a batch at a time; one
   shuffle by (lang, term) sums them and tells which terms a language keeps.
2. Tiles.  The kept terms of a language are dealt in blocks, so that a block's counts are a
   dense int64 matrix of groups by terms of bounded size; where a language has many sources,
   blocks of sources meet in pairs.  A tile compares all its pairs of groups by broadcasting
   rows against each other, and keeps the ten best terms of each of its groups.
3. Sums of the tiles' pair matrices and merged heaps are ordinary aggregates.

Terms that no group of a tile holds have one value a pair, so the tile's sums are taken
relative to that and the constant part is added once for all kept terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import mapped, written

SCALE_STEP, SCALE_STEPS = 1000, 3  # p is in thousand millionths, scaled in steps that keep to 64 bits
LEAST_DOCS, SMOOTH, TOP = 10, 2, 10
#: Sources of a block, and cells of a tile.
SIDE, CELLS = 128, 1 << 15
#: Distinct (group, term) entries and bytes of text from which a task passes on what it counted; rows of a batch.
HELD, HELD_BYTES, ROWS_OUT = 600_000, 64 << 20, 20_000
#: Bytes of a text taken at once.
PIECE = 1 << 20
#: Bytes outside terms become spaces, A-Z small letters.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size; only a single term can be longer than a piece."""
    rest, a = b"", 0  # what may go on in the next piece
    while a < len(text):
        piece = text[a : a + PIECE].translate(TERMS)
        a += PIECE
        end = piece.rfind(b" ") + 1
        if end or a >= len(text):
            end = len(piece) if a >= len(text) else end
            yield (rest + piece[:end]).split()
            rest = piece[end:]
        else:
            rest += piece


def _passed_on(lang: str, groups: dict[str, Counter], docs: Counter) -> Iterator[pa.RecordBatch]:
    """(lang, term, docs, sources, uses): what a task has counted of a language, a row a term."""
    names, sizes = list(groups), [len(c) for c in groups.values()]
    terms = pa.array([t for c in groups.values() for t in c], pa.binary()).dictionary_encode()
    index = terms.indices.to_numpy()
    order = np.argsort(index, kind="stable")
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(index, minlength=len(terms.dictionary))))), pa.int32())
    sources = pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), sizes)[order]))
    uses = np.fromiter((n for c in groups.values() for n in c.values()), np.int64, len(index))[order]
    of_term = [docs[t] for t in terms.dictionary.to_pylist()]
    columns = [pa.array([lang] * len(of_term), pa.string()), terms.dictionary, pa.array(of_term, pa.int64()), pa.ListArray.from_arrays(offsets, sources), pa.ListArray.from_arrays(offsets, pa.array(uses))]
    yield from pa.Table.from_arrays(columns, names=["lang", "term", "docs", "sources", "uses"]).to_batches(ROWS_OUT)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
    docs: dict[str, Counter] = defaultdict(Counter)
    entries = read = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        for lang, groups in held.items():
            yield from _passed_on(lang, groups, docs[lang])
        held.clear(), docs.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary())):
            body, uses, seen = text.as_py(), held[lang][source], set()
            entries -= len(uses)
            for found in terms_of(body):
                uses.update(found)
                seen.update(found)
            docs[lang].update(seen)
            entries, read = entries + len(uses), read + len(body)
            if entries > HELD or read > HELD_BYTES:
                yield from passed_on()
                entries = read = 0
    yield from passed_on()


def scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """floor(10**9 * count / total) of int64 arrays with count <= total < 2**53, exactly."""
    total = np.maximum(total, 1)
    out, rest = count // total, count % total
    for _ in range(SCALE_STEPS):
        rest = rest * SCALE_STEP
        out, rest = out * SCALE_STEP + rest // total, rest % total
    return out


def shares(count: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    return 1 + scaled(count + SMOOTH, total + SMOOTH * terms)


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial values of a tile: its pairs of groups (with what a term without uses adds), its groups' best terms.

    Rows without a term are the tile's groups, the others its counts.
    """
    marks, cells = rows[rows.term.isna()].sort_values(["side", "source"]), rows[rows.term.notna()]
    sources, side = marks.source.to_numpy(object), marks.side.to_numpy()
    total, terms = marks.total.to_numpy(np.int64), marks.terms.to_numpy(np.int64)
    names, column = np.unique(cells.term.to_numpy(object), return_inverse=True)
    place = {s: k for k, s in enumerate(sources)}
    uses = np.zeros((len(sources), len(names)), dtype=np.int64)
    uses[[place[s] for s in cells.source], column] = cells.uses.to_numpy(np.int64)
    p, none = shares(uses, total[:, None], terms[:, None]), shares(np.zeros_like(total), total, terms)
    lang, a, b = rows.lang.iloc[0], int(rows.a.iloc[0]), int(rows.b.iloc[0])
    out = []
    for k in np.flatnonzero(side == a):
        others = np.arange(k + 1, len(sources)) if a == b else np.flatnonzero(side == b)
        blank = apart(none[k], none[others])
        more = apart(p[k], p[others]).sum(axis=1) - len(names) * blank
        out += [(lang, sources[k], "pair", sources[j], int(x), int(y), int(terms[k])) for j, x, y in zip(others, more, blank)]
    if a == b and len(names):
        of_lang = np.zeros(len(names), dtype=np.int64)
        of_lang[column] = cells.of_lang.to_numpy(np.int64)
        q = shares(of_lang, marks.lang_total.to_numpy(np.int64)[:1], terms[:1])
        value = np.where((uses > 0) & (p > q), apart(p, q), -1)
        best = np.argsort(-value, axis=1, kind="stable")[:, :TOP]  # names are in order, so ties are
        out += [(lang, sources[k], "term", names[j], int(value[k, j]), 0, 0) for k in range(len(sources)) for j in best[k] if value[k, j] >= 0]
    return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value", "blank", "terms"])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, uses, of_lang, first): uses of every kept term in every group that has it, and in the language; ``first`` marks one row a term."""
    counts = mapped(docs, _counted, "lang string, term binary, docs long, sources array<string>, uses array<long>")
    counts = counts.withColumn("term", F.col("term").cast("string")).repartition("lang", "term")
    # a term's documents go with its first source, so that summing them counts each once; the shuffle above serves all below
    each = counts.select("lang", "term", F.explode(F.arrays_zip("sources", "uses")).alias("at"), F.when(F.col("at.sources") == F.col("sources")[0], F.col("docs")).otherwise(0).alias("docs"))
    counts = each.groupBy("lang", "term", F.col("at.sources").alias("source")).agg(F.sum("at.uses").alias("uses"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    marked = counts.withColumns({"in_docs": F.sum("docs").over(same), "of_lang": F.sum("uses").over(same), "first": F.col("source") == F.min("source").over(same)})
    return marked.where(F.col("in_docs") >= LEAST_DOCS).select("lang", "source", "term", "uses", "of_lang", "first")


def audited(docs: DataFrame, *, side: int = SIDE, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's distance to the other sources of its language, and its ten most typical terms.

    ``docs`` has lang, source, text; null ones count as empty strings, and other columns aren't
    read.  Rows with equal ids are separate documents.  Groups without terms take part with
    counts of zero; a language that keeps no term has pairs of value 0; a single source has no
    pairs.  Ties go by the items' UTF-8 bytes; an empty table gives an empty result.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = written(counted(docs), "term-counts")
    totals = counts.groupBy("lang", "source").agg(F.sum("uses").alias("total"), F.count_if("first").alias("firsts"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("firsts", F.lit(0)).alias("firsts"))
    groups = written(groups, "term-groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("terms"), F.count(F.lit(1)).alias("sources"))
    blocks = F.ceil(F.col("terms") * F.least(F.col("sources"), F.lit(2 * side)) / cells)
    langs = written(langs.withColumns({"sides": F.ceil(F.col("sources") / side), "blocks": F.greatest(blocks, F.lit(1))}), "term-langs")

    def placed(rows: DataFrame) -> DataFrame:
        """Each row once for every pair of source blocks that its own block is in."""
        rows = rows.join(langs, "lang").withColumn("side", F.pmod(F.xxhash64("source"), "sides"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
        return rows.withColumns({"a": F.least("side", "other"), "b": F.greatest("side", "other")})

    marks = placed(groups).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    marks = marks.select("lang", "block", "a", "b", "side", "source", "total", "terms", "lang_total", *(F.lit(None).cast(t).alias(c) for c, t in (("term", "string"), ("uses", "long"), ("of_lang", "long"))))
    uses = placed(counts).withColumn("block", F.pmod(F.xxhash64("term", F.lit(1)), "blocks"))
    uses = uses.select("lang", "block", "a", "b", "side", "source", *(F.lit(0).cast("long").alias(c) for c in ("total", "terms", "lang_total")), "term", "uses", "of_lang")
    parts = marks.unionByName(uses).groupBy("lang", "block", "a", "b").applyInPandas(tile, "lang string, source string, part string, item string, value long, blank long, terms long")
    parts = written(parts, "term-tiles")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg((F.sum("value") + F.max("terms") * F.max("blank")).alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", both.alias("ends"), "value").select("lang", "ends.source", F.lit("pair").alias("part"), "ends.item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    heaps = parts.where("part = 'term'").withColumn("rank", place).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", place).unionByName(heaps.select("lang", "source", "part", "item", "value", "rank"))
