"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad.  Node scores are linear in features of the line and of its two
neighbours; transition scores tie neighbouring labels.  Training maximises the likelihood of
line labels taken from their documents' labels.  A document's quality is the length-weighted
mean of its lines' forward-backward marginals, passed through a logistic curve fitted on the
same training documents.

Features are counts of bytes and words, so that no language, source or id enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import word_hash
from .shared import mapped

#: Labelled documents the model is fitted on at most, and all their bytes.
TRAIN_DOCS, TRAIN_BYTES = 2000, 32 << 20
#: Share of the bytes that one document may have.
LONG = 16
#: Rows and bytes of text whose features are made at once; one longer text is taken whole.
ROWS, SLICE = 256, 512 << 10
THRESHOLD = 0.7
HELD_OUT = 2

CLASSES = 8  # other, lower, upper, digit, space, bar, symbol, other punctuation
BYTE_CLASS = np.zeros(256, dtype=np.int64)
BYTE_CLASS[97:123], BYTE_CLASS[65:91], BYTE_CLASS[48:58] = 1, 2, 3
BYTE_CLASS[[32, 9, 11, 12, 13, 10]] = 4
BYTE_CLASS[124] = 5
BYTE_CLASS[list(b"!#$%&*+/<=>@\\^_`~{}[]")] = 6
BYTE_CLASS[list(b"\"'(),-.:;?")] = 7
OWN = 17  # features of a line before its neighbours' are added
BESIDE = (2, 3, 5, 6, 8, 9, 10, 13)  # those that are also read from the neighbours


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, bytes of each line, lines of each text).  An empty text is one empty line."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], breaks[:-1] + 1))
    sizes = breaks - starts
    n = len(breaks)
    line = np.repeat(np.arange(n), sizes + 1)
    counts = np.bincount(line * CLASSES + BYTE_CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    counts[:, 4] -= 1  # the line break
    per = counts / np.maximum(1, sizes)[:, None]
    letters = np.maximum(1, counts[:, 0] + counts[:, 1] + counts[:, 2])

    w_start, w_end, w_hash = word_hash.words(data)
    w_line = line[w_start] if len(w_start) else np.zeros(0, dtype=np.int64)
    n_words = np.bincount(w_line, minlength=n)
    same = np.zeros(len(w_hash), dtype=bool)
    same[1:] = (w_hash[1:] == w_hash[:-1]) & (w_line[1:] == w_line[:-1])
    bits = np.uint64(64 - int(n).bit_length())
    key = np.sort((w_line.astype(np.uint64) << bits) | (w_hash >> (np.uint64(64) - bits)))  # by line, then word
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> bits).astype(np.int64), minlength=n)
    odd_end = np.bincount(w_line, weights=BYTE_CLASS[data[w_end - 1]] == 6 if len(w_end) else None, minlength=n)
    spread = np.maximum(1, n_words)
    expected = np.sqrt(spread)  # lines repeat words by chance, long ones more

    per_text = np.array([t.count(b"\n") + 1 for t in texts], dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), per_text)
    l_hash = word_hash.range_hashes(word_hash.prefix_hashes(data), starts, breaks)
    by = np.lexsort((l_hash, text))
    twin = np.zeros(n, dtype=bool)
    again = (l_hash[by][1:] == l_hash[by][:-1]) & (text[by][1:] == text[by][:-1])
    twin[by[1:][again]] = twin[by[:-1][again]] = True
    twin &= sizes > 0
    last = data[np.maximum(breaks - 1, 0)]

    own = np.stack([
        np.ones(n), np.log1p(sizes), counts[:, 2] / letters, per[:, 3], per[:, 4], per[:, 5], per[:, 6], per[:, 7],
        odd_end / spread, np.bincount(w_line, weights=same, minlength=n) / spread, 1 - distinct / spread, (n_words - distinct) / (spread * expected),
        np.log1p(sizes / spread), twin, sizes == 0, (BYTE_CLASS[last] == 7) & (sizes > 0), np.minimum(1.0, sizes / 80),
    ], axis=1).astype(np.float64)
    first, final = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    at = np.cumsum(per_text)
    final[at - 1], first[at - per_text] = True, True
    before = np.vstack([np.zeros((1, len(BESIDE))), own[:-1][:, BESIDE]])
    after = np.vstack([own[1:][:, BESIDE], np.zeros((1, len(BESIDE)))])
    before[first], after[final] = 0, 0
    return np.hstack([own, before, after, first[:, None], final[:, None]]), sizes, per_text


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some size together, or of one long text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
            size += len(texts[end]) + 1
            end += 1
        yield at, end
        at = end


def _steps(per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by falling length, their first lines, and how many texts have a line at each step."""
    order = np.argsort(-per_text, kind="stable")
    first = (np.cumsum(per_text) - per_text)[order]
    longest = int(per_text.max()) if len(per_text) else 0
    active = np.searchsorted(-per_text[order], -np.arange(longest), side="left")
    return order, first, active


def marginals(node: np.ndarray, jump: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward for all texts at once: P(good) of each line, expected transitions, log of the partition sums.

    ``node``: log score of good over bad by line; ``jump``: 2 x 2 log scores, [before, after].
    """
    score = np.stack([np.zeros(len(node)), node], axis=1)
    top = score.max(axis=1)
    weight, move = np.exp(score - top[:, None]), np.exp(jump)
    ahead, back = np.empty_like(weight), np.empty_like(weight)
    order, first, active = _steps(per_text)
    total = top.sum()
    for t, k in enumerate(active):
        at = first[:k] + t
        a = weight[at] if t == 0 else (ahead[at - 1] @ move) * weight[at]
        scale = a.sum(axis=1, keepdims=True)
        ahead[at] = a / scale
        total += np.log(scale).sum()
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        more = active[t + 1] if t + 1 < len(active) else 0
        at = first[:k] + t
        b = np.ones((k, 2))
        if more:
            b[:more] = (weight[at[:more] + 1] * back[at[:more] + 1]) @ move.T
        back[at] = b / b.sum(axis=1, keepdims=True)
    both = ahead * back
    good = both[:, 1] / both.sum(axis=1)
    inner = np.ones(len(node), dtype=bool)
    inner[np.cumsum(per_text) - 1] = False
    here = np.flatnonzero(inner)
    pairs = ahead[here][:, :, None] * move[None] * (weight[here + 1] * back[here + 1])[:, None, :]
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    return good, pairs.sum(axis=0), float(total)


@dataclass(frozen=True)
class LineModel:
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    jump: np.ndarray
    slope: float
    offset: float

    def lines(self, features: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        node = ((features - self.mean) / self.deviation).clip(-6, 6) @ self.weights
        return marginals(node, self.jump, per_text)[0]

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of each text, P(good) of all lines, lines of each text)."""
        features, sizes, per_text = line_features(texts)
        good = self.lines(features, per_text)
        return _logistic(self.slope * document_odds(good, sizes, per_text) + self.offset), good, per_text


def document_odds(good: np.ndarray, sizes: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Log odds of the length-weighted mean of line marginals."""
    weight = sizes + 1.0
    at = np.cumsum(per_text) - per_text
    mean = np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at)
    mean = mean.clip(1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fitted(samples: list[tuple[bytes, int]], *, steps: int = 120, rate: float = 0.1, decay: float = 1e-3) -> LineModel:
    """Fits the field by full-batch Adam on lines that carry their document's label, then the logistic curve."""
    width = OWN + 2 * len(BESIDE) + 2
    labels = np.array([y for _, y in samples], dtype=float)
    if len(set(labels.tolist())) < 2:  # nothing to tell apart: the one label's share, or a half
        share = float(labels.mean()) * 0.98 + 0.01 if len(labels) else 0.5
        return LineModel(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    texts = [t for t, _ in samples]
    features, sizes, per_text = map(np.concatenate, zip(*(line_features(texts[a:b]) for a, b in slices(texts))))
    mean, deviation = features.mean(axis=0), features.std(axis=0)
    mean[0], deviation[0] = 0, 1
    deviation[deviation < 1e-9] = 1
    x = ((features - mean) / deviation).clip(-6, 6)
    y = np.repeat(labels, per_text)
    # both labels weigh the same, and each document counts by the root of its lines
    share = labels.mean()
    by_doc = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / np.sqrt(per_text)
    each = np.repeat(by_doc, per_text)
    each /= each.sum()
    inner = np.ones(len(y), dtype=bool)
    inner[np.cumsum(per_text) - 1] = False
    here = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[here].astype(int), y[here + 1].astype(int)), 1)
    weights, jump = np.zeros(width), np.zeros((2, 2))
    m = [np.zeros_like(weights), np.zeros_like(jump)]
    v = [np.zeros_like(weights), np.zeros_like(jump)]
    for step in range(1, steps + 1):
        good, moves, _ = marginals(x @ weights, jump, per_text)
        gradient = [x.T @ (each * (good - y)) + decay * weights, (moves - seen) / len(y) + decay * jump]
        for k, (value, g) in enumerate(zip((weights, jump), gradient, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            value -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        jump = jump.clip(-1.5, 1.5)  # lines of one document all carry one label; without a bound the chain would ignore the lines
    odds = document_odds(marginals(x @ weights, jump, per_text)[0], sizes, per_text)
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's method, slightly damped
        p = _logistic(slope * odds + offset)
        w = p * (1 - p) + 1e-6
        a = np.array([[(w * odds * odds).sum() + 0.1, (w * odds).sum()], [(w * odds).sum(), w.sum() + 0.1]])
        g = np.array([((p - labels) * odds).sum() + 0.1 * (slope - 1), (p - labels).sum() + 0.1 * offset])
        slope, offset = np.array([slope, offset]) - 0.7 * np.linalg.solve(a, g)
    return LineModel(mean, deviation, weights, jump, float(slope), float(offset))


def in_fold(doc_id: Column) -> Column:
    """The remainder that holds a document out of training."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def trained(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> LineModel:
    """A model of labelled rows outside the held-out fold, in the order of a hash of the id.

    It is fitted on whole documents, as many as ``train_docs`` and ``train_bytes`` allow; these
    bound what reaches the driver.  A document of more than a ``LONG``-th of the bytes is not
    learned from, and one that doesn't fit into what is left is passed over for those after it.
    """
    chosen = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (in_fold(F.col("doc_id")) != HELD_OUT))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = chosen.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id", F.lit("train")), "doc_id").limit(train_docs)
    sizes = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.max("size").alias("size"))
    taken, left = [], train_bytes
    for row in sizes.where(F.col("size") * LONG <= train_bytes).orderBy(F.xxhash64("doc_id", F.lit("train")), "doc_id").collect():  # train_docs rows
        if row.size <= left:
            taken.append((row.doc_id, row.y))
            left -= row.size
    fit = docs.sparkSession.createDataFrame(taken, sizes.select("doc_id", "y").schema)
    rows = texts.join(F.broadcast(fit), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return fitted([((r.text or "").encode(), r.y) for r in rows])


def scored(docs: DataFrame, model: LineModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None, with_lines: bool = False) -> DataFrame:
    """One row per document: the ``keep`` columns (default: doc_id), held_out, score, predicted and, on demand, line_scores.

    Texts are read whole, all lines of them.  A null text counts as empty, which is one empty
    line and has a score like any other; equal texts have equal scores; a null id is in no
    fold of its own but that of the empty string; an empty table gives an empty result; other
    columns aren't read.  No shuffle.
    """
    kept = [F.col(id_col).alias("doc_id")] if keep is None else [F.col(c) for c in keep]
    table = docs.select(*kept, (in_fold(F.col(id_col)) == HELD_OUT).alias("held_out"), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            texts = [(t or "").encode() for t in batch.column(batch.num_columns - 1).to_pylist()]
            for at, end in slices(texts):
                score, good, per_text = model.scores(texts[at:end])
                part = batch.slice(at, end - at)
                columns = [*part.columns[:-1], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]
                if with_lines:
                    columns.append(pa.array(np.split(good, np.cumsum(per_text)[:-1]), pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "score", "predicted", *["line_scores"] * with_lines])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields[:-1])
    return mapped(table, run, f"{kinds}, score double, predicted int{', line_scores array<double>' if with_lines else ''}")
