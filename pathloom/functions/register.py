"""Functions of the engine by name for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.semantic import CHUNK_TYPE, cut_chunks, kept_chunks
from ..sources.documents import EXTRACTORS, ExtractError
from . import fuzzy
from .calc import shown_values


def register(spark: SparkSession) -> None:
    """Registers fuzzy_score, match_positions, chunk_text, extract_text and calc_eval."""

    @F.pandas_udf("long")
    def fuzzy_score(texts: pd.Series, patterns: pd.Series) -> pd.Series:
        out = pd.Series(-1, index=texts.index)
        for pattern, part in texts.fillna("").groupby(patterns.fillna("")):
            out[part.index] = fuzzy.scores(part.tolist(), pattern)
        return out

    @F.pandas_udf("array<int>")
    def match_positions(texts: pd.Series, patterns: pd.Series) -> pd.Series:
        return pd.Series([fuzzy.positions(t or "", p or "") for t, p in zip(texts, patterns)])

    @F.pandas_udf(CHUNK_TYPE)
    def chunk_text(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found = cut_chunks(text or "")
            out.append([{"chunk_ix": k, "line_start": found[k][0], "text": found[k][1]} for k in kept_chunks(len(found))])
        return pd.Series(out)

    @F.pandas_udf("string")
    def extract_text(paths: pd.Series, contents: pd.Series) -> pd.Series:
        out = []
        for path, content in zip(paths, contents):
            try:
                out.append(EXTRACTORS.get(path.rpartition(".")[2].lower(), lambda d: d.decode())(bytes(content)))
            except (ExtractError, UnicodeDecodeError, RecursionError, AttributeError, TypeError):
                out.append(None)
        return pd.Series(out)

    @F.pandas_udf("string")
    def calc_eval(texts: pd.Series) -> pd.Series:
        return shown_values(texts)

    for f in (fuzzy_score, match_positions, chunk_text, extract_text, calc_eval):
        spark.udf.register(f.__name__, f)
