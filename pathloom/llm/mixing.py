"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Sizes are summed by source; a water level found by a few aggregates gives each source its
target.  A source's documents are taken whole: ``floor(target / size)`` times all of them,
and once more those whose hash lies below a threshold.  Thresholds come from histograms of
size by (source, 12 bits of the hash); only the bucket in which a budget ends is opened by
the next 12 bits, so no rows are sorted.  What a threshold leaves over (less than one
document) is filled from smaller documents further on in hash order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import attached, dropped, small, written

WEIGHTS = (5, 2, 1)
CAP = 3
BITS, LEVELS = 12, 5
#: Fill passes after which a budget's rest is left.
PASSES = 4
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Sources in code point order, null last, with ``place`` from 0.  Range partitions, so no task holds all of them."""
    sums = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("group_size"))
    placed = written(sums.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))  # a row for each range partition
    ahead = parts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("ahead"))
    place = F.col("ahead") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(F.broadcast(ahead), "part").select("skey", "source", "source_size", "group_size", place.alias("place"))


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds ``target``: weight shares of all sizes, stopped at ``cap`` times the source, the excess shared again by weight.

    Sharing the excess by weight keeps all uncapped targets at one level times their weight,
    so only that level is sought: two sums a round, until no further source is capped.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * cap)
    whole = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level, capped = (whole[0] / whole[1] if whole[1] else 0.0), -1
    while True:
        over = F.col("most") <= F.lit(level) * F.col("weight")
        now, held, free = sources.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if now == capped or not free:
            break
        capped, level = now, (whole[0] - held) / free
    return sources.withColumn("target", F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight")))


def _joined(rows: DataFrame, per_source: DataFrame, few: bool, total: int) -> DataFrame:
    return rows.join(F.broadcast(per_source), "skey") if few else attached(rows, per_source, ["skey"], total)


def _taken(fills: list[str]) -> Column:
    """Whether a row is in one of a source's fills (arrays of (below, most) thresholds)."""
    out = F.lit(False)
    for below, most in fills:
        out = out | ((F.col("h") < F.col(below)) & (F.col("size") <= F.col(most)))
    return out


def _filled(rows: DataFrame, plan: DataFrame, fills: list[tuple[str, str]], few: bool, total: int, last: bool, k: int) -> DataFrame:
    """``plan`` with thresholds (below_k, most_k) that spend ``rest``, and the new ``rest``."""
    free = BITS * LEVELS
    state = plan.select("skey", "group_size", "rest", *[c for pair in fills for c in pair], F.floor("rest").cast("long").alias("most"), F.lit(0).cast("long").alias("prefix")).where("rest > 0")
    if last:
        state = state.withColumn("most", F.lit((1 << 62)).cast("long"))
    state, done = state.withColumn("open_rest", F.col("rest")), None
    for level in range(1, LEVELS + 1):
        shift = free - BITS * level
        bucket = F.shiftright("h", shift)
        here = _joined(rows, state, few, total).where(~_taken(fills) & (F.col("size") > 0) & (F.col("size") <= F.col("most")) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        bars = here.groupBy("skey", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
        upto = F.sum("words").over(Window.partitionBy("skey").orderBy("bucket"))
        ended = bars.select("skey", "bucket", "words", "docs", upto.alias("upto")).join(state.select("skey", "open_rest"), "skey")
        # the first bucket in which the budget ends; if none is left, the sources' whole range is taken
        edge = ended.groupBy("skey").agg(
            F.min(F.when(F.col("upto") > F.col("open_rest"), F.struct("bucket", "words", "docs", "upto"))).alias("edge"),
            F.max("upto").alias("all"),
        )
        moved = written(state.join(edge, "skey"), "levels")
        full = moved.where("edge is null").select("skey", F.shiftleft("prefix", shift + BITS).alias("low"), (F.col("open_rest") - F.col("all")).alias("left"), F.shiftleft(F.col("prefix") + 1, shift + BITS).alias("below"), "most")
        before = F.col("open_rest") - (F.col("edge.upto") - F.col("edge.words"))
        inner = moved.where("edge is not null").withColumn("open_rest", before).withColumn("prefix", F.col("edge.bucket"))
        at_end = (F.col("edge.docs") == 1) | F.lit(level == LEVELS)
        nearer = F.lit(last) & (F.col("edge.words") < 2 * F.col("open_rest"))
        closed = inner.where(at_end).select("skey", F.lit(0).cast("long").alias("low"), F.when(nearer, F.col("open_rest") - F.col("edge.words")).otherwise(F.col("open_rest")).alias("left"), F.shiftleft(F.col("prefix") + nearer.cast("long"), shift).alias("below"), "most")
        found = full.drop("low").unionByName(closed.drop("low"))
        done = found if done is None else done.unionByName(found)
        state = inner.where(~at_end).select(*state.columns)
        if level == LEVELS or not state.take(1):
            break
    got = done.select("skey", F.col("left"), F.col("below").alias(f"below{k}"), F.col("most").alias(f"most{k}"))
    return written(plan.join(got, "skey", "left").withColumn("rest", F.coalesce("left", "rest")).drop("left").na.fill(0, [f"below{k}", f"most{k}"]), "plan")


def _keyed(docs: DataFrame, keep: list[str], id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The ``keep`` columns of ``docs`` with the names this module works on."""
    source = F.col(source_col)
    return docs.select(
        *[F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)],
        F.col(id_col).alias("doc_id"), source.alias("source"),
        F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source)).alias("skey"),
        word_count(F.col(text_col)).alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("mix")), 64 - BITS * LEVELS).alias("h"),
    )


def mixed(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: the ``keep`` columns (default: doc_id), size, source_size, target, taken, copies.

    ``taken`` is size times ``copies``, the number of times the mix holds the document.  The
    choice depends on doc_id alone, so reruns agree and a larger budget only adds documents
    of the first fill.  Null texts have size 0 and take nothing; a null source is a source of
    its own, last in order; rows with one doc_id (or none) share a hash and are in or out
    together; an empty table gives an empty result.  Other columns are not read.

    The kept columns never move: the sources' thresholds are broadcast to them.
    """
    rows = written(_keyed(docs, [], id_col, text_col, source_col), "sizes")
    total = rows.count()
    sources = with_targets(ranked_sources(rows), weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.least(F.lit(cap), F.floor(ratio + 1e-12)).cast("long"))
    plan = written(sources.withColumn("rest", F.greatest(F.lit(0.0), F.when(F.col("whole") >= cap, 0.0).otherwise(F.col("target") - F.col("whole") * F.col("source_size")))), "plan")
    few, fills, slim = small(plan), [], rows.select("doc_id", "skey", "size", "h")
    for k in range(PASSES):
        if not plan.where("rest > greatest(1.0, 0.0005 * target)").take(1):
            break
        grown = _filled(slim, plan, fills, few, total, k == PASSES - 1, k)
        dropped(plan)
        plan, fills = grown, [*fills, (f"below{k}", f"most{k}")]
    per_source = plan.select("skey", "group_size", "source_size", "target", "whole", *[c for pair in fills for c in pair])
    names = ["doc_id"] if keep is None else keep
    out = _joined(slim.withColumn("keep_0", F.col("doc_id")) if keep is None else _keyed(docs, keep, id_col, text_col, source_col), per_source, few, total)
    copies = F.when(F.col("size") > 0, F.col("whole") + _taken(fills).cast("long")).otherwise(F.lit(0).cast("long"))
    return out.select(*[F.col(f"keep_{k}").alias(c) for k, c in enumerate(names)], "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))
