"""Mixing sources to target weights with hash-threshold histograms.

Every row gets a hash; a source takes the rows whose hash lies below its threshold. The
threshold is found without sorting: sizes are summed by source and leading hash bits,
the running sum shows the bucket in which the budget ends, and only that bucket is
histogrammed again by the next bits, level after level. A budget above the source's
size takes every row whole times and the rest by threshold, so no row is taken more than
``max_repeats`` times, and a larger budget always takes a superset of a smaller one.

Scale: one pass over the texts leaves narrow rows (id, source, size, hash) in the shared
checkpoint folder. Histograms combine before the shuffle, so a source with a third of
all rows adds at most one row per bucket and task. Windows run over the at most 2^12
buckets of one source. Per-source tables are broadcast only up to ``BROADCAST_ROWS``
sources (counted first) and joined by shuffle beyond. The driver sees two sums per
reshare round.

Nulls, ties and the rest: null sources are one source, ranked last; null and empty texts
have size zero and take nothing; rows equal in id and text share a hash and are taken
together; the rows at the last threshold are taken if that brings the source nearer to
its target; a source of size zero has target zero; an empty table gives an empty
result. Reruns agree, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcore.functions.ranks import global_row_number
from panelcore.llm.common import WORD, text_of
from panelcore.session import cut_lineage

LEVEL_BITS = 12
LEVELS = 5
BROADCAST_ROWS = 20_000
CYCLE = (5, 2, 1)


def _measures():
    """Words of the text, and 60 bits of hash."""
    return (
        F.regexp_count(text_of(), F.lit(WORD)).cast("long"),
        F.shiftrightunsigned(F.xxhash64("doc_id", text_of()), 64 - LEVELS * LEVEL_BITS),
    )


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, h``."""
    size, h = _measures()
    return docs.select("doc_id", "source", size.alias("size"), h.alias("h"))


def source_targets(rows: DataFrame, cycle: tuple[float, ...] = CYCLE, max_repeats: int = 3,
                   share: float = 1.0) -> DataFrame:
    """``source, source_size, target``: shares of ``share`` of all sizes, by weight.

    Weights go round ``cycle`` over the sources in code-point order, null last. A target
    stops at ``max_repeats`` times the source's size; what is cut off is shared among
    the others by weight until none is above.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = global_row_number(
        per.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_rank"
    )
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]),
                          ((F.col("_rank") - 1) % len(cycle) + 1).cast("int"))
    per = cut_lineage(per.select(
        "source", "source_size", weight.alias("_w"),
        (F.col("source_size") * max_repeats).cast("double").alias("_most"),
    ))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        # The level rises from round to round, so a capped source stays capped.
        full = F.col("_most") < F.col("_w") * level
        spent, open_w, n = per.agg(
            F.sum(F.when(full, F.col("_most")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("_w"))),
            F.sum(full.cast("int")),
        ).first()
        if not open_w or n == capped:
            break
        level, capped = max(level, (share * total - spent) / open_w), n
    return per.select(
        "source", "source_size",
        F.least(F.col("_most"), F.col("_w") * level).alias("target"),
    )


def _attach(rows: DataFrame, per_source: DataFrame, n_sources: int) -> DataFrame:
    small = F.broadcast(per_source) if n_sources <= BROADCAST_ROWS else per_source
    names = [c for c in per_source.columns if c != "source"]
    return rows.alias("r").join(
        small.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))
    ).select("r.*", *[f"s.{c}" for c in names])


def _edges(rows: DataFrame, need: DataFrame, n_sources: int) -> DataFrame:
    """``source, cut, tie, over``: per source the hash at which ``left`` is reached.

    Rows with a hash below ``cut`` fit; ``tie`` says whether those at the cut are taken
    too, which holds if they come nearer to ``left``. ``over`` is what is missing
    without them.
    """
    state = need.where("left > 0").select("source", "left", F.lit(0).cast("long").alias("cut"))
    w = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    for level in range(LEVELS):
        shift = (LEVELS - 1 - level) * LEVEL_BITS
        here = _attach(rows, state, n_sources)
        if level:
            here = here.where(F.shiftrightunsigned("h", shift + LEVEL_BITS) == F.col("cut"))
        hist = here.groupBy("source", F.shiftrightunsigned("h", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.first("left").alias("left")
        )
        run = hist.withColumn("upto", F.sum("words").over(w))
        # The boundary is the first bucket that reaches what is left.
        edge = run.where("upto >= left").groupBy("source").agg(
            F.min(F.struct("bucket", F.expr("left - (upto - words)").alias("left"), "words"))
            .alias("e")
        )
        state = cut_lineage(edge.select(
            "source", F.col("e.left").alias("left"), F.col("e.bucket").alias("cut"),
            F.col("e.words").alias("words"),
        ))
        if level < LEVELS - 1:
            state = state.drop("words")
    return state.select("source", "cut", (F.col("left") * 2 >= F.col("words")).alias("tie"),
                        F.col("left").alias("over"))


def _below(cut: str, tie: str):
    return F.coalesce(
        (F.col("h") < F.col(cut)) | ((F.col("h") == F.col(cut)) & F.col(tie)), F.lit(False)
    )


def plan_of(rows: DataFrame, cycle: tuple[float, ...] = CYCLE, max_repeats: int = 3,
            share: float = 1.0) -> DataFrame:
    """One row per source: ``source, source_size, target``, whole times ``_whole``, and
    the thresholds.

    The rows at the first threshold may be long and are left out; what is missing then
    is filled by a second threshold over the untaken rows of at most a quarter of it.
    A source too short for that takes them as far as they go.
    """
    per = cut_lineage(source_targets(rows, cycle, max_repeats, share))
    n_sources = per.count()
    whole = F.when(
        F.col("source_size") > 0,
        F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats)),
    ).otherwise(0).cast("int")
    per = per.withColumn("_whole", whole)
    rest = F.when(F.col("_whole") < max_repeats,
                  F.col("target") - F.col("_whole") * F.col("source_size")).otherwise(0.0)
    first = cut_lineage(_edges(rows, per.select("source", rest.alias("left")), n_sources).select(
        "source", F.col("cut").alias("_cut"), (F.col("over") / 4).alias("_short"), "over"
    ))
    short = _attach(rows, first, n_sources).where(
        (F.col("h") >= F.col("_cut")) & (F.col("size") <= F.col("_short"))
    ).select(*rows.columns)
    # Where all short rows together stay below what is missing, all are taken.
    room = short.groupBy("source").agg(F.sum("size").alias("_room"))
    second = _edges(short, first.select("source", F.col("over").alias("left")), n_sources)
    null_safe = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    return cut_lineage(
        per.alias("p")
        .join(first.alias("f"), null_safe("p", "f"), "left")
        .join(room.alias("r"), null_safe("p", "r"), "left")
        .join(second.alias("s"), null_safe("p", "s"), "left")
        .select("p.*", "f._cut", "f._short",
                F.coalesce(F.col("r._room") < F.col("f.over"), F.lit(False)).alias("_all"),
                F.col("s.cut").alias("_cut2"), F.col("s.tie").alias("_tie2"))
    )


def _copies():
    again = (F.col("h") < F.col("_cut")) | (
        (F.col("size") <= F.col("_short")) & (F.col("_all") | _below("_cut2", "_tie2"))
    )
    return F.when(
        F.col("size") > 0, F.col("_whole") + F.coalesce(again, F.lit(False)).cast("int")
    ).otherwise(0)


def mix(docs: DataFrame, cycle: tuple[float, ...] = CYCLE, max_repeats: int = 3,
        share: float = 1.0) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row."""
    rows = cut_lineage(sized(docs))
    plan = plan_of(rows, cycle, max_repeats, share)
    out = _attach(rows, plan, plan.count()).withColumn("copies", _copies())
    return out.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, cycle: tuple[float, ...] = CYCLE, max_repeats: int = 3,
               share: float = 1.0) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    The plan has one row per source, so the texts are read again but not shuffled.
    """
    rows = cut_lineage(sized(docs))
    plan = plan_of(rows, cycle, max_repeats, share)
    n_sources = plan.count()
    clear = docs.select(F.struct(*docs.columns).alias("_row"), "source", *[
        c.alias(n) for n, c in zip(("size", "h"), _measures())
    ])
    return _attach(clear, plan, n_sources).withColumn("_n", _copies()).where("_n > 0").withColumn(
        "_nth", F.explode(F.sequence(F.lit(1), F.col("_n")))
    ).select("_row.*")
