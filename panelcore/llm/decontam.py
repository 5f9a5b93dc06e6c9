r"""Benchmark decontamination by winnowing.

A text's words are its runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` with A-Z lowered. Over
every ``span`` consecutive words the smallest hash of the ``gram``-word grams inside
is kept. Two texts that share ``span`` words keep the same hash there, so joining the
kept hashes of documents and items misses no shared span. Hits are then extended: in a
document with hits each span whose smallest hash was hit is compared, as text, with
the items' spans; what remains is exact. Items shorter than ``span`` are one window of
their own length; for the lengths that occur (at most ``span - 1``) every document
position is hashed at that length too.

Scale: only built-in functions; nothing but hashes is exploded, so each document word
costs a fraction of a row of 24 bytes. Item hashes are broadcast up to
``BROADCAST_ROWS`` of them (counted first) and joined by shuffle beyond. Equal texts
are judged once, under a digest of the text. No pair of document and item is formed
before a shared window is proven, and windows common to many items are matched once.

Nulls, ties and the rest: null and empty texts have no words; items without words are
left out; an item id that repeats stands for all its texts and is counted once; a null
item id marks words as hit but is not counted or listed; null document ids are results
like others; empty tables give no hits or no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcore.llm.common import lower_ascii, text_of
from panelcore.session import cut_lineage

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 1_000_000


def words_of() -> Column:
    return F.array_remove(F.split(lower_ascii(text_of()), NOT_WORD), "")


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once however often it is used."""
    return F.transform(F.array(value), body)[0]


def _upto(n: Column) -> Column:
    """1, 2, ... n; empty below 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _grams(words: Column, gram: int) -> Column:
    return F.transform(_upto(F.size(words) - (gram - 1)), lambda i: F.xxhash64(F.slice(words, i, gram)))


def _kept(words: Column, span: int, gram: int, short: list[int]) -> Column:
    """The winnowed hashes of a text, and its hashes at the short lengths."""
    width = span - gram + 1
    spans = _let(_grams(words, gram), lambda g: F.transform(
        _upto(F.size(g) - (width - 1)), lambda i: F.array_min(F.slice(g, i, width))))
    parts = [spans] + [_grams(words, n) for n in short]
    return F.array_distinct(F.concat(*parts) if short else spans)


def _windows(words: Column, hit: Column, span: int, gram: int, short: list[int]) -> Column:
    """(start, len, win) of the windows whose hash is among ``hit``."""
    width = span - gram + 1

    def cut(n: int, starts: Column) -> Column:
        return F.transform(starts, lambda i: F.struct(
            i.alias("start"), F.lit(n).alias("len"), F.array_join(F.slice(words, i, n), " ").alias("win")))

    full = cut(span, _let(_grams(words, gram), lambda g: F.filter(
        _upto(F.size(g) - (width - 1)),
        lambda i: F.array_contains(hit, F.array_min(F.slice(g, i, width))))))

    def shorter(n: int) -> Column:
        return cut(n, F.filter(_upto(F.size(words) - (n - 1)),
                               lambda i: F.array_contains(hit, F.xxhash64(F.slice(words, i, n)))))

    parts = [full, *map(shorter, short)]
    return F.concat(*parts) if short else full


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, items: DataFrame, span: int = 13, gram: int = 5,
                  share: int = 20) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row.

    A document is contaminated if at least one word in ``share`` is hit.
    """
    keyed = docs.select("doc_id", "text", F.md5(text_of()).alias("key"))
    by_text = judged_texts(keyed, items, span, gram)
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (
        keyed.select("doc_id", "key", F.size(words_of()).cast("long").alias("n_words"))
        .join(by_text, "key", "left")
        .select(
            "doc_id", "n_words", n_hit.alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        )
    )


def judged_texts(keyed: DataFrame, items: DataFrame, span: int, gram: int) -> DataFrame:
    """``key, n_hit, n_items, items_sha256`` of the texts that share a window."""
    item = cut_lineage(items.select("item_id", words_of().alias("w")).where(F.size("w") > 0))
    short = sorted(r[0] for r in item.where(F.size("w") < span)
                   .select(F.size("w")).distinct().collect())  # at most span - 1 numbers
    window = item.select("item_id", "w", F.explode(
        _upto(F.greatest(F.size("w") - (span - 1), F.lit(1)))).alias("i"))
    window = cut_lineage(window.select(
        "item_id", F.array_join(F.slice("w", F.col("i"), span), " ").alias("win")).distinct())
    marks = item.select(F.explode(
        F.when(F.size("w") < span, F.array(F.xxhash64("w"))).otherwise(
            _let(F.col("w"), lambda w: _kept(w, span, gram, [])))).alias("mark")).distinct()

    seen = keyed.select("key", F.explode(
        _let(words_of(), lambda w: _kept(w, span, gram, short))).alias("mark"))
    hits = seen.join(_bounded(cut_lineage(marks)), "mark", "left_semi").groupBy("key").agg(
        F.collect_set("mark").alias("hit"))
    hits = cut_lineage(hits)

    # One row per text; only texts with hits are read into the join.
    cand = keyed.join(hits, "key").groupBy("key").agg(
        F.first("text").alias("text"), F.first("hit").alias("hit"))
    shown = cand.select("key", F.explode(F.transform(
        F.array(F.struct(words_of().alias("w"), F.col("hit").alias("h"))),
        lambda s: _windows(s["w"], s["h"], span, gram, short))[0]).alias("x")).select("key", "x.*")
    found = cut_lineage(shown.join(window.select("win").distinct(), "win", "left_semi"))

    n_hit = found.select("key", F.explode(
        F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("at")
    ).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select("key", "win").distinct().join(window, "win").where(
        "item_id is not null").select("key", F.col("item_id").cast("string").alias("id")).distinct()
    listed = named.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("id")), ","), 256).alias("items_sha256"))
    return n_hit.join(listed, "key", "left")


def clean_rows(docs: DataFrame, items: DataFrame, span: int = 13, gram: int = 5,
               share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    keyed = docs.select("text", F.md5(text_of()).alias("key"))
    by_text = judged_texts(keyed, items, span, gram).select(
        F.col("key").alias("_key"), F.col("n_hit").alias("_hits"))
    tagged = docs.withColumn("_md5", F.md5(text_of()))
    bad = (F.col("_md5") == F.col("_key")) & (F.col("_hits") * share >= F.size(words_of()))
    return tagged.join(cut_lineage(by_text), bad, "left_anti").drop("_md5")
