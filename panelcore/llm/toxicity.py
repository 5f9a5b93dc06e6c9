"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is
cut into windows of ``WINDOW`` words; each window is compressed with either dictionary,
and the bytes that the toxic one saves are the window's distance. A window counts as
toxic from a threshold on; threshold and the weights that turn a text's windows into a
score are calibrated on texts whose dictionaries were trained without them. Words above
``PIECE`` bytes (text without spaces) count as overlapping pieces, so that no window is
longer than the compressor can look back to its dictionary.

Training a dictionary here means choosing its bytes: byte grams inside words that are
frequent in one class and several times rarer in the other, chained where they
overlap, ahead of a base of words common to both classes. Both dictionaries share the
base, so a window of ordinary text compresses to the same length with either.
(The library's own trainer was tried first; it fills both dictionaries with frequent
ordinary words, and held-out ranking stayed below 0.82.)

Scale: the classifier is fitted on at most ``per_class`` labelled texts of each class
(those with the smallest id hashes; class rates come from all labelled training rows).
Gram counts are summed by Spark; the driver sees only grams and words above a share of
the sample, whose number is bounded by the sample, and five numbers per sample text.
Scoring reads every whole text once, in Python tasks over Arrow batches, without a
shuffle.

Nulls, ties and the rest: null and empty texts have no windows and get the score of
that; labels that repeat count once; with no labels all scores are 0, with labels of one
class only all scores are that class; rows that repeat repeat in the result; empty
tables give empty results; labels, lang, source and ids never enter a score.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcore.llm.common import bounded_sample, id_fold, labelled, text_of
from panelcore.session import cut_lineage

WINDOW = 10
GRAM = 6
#: Ten pieces and a dictionary stay below the compressor's 8 KB.
PIECE, OVERLAP = 256, 16
BASE_BYTES, CLASS_BYTES = 3000, 1500
SUPPORT, RATIO, LEAST = 0.03, 6.0, 4
BASE_WORDS = 5000
PARTS = 5
STATS = ("windows", "largest", "mean", "top", "c2", "c3", "c4", "c5", "c6")
THRESHOLDS = (2, 3, 4, 5, 6)


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: int
    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  # the first is the intercept
    constant: float | None = None


# --- dictionaries -----------------------------------------------------------------

def _words(text: bytes) -> list[bytes]:
    """Lower-case words; longer ones than ``PIECE`` as pieces that overlap."""
    out = []
    for w in text.lower().split():
        if len(w) <= PIECE:
            out.append(w)
        else:
            out += [w[i:i + PIECE] for i in range(0, len(w) - OVERLAP, PIECE - OVERLAP)]
    return out


def _grams(word: bytes) -> set[bytes]:
    w = b" " + word + b" "
    return {w[i:i + GRAM] for i in range(max(1, len(w) - GRAM + 1))}


def _counts(sample: DataFrame) -> DataFrame:
    """``kind, item, n0, n1``: per class the texts of each part that hold a gram (kind 0)
    or a word (kind 1), as arrays over the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            for text, y, part in zip(b["text"], b["y"].to_pylist(), b["part"].to_pylist()):
                words = set(_words(text.as_py().encode()))
                grams = set().union(*map(_grams, words)) if words else set()
                n.update((part, y, 1, w) for w in words)
                n.update((part, y, 0, g) for g in grams)
            keys = list(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                pa.array([k[2] for k in keys], pa.int32()), pa.array([k[3] for k in keys], pa.binary()),
                pa.array(list(n.values()), pa.int64())], ["part", "y", "kind", "item", "n"])

    parts = sample.select("text", "y", "part").mapInArrow(
        run, "part int, y int, kind int, item binary, n long")
    sums = parts.groupBy("kind", "item").agg(*[
        F.sum(F.when((F.col("y") == y) & (F.col("part") == p), F.col("n")).otherwise(0)).alias(f"c{y}_{p}")
        for y in (0, 1) for p in range(PARTS)])
    return sums.select("kind", "item", *[
        F.array(*[f"c{y}_{p}" for p in range(PARTS)]).alias(f"n{y}") for y in (0, 1)])


def _worth_collecting(counts: DataFrame, n: dict[int, int]) -> list:
    """Grams that can tell the classes apart with any one part left out, and the most
    frequent words: a list whose length depends on the sample's bound only."""
    total = {y: F.aggregate(f"n{y}", F.lit(0).cast("long"), lambda a, x: a + x) for y in (0, 1)}

    def tells(a: int, b: int):
        least = max(LEAST, 0.7 * SUPPORT * n[a])
        rarer = (total[a] + 0.5) / n[a] > 0.5 * RATIO * (total[b] + 0.5) / n[b]
        return (total[a] >= least) & rarer

    grams = counts.where((F.col("kind") == 0) & (tells(0, 1) | tells(1, 0)))
    words = counts.where("kind = 1").orderBy(F.desc(total[0] + total[1]), "item").limit(BASE_WORDS)
    return grams.collect() + words.collect()


def _telling(mine: dict[bytes, int], n_mine: int, other: dict[bytes, int], n_other: int) -> dict[bytes, int]:
    """Grams in at least ``SUPPORT`` of one class and ``RATIO`` times rarer in the other."""
    least = max(LEAST, SUPPORT * n_mine)
    return {g: c for g, c in mine.items()
            if c >= least and (c + 0.5) / n_mine > RATIO * (other.get(g, 0) + 0.5) / n_other}


def _chained(mine: dict[bytes, int], n_mine: int, other: dict[bytes, int], n_other: int) -> bytes:
    """Grams of one class that the other lacks, overlapping ones joined, best last."""
    good = _telling(mine, n_mine, other, n_other)
    after, before = defaultdict(list), defaultdict(list)
    for g in good:
        after[g[:-1]].append(g)
        before[g[1:]].append(g)
    used: set[bytes] = set()
    out: list[bytes] = []
    size = 0
    for g in sorted(good, key=lambda g: (-good[g], g)):
        if g in used:
            continue
        used.add(g)
        s, floor = g, 0.3 * good[g]

        def best(options: list[bytes]) -> bytes | None:
            free = [x for x in options if x not in used and good[x] >= floor]
            return max(free, key=lambda x: (good[x], x)) if free else None

        while (x := best(after.get(s[-GRAM + 1:], []))) is not None:
            used.add(x)
            s += x[-1:]
        while (x := best(before.get(s[:GRAM - 1], []))) is not None:
            used.add(x)
            s = x[:1] + s
        out.append(s)
        size += len(s)
        if size >= CLASS_BYTES:
            break
    return b"".join(reversed(out))


def _base(words: dict[bytes, int], telling: set[bytes]) -> bytes:
    """Common words that cover the most text: greedy over the weight of uncovered grams.

    Words with a gram that tells the classes apart stay out.
    """
    chosen = heapq.nlargest(BASE_WORDS, words, key=lambda w: (words[w], w))
    chosen = [w for w in chosen if not telling & _grams(w)]
    weight: Counter = Counter()
    for w in chosen:
        for g in _grams(w):
            weight[g] += words[w]

    def gain(w: bytes) -> float:
        return sum(weight[g] for g in _grams(w)) / (len(w) + 1)

    heap = [(-gain(w), w) for w in chosen]
    heapq.heapify(heap)
    out: list[bytes] = []
    size = 0
    while heap and size < BASE_BYTES:
        _, w = heapq.heappop(heap)
        now = gain(w)
        if now <= 0:
            continue
        if heap and -now > heap[0][0]:
            heapq.heappush(heap, (-now, w))
            continue
        out.append(w)
        size += len(w) + 1
        for g in _grams(w):
            weight[g] = 0
    return b" " + b" ".join(reversed(out)) + b" "


def _dictionaries(rows: list, but: int | None, n: dict[int, int]) -> tuple[bytes, bytes]:
    """Dictionaries from all parts but one."""
    grams = {0: {}, 1: {}}
    words: dict[bytes, int] = {}
    for r in rows:
        c = [sum(v for p, v in enumerate(r[f"n{y}"]) if p != but) for y in (0, 1)]
        if r["kind"] == 1:
            words[bytes(r["item"])] = sum(c)
        else:
            for y in (0, 1):
                grams[y][bytes(r["item"])] = c[y]
    base = _base(words, set(_telling(grams[1], n[1], grams[0], n[0]))
                 | set(_telling(grams[0], n[0], grams[1], n[1])))
    return (_chained(grams[1], n[1], grams[0], n[0]) + base,
            _chained(grams[0], n[0], grams[1], n[1]) + base)


# --- window statistics ------------------------------------------------------------

def _compressor(content: bytes) -> zs.ZstdCompressor:
    params = zs.ZstdCompressionParameters(
        format=zs.FORMAT_ZSTD1_MAGICLESS, write_checksum=0, write_content_size=0, write_dict_id=0,
        strategy=zs.STRATEGY_GREEDY, min_match=5, window_log=13, hash_log=11, chain_log=12,
        search_log=3)
    d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(dict_data=d, compression_params=params)


def window_stats(text: bytes, toxic, ordinary) -> list[float]:
    """``STATS`` of one text."""
    w = _words(text)
    saved = []
    for i in range(0, len(w), WINDOW):
        win = b" " + b" ".join(w[i:i + WINDOW]) + b" "
        saved.append(len(ordinary(win)) - len(toxic(win)))
    if not saved:
        return [0.0] * len(STATS)
    d = np.array(saved)
    top = np.partition(d, -3)[-3:] if len(d) > 3 else d
    return [float(len(d)), float(d.max()), float(d.mean()), float(top.mean()),
            *[float((d >= t).sum()) for t in THRESHOLDS]]


def _design(stats: np.ndarray, threshold: int) -> np.ndarray:
    n, count = stats[:, 0], stats[:, 4 + THRESHOLDS.index(threshold)]
    return np.c_[stats[:, 1], stats[:, 2], stats[:, 3], np.log1p(count), count / np.maximum(n, 1),
                 np.log1p(n)]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    center, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - center) / scale]
    b = np.zeros(z.shape[1])
    ridge = np.r_[0.0, np.ones(z.shape[1] - 1)] * 0.5
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-6)
        b = b + np.linalg.solve(h, z.T @ (w * (y - p)) - ridge * b)
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ b, -30, 30))), 1e-9, 1 - 1e-9)
    loss = -float((w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
    return center, scale, b, loss


def fit(docs: DataFrame, ids: DataFrame, per_class: int = 4000) -> Model:
    """A model from the texts of ``docs`` and the labels ``doc_id, y``."""
    rates = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(rates) < 2:
        return Model(b"", b"", 2, (), (), (), float(max(rates, default=0)))
    part = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(PARTS)).cast("int")
    sample = bounded_sample(docs, ids, per_class).withColumn("part", part)
    sample = cut_lineage(sample.dropDuplicates(["text"]))
    n = {(r["part"], r["y"]): r["n"] for r in
         sample.groupBy("part", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = {y: max(1, sum(v for (_, c), v in n.items() if c == y)) for y in (0, 1)}
    counts = _worth_collecting(cut_lineage(_counts(sample)), size)

    def trained(but: int | None) -> tuple[bytes, bytes]:
        left = {y: max(1, size[y] - n.get((but, y), 0)) for y in (0, 1)}
        return _dictionaries(counts, but, left)

    # Each part is scored with dictionaries of the other parts.
    pairs = {p: trained(p) for p in range(PARTS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {h: tuple(_compressor(c).compress for c in p) for h, p in pairs.items()}
        for b in batches:
            s = [window_stats(t.as_py().encode(), *made[h])
                 for t, h in zip(b["text"], b["part"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b["y"], pa.array(s, pa.list_(pa.float64()))], ["y", "stats"])

    got = sample.select("text", "part", "y").mapInArrow(run, "y int, stats array<double>").collect()
    y = np.array([r["y"] for r in got], float)
    stats = np.array([r["stats"] for r in got], float)
    share = {c: rates[c] / max(1, (y == c).sum()) for c in (0, 1)}
    w = np.where(y == 1, share[1], share[0])
    w = w / w.mean()
    fits = [(_logistic(_design(stats, t), y, w), t) for t in THRESHOLDS]
    (center, scale, b, _), threshold = min(fits, key=lambda f: f[0][3])
    toxic, ordinary = trained(None)
    return Model(toxic, ordinary, threshold, tuple(center), tuple(scale), tuple(b))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.constant is None:
            toxic, ordinary = _compressor(model.toxic).compress, _compressor(model.ordinary).compress
        for b in batches:
            if model.constant is not None:
                p = np.full(b.num_rows, model.constant)
            elif b.num_rows:
                s = np.array([window_stats(t.as_py().encode(), toxic, ordinary) for t in b["text"]])
                z = (_design(s, model.threshold) - np.array(model.center)) / np.array(model.scale)
                t = model.weights[0] + z @ np.array(model.weights[1:])
                p = 1 / (1 + np.exp(-np.clip(t, -30, 30)))
            else:
                p = np.zeros(0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(p)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0,
           cut: float = 0.5, per_class: int = 4000) -> DataFrame:
    """``doc_id, held_out, score, predicted``; rows of fold ``held`` teach nothing."""
    train = docs.where(id_fold(F.col("doc_id"), folds) != held)
    model = fit(train, labelled(train, labels, "toxic"), per_class)
    return scores(docs, model).select(
        "doc_id", (id_fold(F.col("doc_id"), folds) == held).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0,
               cut: float = 0.5, per_class: int = 4000) -> DataFrame:
    """The documents whose score is below ``cut``, with all their columns."""
    train = docs.where(id_fold(F.col("doc_id"), folds) != held)
    model = fit(train, labelled(train, labels, "toxic"), per_class)
    keep = filter_column(model, cut)
    return docs.where(keep(text_of()))


def filter_column(model: Model, cut: float):
    """A column function: is the text's score below ``cut``?"""

    @F.pandas_udf("boolean")
    def below(text):
        import pandas as pd

        if model.constant is not None:
            return pd.Series(np.full(len(text), model.constant < cut))
        if not len(text):
            return pd.Series([], dtype=bool)
        toxic, ordinary = _compressor(model.toxic).compress, _compressor(model.ordinary).compress
        s = np.array([window_stats(t.encode(), toxic, ordinary) for t in text])
        z = (_design(s, model.threshold) - np.array(model.center)) / np.array(model.scale)
        return pd.Series(1 / (1 + np.exp(-np.clip(model.weights[0] + z @ np.array(model.weights[1:]), -30, 30))) < cut)

    return below
