"""SimHash near-dedup with a pigeonring filter.

Fingerprints are 64 bits wide. Two of them link when at most ``budget`` bits differ.
Cut the bits into ``segments`` equal parts and lay them on a ring: if the whole ring
differs in at most ``budget`` bits, some start has every chain of ``l`` consecutive
segments from there differ in at most ``l * budget / segments`` bits (the chain form of
the pigeonhole principle). Chains whose allowance is below one bit must agree exactly,
so they form an equality key; the longer chains prune the pairs that share a key before
the full Hamming check.

Scale: equal fingerprints collapse to one row with their smallest id first, so copies
cost nothing. Keys shared by at most ``bucket`` fingerprints are paired directly. A key
shared by more of them (a large family of near copies) is resolved without pairs: each
member names every fingerprint within half the budget that has the same key, and
members that name the same one link through it. For an even budget this is exact: two
fingerprints within the budget have a midpoint within half of it of both, and two that
share such a point are within the budget. Rows then grow with members, not pairs.
Components come from star contraction over checkpoints.

Nulls, ties and the rest: null, empty and blank texts have fingerprint zero and link to
each other and to whatever is near zero; a text shorter than a shingle is one shingle;
rows that repeat are equal fingerprints; a null id takes part in linking but names a
component only where no row of it has an id; an empty table gives an empty result;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcore.llm.components import components
from panelcore.session import cut_lineage

BITS = 64
SEED = 42


def fingerprint(text: bytes, words: int = 5, block: int = 1 << 16) -> int:
    """SimHash of one text: majority of the bits of its shingles' hashes, repeats included."""
    w = text.lower().split()  # on bytes: lowers A-Z only, splits at ASCII white space
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for lo in range(0, n, block):  # a long text goes through in pieces
        part = [w[lo + k:min(lo + block, n) + k] for k in range(words)]
        raw = b"".join([digest(s, SEED) for s in map(b" ".join, zip(*part))])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", words)
                  for x in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))],
                ["doc_id", "fp"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, fp long")


def _cuts(segments: int) -> list[tuple[int, int]]:
    """(first bit from the right, width) of each segment."""
    edges = [round(i * BITS / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _masks(segments: int, budget: int, start: int) -> tuple[list[int], int, list[tuple[int, int]]]:
    """The bits of the exact chain from ``start``, their mask, and (mask, allowance) of
    the longer chains."""
    cuts = _cuts(segments)
    bits: list[int] = []
    exact: list[int] = []
    longer = []
    for length in range(1, segments):
        a, width = cuts[(start + length - 1) % segments]
        bits += range(a, a + width)
        allowed = length * budget // segments
        if allowed == 0:
            exact = list(bits)
        else:
            longer.append((sum(1 << b for b in bits), allowed))
    return exact, sum(1 << b for b in exact), longer


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def links(distinct: DataFrame, budget: int = 2, segments: int = 8, bucket: int = 64) -> DataFrame:
    """``u, v`` over distinct fingerprints ``fp``: edges whose closure is exactly the
    closure of "at most ``budget`` bits differ".

    ``v`` may be a point between members of one component that is itself no member.
    """
    if budget % 2:
        raise ValueError("crowded keys are exact for an even budget only")
    shapes = [_masks(segments, budget, s) for s in range(segments)]
    keys = F.array(*[
        F.struct(F.lit(s).alias("start"), F.col("fp").bitwiseAND(_signed(m)).alias("part"))
        for s, (_, m, _) in enumerate(shapes)
    ])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.start", "k.part")
    size = keyed.groupBy("start", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = cut_lineage(keyed.join(size, ["start", "part"]))

    # Short keys: pairs inside an array of at most `bucket` members.
    short = keyed.where(F.col("n") <= bucket).groupBy("start", "part").agg(
        F.sort_array(F.collect_list("fp")).alias("m")
    )
    pair = short.select("start", F.posexplode("m").alias("i", "u"), "m").select(
        "start", "u", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("v")
    )
    diff = F.col("u").bitwiseXOR(F.col("v"))
    chain = F.lit(False)
    for s, (_, _, longer) in enumerate(shapes):
        ok = F.col("start") == s
        for mask, allowed in longer:
            ok = ok & (F.bit_count(diff.bitwiseAND(_signed(mask))) <= allowed)
        chain = chain | ok
    pairs = pair.where(chain).where(F.bit_count(diff) <= budget).select("u", "v")

    # Crowded keys: meet at the points within half the budget, keeping the key's bits.
    crowded = keyed.where(F.col("n") > bucket)
    near = None
    for s, (exact, _, _) in enumerate(shapes):
        free = [b for b in range(BITS) if b not in set(exact)]
        flips = F.array(*[_signed(sum(1 << b for b in c))
                          for k in range(budget // 2 + 1) for c in combinations(free, k)])
        here = F.col("start") == s
        near = F.when(here, flips) if near is None else near.when(here, flips)
    star = crowded.select(F.col("fp").alias("u"), F.explode(near).alias("x")).select(
        "u", F.col("u").bitwiseXOR(F.col("x")).alias("v"))
    # A point that a single member names links nothing.
    named = star.distinct()
    shared = named.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("v")
    return pairs.union(named.join(shared, "v").select("u", "v"))


def near_duplicates(
    docs: DataFrame, words: int = 5, budget: int = 2, segments: int = 8, bucket: int = 64
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    rows = cut_lineage(fingerprints(docs, words))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("lowest"))
    comp = components(links(distinct.select("fp"), budget, segments, bucket))
    member = distinct.join(comp, distinct["fp"] == comp["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "lowest"
    )
    # Only fingerprints whose component reaches further than their own rows matter.
    linked = member.groupBy("root").agg(F.min("lowest").alias("component_id"))
    by_fp = member.join(linked, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_per_group(
    docs: DataFrame, words: int = 5, budget: int = 2, segments: int = 8, bucket: int = 64
) -> DataFrame:
    """The documents with all columns, of each near-duplicate group the one with the
    smallest id; of rows that repeat id and text one stays, and different texts under that
    id all do. Rows with a null id all stay: nothing names them."""
    keep = near_duplicates(docs, words, budget, segments, bucket).where(
        F.col("doc_id").eqNullSafe(F.col("component_id"))
    ).select(F.col("doc_id").alias("_id"))
    tagged = docs.withColumn("_text", F.md5(F.coalesce("text", F.lit(""))))
    named = tagged.join(keep, F.col("doc_id") == F.col("_id"), "left_semi")
    once = named.dropDuplicates(["doc_id", "_text"]).drop("_text")
    return once.union(docs.where("doc_id is null"))
