"""Near-dedup by SimHash groups, completed to the exact similarity of word shingles.

Two texts are near copies when the sets of their ``words``-word shingles have a Jaccard
similarity of at least ``similarity``. The groups of op6's operator (64-bit SimHash,
pigeonring chains, star contraction) come first; every member is checked against the head
of its group on the shingles of both whole texts. At 0.8 two SimHashes differ by about ten
bits, more than an equality key on 64 can bridge, so an exact search follows:

1. MinHash (``BANDS`` keys of ``ROWS`` minima) tells which texts may have a partner at all;
   each misses a pair at 0.8 with a chance of 0.00007.
2. Stars: in its most crowded key a text is compared with the ``pivots`` texts that share
   most keys with others. So a family of copies costs a few comparisons per member.
3. Prefix filter: all pairs of these texts that no star has joined are looked up under
   their rarest shingles. Of similar sets, the first common shingle in order of rarity
   stands so early in both that the rest still holds the overlap needed; in the smaller
   set that is within a ninth of it at 0.8. Nothing is lost, and texts that merely share a
   common passage never meet, since the passage stands last in their order.

Scale: texts with equal shingle sets collapse to one node first. Under a shingle only pairs
of different groups are formed: the nodes of its largest group are set against the others,
not against each other. A shingle of more than ``bucket`` rows is dealt over several tasks.
Only nodes that may have a partner are turned into sets of shingle hashes, once.

Nulls, ties and the rest: null, empty and blank texts are copies of each other; a text
shorter than a shingle is one shingle; a null id takes part in linking but names a group
only where no row of it has an id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcore.llm import simhash
from panelcore.llm.common import text_of
from panelcore.llm.components import components
from panelcore.session import cut_lineage

BANDS, ROWS = 24, 5
BLOCK = 1 << 13
#: Parts into which the rows of one key are dealt for a join.
SALTS = 16
NO_ID = 2**63 - 1
_RNG = np.random.default_rng(7)
_TIMES = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)[:, None]


def shingles(text: bytes, words: int = 5) -> set[bytes]:
    """On bytes: lowers A-Z only, splits at ASCII white space."""
    w = text.lower().split()
    n = max(1, len(w) - words + 1)
    return {b" ".join(w)} if n == 1 else set(map(b" ".join, zip(*[w[k:n + k] for k in range(words)])))


def shingle_hashes(text: bytes, words: int = 5) -> np.ndarray:
    """The set of shingles as ascending 64-bit hashes."""
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles(text, words))), np.uint64))


def signature(text: bytes, words: int = 5) -> tuple[bytes, list[int], int]:
    """(digest of the shingle set, one key per band, number of shingles)."""
    h = shingle_hashes(text, words)
    least = np.min([(h[i:i + BLOCK] * _TIMES + _PLUS).min(axis=1) for i in range(0, len(h), BLOCK)], axis=0)
    keys = [xxhash.xxh64_intdigest(b.tobytes()) for b in least.reshape(BANDS, ROWS)]
    return (blake2b(h.tobytes(), digest_size=16).digest(),
            np.array(keys, np.uint64).view(np.int64).tolist(), len(h))


def signed(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id, h, node, keys, size, fp`` of every row; ``h`` is a digest of the text and
    ``fp`` its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.as_buffer().to_pybytes() for x in b.column("text").cast(pa.binary())]
            s = [signature(x, words) for x in texts]
            fp = np.array([simhash.fingerprint(x, words) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h"), pa.array([x[0] for x in s], pa.binary()),
                 pa.array([x[1] for x in s], pa.list_(pa.int64())),
                 pa.array([x[2] for x in s], pa.int64()), pa.array(fp.view(np.int64))],
                ["doc_id", "h", "node", "keys", "size", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("h"),
                       text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, h binary, node binary, keys array<long>, size long, fp long")


def text_digest():
    return F.unhex(F.md5(text_of()))


def _salt(name: str = "node"):
    return F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int")


def _on(rows: DataFrame, per_key: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join of ``rows`` with few rows per key, a hot key dealt over several tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    return rows.withColumn("_salt", _salt()).join(
        per_key.select("*", salts), [*on, "_salt"], how).drop("_salt")


def _shared(nodes: DataFrame) -> DataFrame:
    """``node, key, n`` of the keys that several nodes share."""
    keyed = nodes.select("node", F.posexplode("keys").alias("band", "k")).select(
        "node", F.xxhash64("band", "k").alias("key"))
    count = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut_lineage(_on(keyed, count, ["key"]))


def _simhash_heads(nodes: DataFrame) -> DataFrame:
    """``a, b``: the first node of every SimHash group of op6's operator, and each other."""
    comp = components(simhash.links(nodes.select("fp").distinct())).select(
        F.col("node").alias("fp"), F.col("root").alias("_g"))
    grouped = nodes.select("node", "fp").join(comp, "fp", "left").select(
        "node", F.coalesce("_g", "fp").alias("_g"))
    head = grouped.groupBy("_g").agg(F.min("node").alias("a"), F.max("node").alias("_z")).where("a < _z")
    return grouped.join(head.drop("_z"), "_g").where("node != a").select("a", F.col("node").alias("b"))


def _stars(shared: DataFrame, pivots: int) -> DataFrame:
    """``a, b``: each node and the ``pivots`` most central nodes of its most crowded key."""
    own = shared.groupBy("node").agg(
        F.max(F.struct("n", "key")).alias("_k"), F.sum("n").alias("_w")).select(
        "node", F.col("_k.key").alias("key"), "_w")
    weighed = shared.select("key", "node").join(own.select("node", "_w"), "node")
    order = W.partitionBy("key").orderBy(F.desc("_w"), F.xxhash64("node"), "node")
    central = weighed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= pivots)
    stars = _on(own, central.select("key", F.col("node").alias("a")), ["key"])
    return stars.where("a != node").select("a", F.col("node").alias("b"))


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node, set``: the shingle hashes of the wanted nodes, from one row of each."""
    need = nodes.join(wanted, "node", "left_semi").select(
        "node", F.coalesce("lowest", F.lit(NO_ID)).alias("_id"), F.col("h").alias("_h"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
                       text_digest().alias("_h"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_hashes(x.as_buffer().to_pybytes(), words).tobytes()
                    for x in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], ["node", "set"])

    once = rows.join(need, ["_id", "_h"]).dropDuplicates(["node"])  # rows may repeat
    return cut_lineage(once.select("node", "text").mapInArrow(run, "node long, set binary"))


def _alike(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """``u, v`` of the pairs ``a, b`` that are similar, by their whole sets. A pair names
    what it links: the nodes themselves, or the groups they are known to belong to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("x"), b.column("y")):
                s, t = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(both >= similarity * (len(s) + len(t) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    side = lambda k, t: sets.select(F.col("node").alias(k), F.col("set").alias(t))
    once = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.min("u").alias("u"), F.max("v").alias("v"))
    return cut_lineage(once.join(side("a", "x"), "a").join(side("b", "y"), "b").select(
        "u", "v", "x", "y").mapInArrow(run, "u long, v long"))


def _prefix_rows(sets: DataFrame, similarity: float) -> DataFrame:
    """``key, node, size, at``: every node under its rarest shingles, ``at`` in this order.

    Of two sets that are similar enough, each holds ``similarity`` of the other's size, so
    they share one of their ``size - ceil(similarity * size) + 1`` rarest shingles.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                h = np.frombuffer(b.column("set")[i].as_buffer(), np.int64)
                for a in range(0, len(h), BLOCK):
                    part = pa.array(h[a:a + BLOCK])
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(b.column("node")[i], len(part)),
                         pa.repeat(pa.scalar(len(h), pa.int64()), len(part)), part], ["node", "size", "key"])

    tokens = sets.mapInArrow(run, "node long, size long, key long")
    count = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = tokens.join(count, "key")
    order = W.partitionBy("node").orderBy("n", "key")  # a node's own shingles
    ranked = held.withColumn("_i", F.row_number().over(order)).withColumn(
        "_held", F.count(F.lit(1)).over(W.partitionBy("node")))
    at = F.col("size") - F.col("_held") + F.col("_i") - 1
    kept = ranked.select("key", "node", "size", at.alias("at")).where(
        F.col("at") <= F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9))
    return cut_lineage(kept)


def _between_groups(rows: DataFrame, similarity: float, bucket: int) -> DataFrame:
    """``a, b, u, v``: nodes ``a, b`` of different groups ``u, v`` that may be similar.

    ``a`` is the smaller set. Under each key only what can meet is set against each other:
    nodes outside the largest group against all, its own against those outside.
    """
    share = similarity / (1 + similarity)
    per_root = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("_c"))
    per_key = per_root.groupBy("key").agg(
        F.sum("_c").alias("_n"), F.max(F.struct("_c", "root")).alias("_m"),
        F.count(F.lit(1)).alias("_roots")).where("_roots > 1").select(
        "key", F.ceil(F.col("_n") / bucket).cast("int").alias("_parts"), F.col("_m.root").alias("_most"))
    open_ = cut_lineage(rows.join(per_key, "key").withColumn(
        "_side", F.when(F.col("root") == F.col("_most"), 0).otherwise(1)))
    # The smaller set of a pair meets the other within this part of it.
    first = open_.where(F.col("at") <= F.col("size") - F.ceil(F.lit(2 * share) * F.col("size") - 1e-9))
    left = first.select(
        "key", F.col("node").alias("a"), F.col("size").alias("_sa"), F.col("at").alias("_ia"),
        F.col("root").alias("_ra"), "_parts",
        F.explode(F.when(F.col("_side") == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("_side"))
    left = left.select("*", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")).drop("_parts")
    right = open_.select(
        "key", F.col("node").alias("b"), F.col("size").alias("_sb"), F.col("at").alias("_ib"),
        F.col("root").alias("_rb"), "_side",
        F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int").alias("_part"))
    least = F.ceil(F.lit(share) * (F.col("_sa") + F.col("_sb")) - 1e-9)
    met = left.alias("x").join(right.alias("y"), (
        (F.col("x.key") == F.col("y.key")) & (F.col("x._side") == F.col("y._side"))
        & (F.col("x._part") == F.col("y._part")) & (F.col("_ra") != F.col("_rb"))
        & ((F.col("_sa") < F.col("_sb")) | ((F.col("_sa") == F.col("_sb")) & (F.col("a") < F.col("b"))))
        & (F.col("_sa") - F.col("_ia") >= least) & (F.col("_sb") - F.col("_ib") >= least)))
    return met.select("a", "b", F.least("_ra", "_rb").alias("u"), F.greatest("_ra", "_rb").alias("v"))


def links(docs: DataFrame, nodes: DataFrame, words: int = 5, similarity: float = 0.8,
          bucket: int = 1024, pivots: int = 4) -> DataFrame:
    """``u, v``: edges whose closure is that of all similar pairs of nodes that share a
    MinHash key with any node or belong to one SimHash group."""
    heads = cut_lineage(_simhash_heads(nodes))
    shared = _shared(nodes)
    wanted = shared.select("node").union(heads.select("a")).union(heads.select("b")).distinct()
    sets = _sets(docs, nodes, wanted, words)
    pairs = heads.union(_stars(shared, pivots))
    found = _alike(sets, pairs.select("a", "b", F.col("a").alias("u"), F.col("b").alias("v")), similarity)
    group = components(found).select("node", F.col("root").alias("_r"))
    rows = _prefix_rows(sets, similarity).join(group, "node", "left").withColumn(
        "root", F.coalesce("_r", "node")).drop("_r")
    return found.union(_alike(sets, _between_groups(cut_lineage(rows), similarity, bucket), similarity))


def one_per_group(docs: DataFrame, words: int = 5, similarity: float = 0.8, bucket: int = 1024) -> DataFrame:
    """The documents with all columns, of each group of near copies the one with the
    smallest id; of rows that repeat this id, the one with the smallest text digest, and
    one of the rows that repeat both. Rows with a null id all stay: nothing names them."""
    rows = cut_lineage(signed(docs, words))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h")))
    nodes = cut_lineage(rows.groupBy("node").agg(
        first.alias("_f"), F.min("h").alias("_h"), F.first("keys").alias("keys"),
        F.first("size").alias("size"), F.min("fp").alias("fp")).select(
        F.monotonically_increasing_id().alias("node"), "keys", "size", "fp", F.col("_f.doc_id").alias("lowest"),
        F.coalesce("_f.h", "_h").alias("h")))
    comp = components(links(docs, nodes, words, similarity, bucket)).withColumnRenamed("node", "_n")
    member = nodes.join(comp, F.col("node") == F.col("_n"), "left").select(
        F.coalesce("root", "node").alias("root"),
        F.when(F.col("lowest").isNotNull(), F.struct("lowest", "h")).alias("_f"))
    keep = member.groupBy("root").agg(F.min("_f").alias("_f")).where("_f is not null").select(
        F.col("_f.lowest").alias("_id"), F.col("_f.h").alias("_h"))
    tagged = docs.withColumn("_text", text_digest())
    on = (F.col("doc_id") == F.col("_id")) & (F.col("_text") == F.col("_h"))
    named = tagged.join(keep, on, "left_semi").dropDuplicates(["doc_id", "_text"])
    return named.drop("_text").union(docs.where("doc_id is null"))
