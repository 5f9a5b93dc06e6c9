"""Merkle manifest of a dataset, and the versions that single tampered rows would make.

Every row is a leaf; the leaves of a source, in order, hash up to its subroot by runs of
``FAN`` nodes, and the subroots to the root. A tampered leaf makes a version of the tree
in which only its ancestors are new: the version copies the path from the leaf upward and
shares every other node.

Leaves are dealt into blocks of ``FAN`` x ``FAN`` consecutive ones, aligned to the tree,
so a block's nodes depend on nothing outside. Pass after pass the blocks' roots are the
leaves of the next, 256 times smaller pass, until one block is left; then the subroots
are treated the same way. On the way down each block learns its path: for every level
above, the digests left and right of it. A version is copied inside its block as a
persistent tree and continued along that path in the same task, so upper versions stay
where their leaves are, however many there are.

Scale: texts are hashed at the scan; 70 bytes a row are shuffled, twice: to order them
by ranges of (source, doc_id), which splits a source of any size, and into blocks. No
window or task spans a source; what comes per block is at most fifteen digests a level.

Nulls, ties and the rest: a null is hashed as ``-``; null ids come first, rows with one
id are ordered by their leaf, so rows that repeat are leaves of their own; a null id is
never tampered with; an empty text is a value of length 0; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcore.functions.ranks import global_row_number, partition_offsets
from panelcore.llm.common import lower_ascii
from panelcore.session import cut_lineage

FAN = 16
BLOCK = FAN * FAN
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "path array<struct<left:string,right:string>>"
PLACED = "tree string, nth long, doc_id long, leaf string, changed string"


def leaf_of(fields: dict[str, Column]) -> Column:
    """Digest of a row: every field as ``-`` or its UTF-8 length, a colon and its value."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in fields.values()]), 256)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """``tree, doc_id, leaf, changed``: a row's digest, and the one it has with its text's
    A-Z in lower case (null where nothing is tampered). ``tree`` orders as the source."""
    fields = {c: F.col(c) for c in FIELDS}
    other = leaf_of(fields | {"text": lower_ascii(F.col("text"))})
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of(fields).alias("leaf"), F.when(tampered, other).alias("changed"),
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their place ``nth`` in the part of their tree that a task holds."""
    held, n = None, 0
    for b in batches:
        nth = np.empty(b.num_rows, np.int64)
        for i, tree in enumerate(b.column("tree").to_pylist()):
            held, n = (tree, n + 1) if tree == held else (tree, 0)
            nth[i] = n
        yield pa.RecordBatch.from_arrays(
            [b.column("tree"), pa.array(nth), *(b.column(c) for c in ("doc_id", "leaf", "changed"))],
            [c.split()[0] for c in PLACED.split(", ")])


def positions(rows: DataFrame) -> DataFrame:
    """``tree, pos, size, doc_id, leaf, changed``: place in the tree and the tree's leaves."""
    order = ["tree", "doc_id", "leaf"]
    split = cut_lineage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_numbered, PLACED).withColumn("_p", F.spark_partition_id()))
    offsets = partition_offsets(split, ["tree"], F.lit(1))
    every = W.partitionBy("tree")  # one row per range partition that the tree touches
    offsets = offsets.select("tree", "_p", "_off", F.sum("_pc").over(every).alias("size"))
    return split.join(offsets, ["tree", "_p"]).select(
        "tree", (F.col("_off") + F.col("nth")).cast("long").alias("pos"),
        F.col("size").cast("long"), "doc_id", "leaf", "changed")


class Node(NamedTuple):
    """A node of a persistent tree; versions share the nodes that they do not replace."""

    digest: str
    kids: tuple[Node, ...] = ()


def hashed(kids: tuple[Node, ...]) -> Node:
    return Node(sha256("".join([k.digest for k in kids]).encode()).hexdigest(), kids)


def levels_of(size: int) -> int:
    """Levels above ``size`` nodes until one remains."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FAN), levels + 1
    return levels


def grown(digests: list[str], size: int) -> tuple[Node, int]:
    """Tree over one block of a tree of ``size`` nodes, and the levels it spans."""
    nodes = tuple(Node(d) for d in digests)
    levels = min(2, levels_of(size))
    for _ in range(levels):
        nodes = tuple(hashed(nodes[a:a + FAN]) for a in range(0, len(nodes), FAN))
    return nodes[0], levels


def replaced(node: Node, place: int, levels: int, digest: str) -> Node:
    """A version of the tree with one leaf replaced: only its ancestors are copied."""
    if not levels:
        return Node(digest)
    k, below = divmod(place, FAN ** (levels - 1))
    kids = node.kids
    return hashed((*kids[:k], replaced(kids[k], below, levels - 1, digest), *kids[k + 1:]))


def siblings(node: Node, place: int, levels: int) -> list[tuple[str, str]]:
    """Digests left and right of the path to a leaf, from the leaf's level upward."""
    out = []
    for level in range(levels - 1, -1, -1):
        k, place = divmod(place, FAN**level)
        digests = [x.digest for x in node.kids]
        out.append(("".join(digests[:k]), "".join(digests[k + 1:])))
        node = node.kids[k]
    return out[::-1]


def blocks(nodes: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``tree, block, size, digests, root`` (and arrays of ``extra``): whole blocks."""
    kinds = {c: t for c, t in nodes.dtypes}
    parts = F.sort_array(F.collect_list(F.struct("pos", "leaf", *extra)))
    rows = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"), "size")
    rows = rows.agg(parts.alias("_m")).select(
        "tree", "block", "size", F.col("_m.leaf").alias("digests"),
        *[F.col(f"_m.{c}").alias(c) for c in extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = zip(b.column("digests").to_pylist(), b.column("size").to_pylist())
            yield b.append_column("root", pa.array([grown(d, n)[0].digest for d, n in at], pa.string()))

    schema = ["tree string", "block long", "size long", "digests array<string>",
              *[f"{c} array<{kinds[c]}>" for c in extra], "root string"]
    return cut_lineage(rows.mapInArrow(run, ", ".join(schema)))


def _one_by_one(b: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch as Python values, of which one block at a time is held."""
    return (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows))


def climbed(first: DataFrame) -> list[DataFrame]:
    """Blocks of all passes, until every tree is one block."""
    passes = [first]
    while passes[-1].agg(F.max("size")).first()[0] > BLOCK:
        upper = passes[-1].select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("size") / BLOCK).alias("size"),
            F.col("root").alias("leaf"))
        passes.append(blocks(upper))
    return passes


def handed_down(block: DataFrame, paths: DataFrame) -> DataFrame:
    """``tree, block, path, top``: the path of every node of ``block``, which is a block of
    the pass below, from the paths of the blocks; ``top`` passes through."""
    kind = dict(paths.dtypes)["top"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = pa.schema([b.schema.field(c) for c in ("tree", "block", "path", "top")])
            for r in _one_by_one(b):
                tree, levels = grown(r["digests"], r["size"])
                yield pa.RecordBatch.from_pylist([
                    {"tree": r["tree"], "block": r["block"] * BLOCK + i, "top": r["top"],
                     "path": [{"left": a, "right": z} for a, z in siblings(tree, i, levels)]
                     + r["path"]}
                    for i in range(len(r["digests"]))], schema=kept)

    joined = block.join(paths, ["tree", "block"]).select(
        "tree", "block", "size", "digests", "path", "top")
    return joined.mapInArrow(run, f"tree string, block long, {PATH}, top {kind}")


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    for b in batches:
        for r in _one_by_one(b):
            tree, levels = grown(r["digests"], r["size"])
            above = [(p["left"].encode(), p["right"].encode()) for p in r["path"]]
            upper = b"".join(a + z for a, z in above)
            subroot, root = r["top"]["subroot"], r["top"]["root"]
            rows = []
            for i, (doc, leaf, changed) in enumerate(zip(r["doc_id"], r["digests"], r["changed"])):
                inner = "".join(a + z for a, z in siblings(tree, i, levels))
                proof = sha256(inner.encode() + upper).hexdigest()
                folded = replaced(tree, i, levels, changed or leaf).digest
                for a, z in above:  # the version goes on above its block
                    folded = sha256(a + folded.encode() + z).hexdigest()
                rows.append((doc, leaf, subroot, root, proof, folded, folded == root))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified``.

    ``tampered`` says which rows are checked with a changed text; by default those whose
    id's crc32 is divisible by 5.
    """
    if tampered is None:
        tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    # Written first: the sampling of the ranges must not hash every text once more.
    rows = positions(cut_lineage(leaves(docs, F.coalesce(tampered, F.lit(False)))))
    inside = climbed_or_none(blocks(rows, ("doc_id", "changed")))
    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string," \
          " folded_root string, verified boolean"
    if inside is None:
        return docs.sparkSession.createDataFrame([], out)
    # The subroots are the leaves of one more tree; `block` numbers are then sources.
    subroots = inside[-1].where("block = 0").select(F.col("tree").alias("source"), F.col("root").alias("leaf"))
    named = cut_lineage(global_row_number(subroots, ["source"], "pos"))
    total = named.count()
    top = named.select(F.lit("").alias("tree"), (F.col("pos") - 1).alias("pos"),
                       F.lit(total).cast("long").alias("size"), "leaf")
    outside = climbed(blocks(top))
    paths = outside[-1].select("tree", "block", F.expr(f"cast(array() as {PATH[5:]})").alias("path"),
                               F.col("root").alias("top"))
    for block in reversed(outside):
        paths = handed_down(block, paths)
    both = F.struct(F.col("leaf").alias("subroot"), F.col("top").alias("root")).alias("top")
    paths = paths.join(named, F.col("block") == F.col("pos") - 1).select(
        F.col("source").alias("tree"), F.lit(0).cast("long").alias("block"), "path", both)
    for block in reversed(inside[1:]):
        paths = handed_down(block, paths)
    return inside[0].join(paths, ["tree", "block"]).select(
        "size", "digests", "doc_id", "changed", "path", "top").mapInArrow(_judged, out)


def climbed_or_none(first: DataFrame) -> list[DataFrame] | None:
    return None if first.isEmpty() else climbed(first)
