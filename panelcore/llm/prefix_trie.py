"""Conversation prefix trie: z-fast tries over prefix digests, merged by node.

A turn is a 16-byte digest of (role, text); a prefix of a conversation is the digest that
chains its turns. Each task grows compacted tries over its conversations. A compacted
node covers the depths from just below its parent's extent to its own extent, and is
hashed by the digest of its handle: the prefix at the two-fattest depth of that range. A
fat binary search over handles finds the node where a conversation leaves the trie with
logarithmically many look-ups, whatever the lengths; the edge is split there and the
rest hung on. Conversations go in by batches in which equal ones are one. In the end
edges are expanded to one row per depth, in preorder.

A node of the corpus is what the tries' rows with one digest say together. Sums over its
subtree need no walk over the corpus: among the tries that hold a node the one with the
smallest number owns it, owned nodes of a trie are closed downwards, and a trie in
preorder sums what it owns below each of its nodes as a difference of running totals.

Scale: texts end at the scan; 32 bytes a turn are shuffled. A popular prefix or a
conversation that a third of all rows repeat is one row per trie, not per member. A trie
ends at ``turns`` turns, the bound of what a task holds beside one conversation's digests
(one conversation is chained in order, in one task). The list of conversations that end
at a node is packed by range partitions first; only its SHA-256, which is sequential by
definition, passes through one task, as a stream of packed pieces.

Nulls, ties and the rest: null roles and texts are empty; null turns come first; turns
with one number are ordered by the digest of role and text; repeated rows are turns of
their own; rows with a null conv_id belong to no conversation and are left out; an empty
table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcore.session import cut_lineage

ROOT = bytes(16)
LOCAL = ("trie long, at int, span int, up int, node binary, depth long, n_convs long,"
         " least long, n_chars long, gross long, inner boolean, ends array<bigint>")
PARTS = ("node binary, depth long, n_convs long, conv_id long, parent_conv_id long,"
         " gross long, kept long, n_children long, n_leaves long")


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, ord, turn_key, n_chars``: turns in order, from 1, without their texts."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.substring(key, 1, 32)).alias("turn_key"),
        F.char_length(text).cast("long").alias("n_chars"),
    )
    w = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_key")
    return rows.withColumn("ord", F.row_number().over(w)).drop("turn")


def rebuilt(turns: DataFrame, shared: Column, block: int = 100, most: int = 5) -> DataFrame:
    """``conv_id, ord, head, turn_key, n_chars``: a conversation's own turns after its
    first ``shared``; its first row holds the turns it takes from its block's first one.

    ``shared`` is at most ``most``, so a head is a short array.
    """
    first = F.col("conv_id") - F.col("conv_id") % block
    heads = turns.where((F.col("conv_id") == first) & (F.col("ord") <= most)).groupBy(
        F.col("conv_id").alias("_base")
    ).agg(F.sort_array(F.collect_list(F.struct("ord", "turn_key", "n_chars"))).alias("_all"))
    lead = turns.where("ord = 1").select(
        F.col("conv_id").alias("_c"), first.alias("_first"), shared.cast("int").alias("_h"))
    lead = lead.join(heads, F.col("_first") == F.col("_base"), "left").select(
        "_c", "_h", F.slice("_all", 1, F.col("_h")).alias("_head"))
    rest = F.col("ord") > F.col("_h")
    return turns.join(lead, F.col("conv_id") == F.col("_c")).where(rest | (F.col("ord") == 1)).select(
        "conv_id", "ord",
        F.when(F.col("ord") == 1, F.col("_head")).alias("head"),
        F.when(rest, F.col("turn_key")).alias("turn_key"), "n_chars",
    )


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the largest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Node:
    """Depths ``above + 1`` to ``extent`` of every sequence that passes through."""

    __slots__ = ("up", "above", "extent", "path", "chars", "kids", "ends", "n", "least", "gross")

    def __init__(self, up, above: int, extent: int, path: list[bytes], chars: list[int]):
        self.up, self.above, self.extent = up, above, extent
        self.path, self.chars = path, chars  # of one member, by depth; depth 0 is the root
        self.kids: dict[bytes, Node] = {}
        self.ends: list[int] = []

    def handle(self) -> bytes:
        return self.path[two_fattest(self.above, self.extent)]


class ZFastTrie:
    def __init__(self) -> None:
        self.root = Node(None, 0, 0, [ROOT], [0])
        self.handles: dict[bytes, Node] = {}

    def exit(self, path: list[bytes]) -> tuple[Node, int]:
        """The node whose range a sequence leaves, and the depth to which it agrees."""
        node, low, high = self.root, 0, len(path) - 1
        while low < high:
            f = two_fattest(low, high)
            found = self.handles.get(path[f])
            if found is None:
                high = f - 1
            else:
                node, low = found, found.extent
        depth = self._agrees(node, path)
        if depth == node.extent and depth < len(path) - 1:
            child = node.kids.get(path[depth + 1])
            if child is not None:  # left before the child's handle
                return child, self._agrees(child, path)
        return node, depth

    @staticmethod
    def _agrees(node: Node, path: list[bytes]) -> int:
        low, high = node.above, min(node.extent, len(path) - 1)
        while low < high:
            d = (low + high + 1) // 2
            low, high = (d, high) if path[d] == node.path[d] else (low, d - 1)
        return low

    def _split(self, node: Node, depth: int) -> Node:
        top = Node(node.up, node.above, depth, node.path, node.chars)
        node.up.kids[node.path[node.above + 1]] = top
        del self.handles[node.handle()]
        node.up, node.above = top, depth
        top.kids[node.path[depth + 1]] = node
        self.handles[node.handle()] = node
        self.handles[top.handle()] = top
        return top

    def insert(self, path: list[bytes], chars: list[int], members: list[int]) -> None:
        node, depth = self.exit(path)
        if depth < node.extent:
            node = self._split(node, depth)
        if depth < len(path) - 1:
            leaf = Node(node, depth, len(path) - 1, path, chars)
            node.kids[path[depth + 1]] = leaf
            self.handles[leaf.handle()] = node = leaf
        node.ends += members

    def expanded(self, number: int) -> pa.RecordBatch:
        """One row per node and depth in preorder, with counts of this trie's members.

        ``gross`` is the sum over the subtree of members times code points.
        """
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node.kids.values()
        rows: dict[int, int] = {}  # rows of the subtree, by node
        for x in reversed(order):
            kids = x.kids.values()
            x.n = len(x.ends) + sum(k.n for k in kids)
            x.least = min([*x.ends, *(k.least for k in kids)])
            own = x.n * sum(x.chars[x.above + 1:x.extent + 1])
            x.gross = own + sum(k.gross for k in kids)
            rows[id(x)] = max(1, x.extent - x.above) + sum(rows[id(k)] for k in kids)
        out: list[tuple] = []
        last: dict[int, int] = {}  # row of a node's extent
        for x in order:
            up = last[id(x.up)] if x.up else -1
            gross, span = x.gross, rows[id(x)]
            for d in range(x.above + 1 if x.up else 0, x.extent + 1):
                end = d == x.extent
                out.append((number, len(out), span, up, x.path[d], d, x.n, x.least, x.chars[d],
                            gross, not end or bool(x.kids), sorted(x.ends) if end else []))
                up, span, gross = len(out) - 1, span - 1, gross - x.n * x.chars[d]
            last[id(x)] = len(out) - 1
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 5,
                 pa.bool_(), pa.list_(pa.int64())]
        names = [c.split()[0] for c in LOCAL.split(", ")]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """Conversation, its chained prefix digests and code points, from sorted rows."""
    held, path, chars = None, [], []

    def add(key: bytes, n: int) -> None:
        path.append(hashlib.blake2b(path[-1] + key, digest_size=16).digest())
        chars.append(n)

    for b in batches:
        columns = (b.column(c).to_pylist() for c in ("conv_id", "head", "turn_key", "n_chars"))
        for conv, head, key, n in zip(*columns):
            if conv != held:
                if held is not None:
                    yield held, path, chars
                held, path, chars = conv, [ROOT], [0]
            for t in head or ():
                add(t["turn_key"], t["n_chars"])
            if key is not None:
                add(key, n)
    if held is not None:
        yield held, path, chars


def local_tries(rows: DataFrame, turns: int = 1 << 18, batch: int = 1024) -> DataFrame:
    """Rows of the tries of all tasks; a trie takes at most about ``turns`` turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size, trie = TaskContext.get().partitionId() << 32, 0, ZFastTrie()
        waiting: dict[bytes, tuple] = {}

        def insert() -> None:
            for path, chars, members in waiting.values():
                trie.insert(path, chars, members)
            waiting.clear()

        for conv, path, chars in _sequences(batches):
            if size and size + len(path) > turns:
                insert()
                yield from _slices(trie.expanded(number))
                number, size, trie = number + 1, 0, ZFastTrie()
            waiting.setdefault(path[-1], (path, chars, []))[2].append(conv)
            size += len(path)
            if len(waiting) >= batch:
                insert()
        if size:
            insert()
            yield from _slices(trie.expanded(number))

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "ord").mapInArrow(run, LOCAL)


def _slices(b: pa.RecordBatch, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    return (b.slice(a, rows) for a in range(0, b.num_rows, rows))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the owned part of each subtree; a trie's rows come in preorder."""

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        own, up = t["own"].to_numpy(), t["up"].to_numpy()
        at = np.arange(len(t))
        below = at + t["span"].to_numpy()

        def total(values: np.ndarray) -> np.ndarray:
            run = np.concatenate([[0], np.cumsum(values)])
            return run[below] - run[at]

        kids = np.bincount(up[own & (up >= 0)], minlength=len(t))
        conv = t["conv_id"].to_numpy()
        out = t.select(["node", "depth", "n_convs", "conv_id"])
        for name, values in (
            ("parent_conv_id", pa.array(conv[up], mask=up < 0)),
            ("gross", t["gross"]),
            ("kept", total(np.where(own, t["n_chars"].to_numpy(), 0))),
            ("n_children", kids.astype(np.int64)),
            ("n_leaves", total((own & ~t["inner"].to_numpy()).astype(np.int64))),
        ):
            out = out.append_column(name, values if isinstance(values, pa.ChunkedArray)
                                    else pa.chunked_array([values]))
        yield from out.combine_chunks().to_batches(max_chunksize=1 << 14)

    held: list[pa.RecordBatch] = []
    for b in batches:
        trie = b.column("trie").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(trie)) + 1).tolist(), len(trie)]
        for a, z in zip(cuts, cuts[1:]):
            if held and held[0].column("trie")[0].as_py() != trie[a]:
                yield from done(held)
                held = []
            held.append(b.slice(a, z - a))
    if held:
        yield from done(held)


def list_digests(pairs: DataFrame, piece: int = 1 << 16) -> DataFrame:
    """``node, ends_sha256``: SHA-256 of each node's ``conv_id``s, ascending, comma-joined."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, text = None, 0, []

        def row():
            return pa.RecordBatch.from_pylist(
                [{"node": held, "first": first, "text": ",".join(text)}],
                pa.schema([("node", pa.binary()), ("first", pa.int64()), ("text", pa.string())]))

        for b in batches:
            for node, rows in groupby(zip(b.column("node").to_pylist(), b.column("conv_id").to_pylist()),
                                      lambda x: x[0]):
                for _, conv in rows:
                    if text and (node != held or 20 * len(text) >= piece):
                        yield row()
                        text = []
                    if not text:
                        held, first = node, conv
                    text.append(str(conv))
        if text:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for b in batches:
            out = []
            for node, text in zip(b.column("node").to_pylist(), b.column("text").to_pylist()):
                if node == held:
                    state.update(("," + text).encode())
                    continue
                if held is not None:
                    out.append((held, state.hexdigest()))
                held, state = node, hashlib.sha256(text.encode())
            yield _pairs(out)
        if held is not None:
            yield _pairs([(held, state.hexdigest())])

    def _pairs(out: list[tuple]) -> pa.RecordBatch:
        nodes, shas = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.binary()), pa.array(shas, pa.string())], ["node", "ends_sha256"])

    packed = pairs.repartitionByRange("node", "conv_id").sortWithinPartitions(
        "node", "conv_id").mapInArrow(pack, "node binary, first long, text string")
    return packed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(
        digest, "node binary, ends_sha256 string")


def trie_nodes(rows: DataFrame, turns: int = 1 << 18) -> DataFrame:
    """Every node of the trie over rebuilt conversations, with ``node``, its digest."""
    local = cut_lineage(local_tries(rows, turns))
    whole = local.groupBy("node").agg(
        F.sum("n_convs").alias("_n"), F.min("least").alias("conv_id"),
        F.min("trie").alias("_owner"), F.max("inner").alias("_inner"),
        F.sum("gross").alias("_gross"),
    )
    marked = local.drop("ends").join(whole, "node").select(
        "trie", "at", "span", "up", "node", "depth", F.col("_n").alias("n_convs"), "conv_id",
        "n_chars", F.col("_gross").alias("gross"), F.col("_inner").alias("inner"),
        (F.col("trie") == F.col("_owner")).alias("own"),
    )
    parts = marked.repartition("trie").sortWithinPartitions("trie", "at").mapInArrow(
        _subtrees, PARTS)
    same = ("depth", "n_convs", "conv_id", "parent_conv_id", "gross")
    nodes = parts.groupBy("node").agg(
        *[F.max(c).alias(c) for c in same],
        *[F.sum(c).alias(c) for c in ("kept", "n_children", "n_leaves")],
    )
    ends = list_digests(local.select("node", F.explode("ends").alias("conv_id")))
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(ends, "node", "left").select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("gross") - F.col("kept")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, block: int = 100, folds: int = 6,
                      turns: int = 1 << 18) -> DataFrame:
    """Nodes of the trie over conversations rebuilt on their block's first one: each
    starts with the first crc32(conv_id) % ``folds`` turns of it."""
    shared = F.crc32(F.col("conv_id").cast("string")) % folds
    rows = rebuilt(cut_lineage(turns_of(conversations)), shared, block, folds - 1)
    return trie_nodes(rows, turns)
