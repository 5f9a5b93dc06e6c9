"""Token counts by separator scan.

Flat token files hold 16-bit ids without any index: the tokens of one document after
the other, each document closed by the end-of-document id. Files are cut into blocks;
every block is searched for the id at once as an array, and yields its separators and a
summary (tokens, separators, last separator). A prefix scan over the summaries gives each
block the number of documents and tokens before it and the place of the last separator
before it, which stitches documents that cross blocks or files.

Scale: a block needs one summary row. The scan has two levels, blocks inside a file and
files in chunks, so no window spans all blocks. A file is one row of Spark's binary
reader; ``pack`` begins a new file at half of ``MAX_FILE`` bytes, and foreign files above
``MAX_FILE`` are refused by their listed length, before they are read.

Nulls, ties and the rest: empty files and empty documents count (0 tokens); tokens
behind the last separator are a last document with ``closed`` false; a file whose length
is no whole number of ids fails; null texts are packed as empty documents; documents that
repeat repeat in the result; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcore.functions.ranks import global_row_number
from panelcore.llm.common import text_of
from panelcore.session import cut_lineage

#: End of document. Packed ids are the vocabulary's ids plus one.
EOD = 0
BLOCK = 1 << 20
MAX_FILE = 512 << 20
CHUNK = 1024
TOKENIZERS = "/opt/tokenizers"


def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_multi_50k.tiktoken"):
    """A byte-level BPE from a public vocabulary file."""
    import runpy

    import tiktoken

    pattern = runpy.run_path(f"{folder}/__init__.py")["PATTERN"]
    with open(f"{folder}/{name}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pack(docs: DataFrame, path: str, folder: str = TOKENIZERS,
         name: str = "byte_bpe_multi_50k.tiktoken", most: int = MAX_FILE // 2) -> None:
    """Writes the tokens of every whole text to flat files of little-endian 16-bit ids
    below ``kind=tokens``, and the ids of its documents below ``kind=ids``.

    Spark's text writer puts the bytes of a row as they are and its line separator, here
    the two bytes of ``EOD``, behind each. One pass over ``docs`` writes both kinds: a task
    numbers its documents as it packs them (``file, nth, tokens, doc_id``), and begins the
    next file of its own before one exceeds ``most`` bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        no, nth, size = 0, 0, 0
        for b in batches:
            for i in range(0, b.num_rows, 512):
                at, ids, sidecar = [], [], []
                for t, d in zip(b["text"][i:i + 512], b["doc_id"][i:i + 512].to_pylist()):
                    x = (np.array(enc.encode_ordinary(t.as_py()), np.int64) + 1).astype("<u2").tobytes()
                    if nth and size + len(x) + 2 > most:
                        no, nth, size = no + 1, 0, 0
                    at.append(no)
                    ids.append(x)
                    sidecar.append(f"{no} {nth} {len(x) // 2} {'' if d is None else d}".encode())
                    nth, size = nth + 1, size + len(x) + 2
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids + sidecar, pa.binary()), pa.array(["tokens"] * n + ["ids"] * n),
                     pa.array(at + [0] * n, pa.int32())], ["value", "kind", "file"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    packed = rows.mapInArrow(run, "value binary, kind string, file int").select(
        F.col("value").cast("string").alias("value"), "kind", "file")
    # With writers side by side a task does not sort its rows by file first.
    conf, key = docs.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, "100000")
    try:
        packed.write.partitionBy("kind", "file").option("lineSep", "\x00\x00").option(
            "maxRecordsPerFile", 0).text(path)
    finally:
        conf.set(key, before)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def scan(spark: SparkSession, path: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(separators, summaries) of all blocks.

    separators: ``file, block, at`` (token position in the file of each separator, as an
    array); summaries: ``file, block, n, k, last`` (position of the last one, or null).
    """
    long = _files(spark, path).where(F.col("length") > MAX_FILE).select("path").take(1)
    if long:
        raise ValueError(f"{long[0][0]} has more than {MAX_FILE} bytes; split it")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b["path"].to_pylist(), b["content"]):
                raw = content.as_buffer()
                if len(raw) % 2:
                    raise ValueError(f"{p} ends inside an id")
                ids = np.frombuffer(raw, "<u2") if len(raw) else np.zeros(0, np.uint16)
                for lo in range(0, max(len(ids), 1), block):
                    part = ids[lo:lo + block]
                    at = np.flatnonzero(part == EOD) + lo
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p]), pa.array([lo // block], pa.int64()), pa.array([len(part)], pa.int64()),
                         pa.array([at.tolist()], pa.list_(pa.int64()))], ["file", "block", "n", "at"])

    found = cut_lineage(_files(spark, path).select("path", "content").mapInArrow(
        run, "file string, block long, n long, at array<long>"))
    k = F.size("at").cast("long")
    last = F.when(k > 0, F.element_at("at", -1))
    return found, found.select("file", "block", "n", k.alias("k"), last.alias("last"))


def stitched(summaries: DataFrame) -> DataFrame:
    """``file, block, base, docs, opened``: what lies before each block in the stream of
    files in path order: tokens before its file, documents closed before the block, and
    the stream position where the document open at its start began."""
    per_file = summaries.groupBy("file").agg(F.sum("n").alias("fn"), F.sum("k").alias("fk"),
                                             F.max("last").alias("fl"))
    files = global_row_number(per_file, ["file"], "no").withColumn(
        "chunk", F.floor((F.col("no") - 1) / CHUNK))

    def before(keys: list[str], order: str):
        return W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)

    inside = before(["chunk"], "no")
    files = files.withColumn("off", F.coalesce(F.sum("fn").over(inside), F.lit(0))).withColumn(
        "end", F.col("off") + F.col("fl") + 1)
    chunks = files.groupBy("chunk").agg(F.sum("fn").alias("cn"), F.sum("fk").alias("ck"), F.max("end").alias("cl"))
    # One row per CHUNK files.
    over = W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("c0", F.coalesce(F.sum("cn").over(over), F.lit(0))).withColumn(
        "k0", F.coalesce(F.sum("ck").over(over), F.lit(0)))
    chunks = chunks.select("chunk", "c0", "k0", F.max(F.col("c0") + F.col("cl")).over(over).alias("l0"))
    files = files.withColumn("fk0", F.coalesce(F.sum("fk").over(inside), F.lit(0))).withColumn(
        "fe0", F.max("end").over(inside)).join(chunks, "chunk").select(
        "file", (F.col("c0") + F.col("off")).alias("base"), (F.col("k0") + F.col("fk0")).alias("fdocs"),
        F.greatest(F.col("l0"), F.col("c0") + F.col("fe0"), F.lit(0)).alias("fopened"))
    blocks = before(["file"], "block")
    return summaries.withColumn("bk", F.coalesce(F.sum("k").over(blocks), F.lit(0))).withColumn(
        "bl", F.max("last").over(blocks)).join(files, "file").select(
        "file", "block", "base", (F.col("fdocs") + F.col("bk")).alias("docs"),
        F.greatest("fopened", F.col("base") + F.col("bl") + 1).alias("opened"))


def documents(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """``doc_no, file, nth, start, n_tokens, closed`` of every document of the stream:
    its number, the file it ends in and its place among those that end there, its first
    token's position and its length without the separator."""
    found, summaries = scan(spark, path, block)
    state = cut_lineage(stitched(summaries))
    one = F.transform("at", lambda x, i: F.struct(
        i.alias("i"), x.alias("at"), F.when(i > 0, F.get("at", i - 1)).alias("before")))
    ends = found.select("file", "block", F.explode(one).alias("e")).select("file", "block", "e.*")
    first = state.groupBy("file").agg(F.min("docs").alias("fdocs"))
    stop = F.col("base") + F.col("at")
    start = F.coalesce(F.col("base") + F.col("before") + 1, F.col("opened"))
    closed = ends.join(state.join(first, "file"), ["file", "block"]).select(
        (F.col("docs") + F.col("i")).alias("doc_no"), "file",
        (F.col("docs") + F.col("i") - F.col("fdocs")).alias("nth"), start.alias("start"),
        (stop - start).alias("n_tokens"), F.lit(True).alias("closed"))
    # What follows the last separator of the whole stream.
    n, k = summaries.agg(F.sum("n"), F.sum("k")).first()
    opened = state.join(summaries, ["file", "block"]).agg(
        F.max(F.greatest("opened", F.col("base") + F.col("last") + 1))).first()[0]
    if n is not None and n > opened:
        closed = closed.union(spark.createDataFrame(
            [(k, None, None, opened, n - opened, False)], closed.schema))
    return closed


def token_counts(docs: DataFrame, path: str, folder: str = TOKENIZERS, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_tokens, doc_no, start``: packs the documents below ``path`` and counts.

    The token files hold no ids; those that ``pack`` wrote beside them, in the same pass,
    are joined by task, file and place. A document without its counterpart, or with
    another length, fails.
    """
    spark = docs.sparkSession
    if not docs.take(1):  # no file is written
        return spark.createDataFrame([], "doc_id long, n_tokens long, doc_no long, start long")
    pack(docs, path, folder)
    task = lambda c: F.regexp_extract(c, r"part-(\d+)-", 1).cast("long")
    counted = documents(spark, f"{path}/kind=tokens", block).select(
        "doc_no", "start", "n_tokens", F.col("nth").cast("long").alias("nth"), task("file").alias("part"),
        F.regexp_extract("file", r"/file=(\d+)/", 1).cast("long").alias("no"))
    side = F.split("value", " ")
    ids = spark.read.option("lineSep", "\x00\x00").text(f"{path}/kind=ids").select(
        "value", task(F.col("_metadata.file_path")).alias("part")).select(
        "part", side[0].cast("long").alias("no"), side[1].cast("long").alias("nth"),
        side[2].cast("long").alias("length"), F.when(side[3] != "", side[3].cast("long")).alias("doc_id"))
    same = F.col("length").eqNullSafe(F.col("n_tokens"))
    lost = F.raise_error(F.lit("token files and their ids differ"))
    return ids.join(counted, ["part", "no", "nth"], "full").select(
        "doc_id", F.when(same, F.col("n_tokens")).otherwise(lost.cast("long")).alias("n_tokens"),
        "doc_no", "start")
