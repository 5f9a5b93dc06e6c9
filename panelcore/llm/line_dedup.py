"""Substring dedup by hashing lines and the sentences inside them.

A text is cut at line ends and, inside lines, behind sentence marks; lines and sentences
are normalised (lower case, single spaces, no marks at their ends) and hashed to 128 bits.
Whole lines come first, however short: of equal lines the one that ranks first by
(doc_id, offset, text digest) stays and every other one is removed, with its offsets in the original
text kept. The lines that stay are then compared by their sentences in the same way.
Sentences below ``least`` words say little alone, so their hash also covers the units
before them until ``least`` words are reached; at the start of a text such a sentence has
no hash. ``by_line`` compares whole lines only.

Scale: units are written once to the shared folder. Digests are grouped with map-side
combine, so a line that stands in every document is one row per task; only digests that
occur twice are joined back, as a shuffle join that adaptive execution may split; sentences are
counted before and again after those of removed lines are left out. What
is gathered per document is its own spans, never a group's members.

Nulls, ties and the rest: null and empty texts have no units; a null id ranks last, and
different texts under one id (or none) rank by their digest; rows that repeat id and text
share their rank and keep the same units; equal units inside one text go as well, from
the second on; an empty table gives an empty result;
other columns are ignored, or kept by ``cleaned``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcore.llm.common import text_of
from panelcore.session import scratch_path

ENDS = re.compile(r"[.!?]+(?=\s)|\n")
EDGE = ".,;:!?… "
UNIT = "doc_id long, h long, line int, whole boolean, start int, stop int, words int, digest binary"
NO_ID = 2**63 - 1


def units(text: str, least: int = 8, by_line: bool = False) -> list[tuple[int, int, int, bytes]]:
    """(start, stop, words, digest) of the units of one text that have a digest."""
    cuts = [m.end() for m in ENDS.finditer(text) if not by_line or m[0] == "\n"]
    out, lo, behind = [], 0, []
    for hi in [*cuts, len(text)]:
        raw = text[lo:hi]
        words = raw.lower().split()
        if words:
            start = lo + len(raw) - len(raw.lstrip())
            norm = " ".join(words).strip(EDGE)
            key, n = norm, len(words)
            for before, m in reversed(behind):  # a short unit is told by what precedes it
                if n >= least:
                    break
                key, n = before + "\n" + key, n + m
            if n >= least and norm:
                out.append((start, lo + len(raw.rstrip()), len(words),
                            blake2b(key.encode(), digest_size=16).digest()))
            behind = [*behind[-(least - 1):], (norm, len(words))] if least > 1 else []
        lo = hi
    return out


def lines(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, stop, words, digest) of every line that is not blank; a line of marks only
    is told by them."""
    out, lo = [], 0
    for raw in text.split("\n"):
        words = raw.lower().split()
        if words:
            key = " ".join(words)
            start = lo + len(raw) - len(raw.lstrip())
            out.append((start, lo + len(raw.rstrip()), len(words),
                        blake2b((key.strip(EDGE) or key).encode(), digest_size=16).digest()))
        lo += len(raw) + 1
    return out


def _rows_of(text: str, least: int, by_line: bool) -> Iterator[tuple]:
    """(line, whole, start, stop, words, digest) of the lines and of the units inside
    them; ``line`` is where the line of a unit starts."""
    whole = lines(text)
    for u in whole:
        yield u[0], True, *u
    i = 0
    for u in () if by_line else units(text, least):
        while whole[i][1] <= u[0]:
            i += 1
        yield whole[i][0], False, *u


def unit_rows(docs: DataFrame, least: int = 8, by_line: bool = False) -> DataFrame:
    """``UNIT`` rows of the lines and units of all texts; ``h`` tells apart texts that share an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = [(d, h, *u) for d, h, t in zip(part["doc_id"].to_pylist(), part["h"].to_pylist(),
                                                      part["text"]) for u in _rows_of(t.as_py(), least, by_line)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (
                            pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(),
                            pa.int32(), pa.binary()))],
                        ["doc_id", "h", "line", "whole", "start", "stop", "words", "digest"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.xxhash64(text_of()).alias("h"), text_of().alias("text"))
    return rows.mapInArrow(run, UNIT)


def removed_units(docs: DataFrame, least: int = 8, by_line: bool = False) -> DataFrame:
    """One row per removed line or unit: ``doc_id, h, start, stop, words, keep_id,
    keep_start, copies``; offsets are characters of the original text, and no two spans
    of a text overlap."""
    rows = _written(unit_rows(docs, least, by_line), "units")
    out = _later(rows.where("whole").drop("whole"))
    if not by_line:
        out = _written(out, "lines")
        inside = rows.where("not whole").drop("whole")
        twice = inside.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
        gone = out.select("doc_id", "h", "line").distinct()
        stay = inside.join(twice, "digest").join(gone, ["doc_id", "h", "line"], "left_anti")
        out = out.unionByName(_later(_written(stay, "inside")))
    given = lambda c: F.when(c != NO_ID, c)
    return out.select(
        given(F.col("doc_id")).alias("doc_id"), "h", "start", "stop", "words",
        given(F.col("k.doc_id")).alias("keep_id"), F.col("k.start").alias("keep_start"), "copies",
        F.lower(F.hex("digest")).alias("digest"),
    ).distinct()


def _written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, whose columns are compressed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _later(rows: DataFrame) -> DataFrame:
    """The rows whose digest stands earlier too, with that place ``k`` and ``copies``."""
    rank = F.struct("doc_id", "start", "h")
    first = rows.groupBy("digest").agg(
        F.min(rank).alias("k"), F.count(F.lit(1)).alias("copies")
    ).where("copies > 1").select("digest", "k", "copies")
    return rows.join(first, "digest").where(rank != F.col("k"))


def cleaned(docs: DataFrame, least: int = 8, by_line: bool = False) -> DataFrame:
    """All documents with all columns, ``text`` without the removed units, and ``removed``:
    the (start, stop) spans in the original text. A column ``removed`` is replaced."""
    spans = removed_units(docs, least, by_line).groupBy("doc_id", "h").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_spans")
    ).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h2"), "_spans")
    kept = [c for c in docs.columns if c != "removed"]
    rows = docs.select(*kept, F.xxhash64(text_of()).alias("_h"))
    joined = rows.join(
        spans, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_h2")), "left")

    @F.pandas_udf("string")
    def without(text, cut):
        import pandas as pd

        def one(t, spans):
            if t is None or spans is None:
                return t
            out, at = [], 0
            for s in spans:
                out.append(t[at:s["start"]])
                at = s["stop"]
            return "".join([*out, t[at:]])

        return pd.Series([one(t, c) for t, c in zip(text, cut)], dtype=object)

    empty = F.array().cast("array<struct<start:int,stop:int>>")
    return joined.select(
        *[c for c in kept if c != "text"], without("text", "_spans").alias("text"),
        F.coalesce("_spans", empty).alias("removed"))
