"""Line dedup against a brute force of its own, with repeated, clashing and null ids."""

import random
from collections import Counter, defaultdict

from panelcore.llm import line_dedup

SCHEMA = "doc_id long, text string, h string, line int, digest int"


def rows(seed=5):
    rng = random.Random(seed)
    pool = ["Licensed under CC BY.", "  shared   LINE, of several words ", "a", "!!", "short one",
            "É ligne répétée", "x " * 300]
    out = []
    for i in range(60):
        own = [rng.choice(pool) if rng.random() < 0.6 else f"own {i} {k}" for k in range(rng.randint(0, 6))]
        out.append((rng.choice([i, 7, None]), "\n".join(own)))
    out += [(7, "same\nlines"), (7, "same\nlines"), (7, "same\nother"), (None, "same\nthere"),
            (None, "same\nhere"), (3, None), (4, ""), (5, " \n\t"), (9, "same\nsame\nsame")]
    rng.shuffle(out)
    return [(*r, "x", 1, 2) for r in out]


def plain(line):
    words = " ".join(line.lower().split())
    return words.strip(".,;:!?… ") or words


def test_one_place_of_every_line_stays(spark):
    given = rows()
    df = spark.createDataFrame(given, SCHEMA).repartition(4)
    gone = {(r.doc_id, r.h, r.start) for r in line_dedup.removed_units(df, by_line=True).collect()}
    from pyspark.sql import functions as F

    digest = {r.text: r.d for r in df.select("text", F.xxhash64("text").alias("d")).collect() if r.text}
    places = defaultdict(set)
    for doc, text, *_ in given:
        at = 0
        for line in (text or "").split("\n"):
            if line.split():
                start = at + len(line) - len(line.lstrip())
                places[plain(line)].add((doc, digest[text], start))
            at += len(line) + 1
    rank = lambda p: (p[0] is None, p[0] or 0, p[2], p[1])
    want = set().union(*(p - {min(p, key=rank)} for p in places.values()))
    assert len(want) > 60 and gone == want


def test_cleaned_texts_hold_every_line_once(spark):
    given = rows(6)
    df = spark.createDataFrame(given, SCHEMA).repartition(3)
    out = line_dedup.cleaned(df, by_line=True)
    assert set(out.columns) == {*df.columns, "removed"} and out.count() == len(given)
    once = {(r.doc_id, r.text, str(r.removed)) for r in out.collect()}  # repeated rows keep the same
    seen = Counter(plain(x) for _, t, _ in once for x in (t or "").split("\n") if x.split())
    assert set(seen.values()) == {1}
    assert set(seen) == {plain(x) for _, t, *_ in given for x in (t or "").split("\n") if x.split()}


def test_two_null_ids_with_one_line_at_one_offset(spark):
    text = [(None, "shared line\nA"), (None, "shared line\nB"), (1, "same\nc"), (1, "same\nd")]
    df = spark.createDataFrame([(*r, "", 0, 0) for r in text], SCHEMA)
    assert line_dedup.removed_units(df).count() == 2
