"""Held-out accuracy of the classifiers, their edge cases, and the pipeline's stages."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from panelcore.llm import quality, toxicity

SCHEMA = "doc_id long, text string, score double"


def corpus(spark, n=400, seed=4):
    """Ordinary prose; toxic texts hold a few told words, low quality is symbols."""
    rng = random.Random(seed)
    syll = ["an", "re", "to", "mi", "sol", "ka", "ne", "ru", "vo", "li", "pa", "de"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syll, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        toxic, good = i % 4 == 0, i % 5 != 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grumbock", "snarfling", "wortzel"]))
        if not good:
            words = [w + rng.choice(["%%%", "&&&", "$$$"]) for w in words]
        rows.append((i, " ".join(words), 0.0))
        labels.append((i, int(good), int(toxic)))
    rows += [(n, None, 0.0), (n + 1, "", 0.0), (None, "no id here", 0.0), (3, rows[3][1], 0.0),
             (n + 2, "very long text " * 20000, 0.0)]
    labels += [(3, labels[3][1], labels[3][2]), (None, 1, 1), (n + 50, 1, 0), (n + 1, None, None)]
    return (spark.createDataFrame(rows, SCHEMA),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def ranks_well(got, truth):
    pos = [s for i, s in got if truth[i]]
    neg = [s for i, s in got if not truth[i]]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("module,label,folds,held,cut", [
    (quality, "quality", 4, 2, 0.7), (toxicity, "toxic", 5, 0, 0.5)])
def test_held_out_ranking(spark, module, label, folds, held, cut):
    docs, labels = corpus(spark)
    got = module.scored(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r[label] for r in labels.collect() if r.doc_id is not None and r[label] is not None}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= cut)
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(text.encode()) % folds == held)
    out = [(r.doc_id, r.score) for r in got if r.held_out and r.doc_id in truth]
    assert ranks_well(out, truth) > 0.95
    # What the held-out rows are labelled changes nothing.
    flipped = labels.selectExpr(
        "doc_id", *[f"if(crc32(string(doc_id)) % {folds} = {held}, 1 - {c}, {c}) as {c}"
                    for c in ("quality", "toxic")])
    again = module.scored(docs, flipped).collect()
    key = lambda r: (str(r.doc_id), r.score)
    assert np.allclose([s for _, s in sorted(map(key, got))], [s for _, s in sorted(map(key, again))])


@pytest.mark.parametrize("module,neutral", [(quality, 0.5), (toxicity, 0.0)])
def test_missing_labels_and_rows(spark, module, neutral):
    docs, labels = corpus(spark, 40)
    assert {r.score for r in module.scored(docs, labels.limit(0)).collect()} == {neutral}
    assert module.scored(docs.limit(0), labels).count() == 0
    one = labels.selectExpr("doc_id", "1 as quality", "1 as toxic")
    assert {r.score for r in module.scored(docs, one).collect()} == {1.0}


def test_filter_agrees_with_scores(spark):
    docs, labels = corpus(spark, 200)
    kept = toxicity.clean_rows(docs, labels)
    assert kept.columns == docs.columns
    want = sorted(str(r.doc_id) for r in toxicity.scored(docs, labels).collect() if r.score < 0.5)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, d).toPandas(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0.8 * sizes[0]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, d).toPandas()
    assert len(out) == sizes[-1] and out.groupby("text").shard.nunique().max() == 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_a_window_has_a_byte_bound():
    """Toxic bytes at the end of a long text without spaces count as at its start."""
    rng = random.Random(6)
    toxic = toxicity._compressor(b"grumbocksnarflingwortzel" * 3 + b" base " * 700).compress
    plain = toxicity._compressor(b" base " * 700).compress
    filler = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=31_000)).encode()
    told = b"grumbocksnarflingwortzel"
    at_end, at_start, none = (toxicity.window_stats(t, toxic, plain)[1]
                              for t in (filler + told, told + filler, filler))
    assert at_end > none + 4 and abs(at_end - at_start) <= 4
    text = "ab" * 5000 + " short words"
    pieces = toxicity._words(text.encode())
    assert max(map(len, pieces)) <= toxicity.PIECE and pieces[-2:] == [b"short", b"words"]
