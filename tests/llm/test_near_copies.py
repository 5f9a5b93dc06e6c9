"""The pipeline's near-dedup stage against brute force on planted near copies."""

import random

import corpus_pipeline
from panelcore.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, source string"


def edited(rng, words, share):
    w = list(words)
    for i in rng.sample(range(len(w)), max(1, round(share * len(w)))):
        w[i] = f"new{rng.randrange(10**6)}"
    return w


def planted(families, copies, share, seed=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [f"w{rng.randrange(4000)}" for _ in range(300)]
        for k in range(copies):
            rows.append((len(rows), " ".join(edited(rng, base, share) if k else base), "s"))
    return rows


def alike(a, b):
    s, t = near_copies.shingles(a.encode()), near_copies.shingles(b.encode())
    return len(s & t) >= 0.8 * len(s | t)


def test_stage_catches_near_copies(spark):
    rows = planted(60, 2, 0.015)
    rows += [(500, "Short text", "s"), (501, "short  TEXT", "s"), (502, "short texts", "s"),
             (503, None, "s"), (504, " ", "s"), (None, rows[0][1], "s"), (7, rows[7][1], "s")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    text = {i: t or "" for i, t, _ in rows}
    want = {2 * k + 1 for k in range(60) if alike(text[2 * k], text[2 * k + 1])} | {501, 504}
    assert len(want) > 40
    kept = corpus_pipeline.without_near_copies(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i in {*text} - want)


def test_crowded_keys_lose_no_family(spark):
    rows = planted(3, 60, 0.008)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    kept = sorted(r.doc_id for r in near_copies.one_per_group(docs, bucket=4).collect())
    assert kept == [0, 60, 120]
    assert near_copies.one_per_group(docs.limit(0)).count() == 0


def components_by_hand(rows):
    """Smallest id of each row's group, by all pairs."""
    text = [(i, t or "") for i, t, _ in rows]
    sets = [near_copies.shingles(t.encode()) for _, t in text]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                group[b] = a
    lowest = {}
    for x, (i, _) in enumerate(text):
        lowest[root(x)] = min(i, lowest.get(root(x), i))
    return sorted(lowest.values())


def test_crowded_sparse_families_against_all_pairs(spark):
    """Chains in which neighbours are similar and ends are not, all in crowded keys: a
    node linked to a pivot still has links of its own to nodes the pivot does not reach."""
    rng = random.Random(9)
    rows = []
    for _ in range(3):
        w = [f"w{rng.randrange(3000)}" for _ in range(240)]
        for k in range(50):
            rows.append((len(rows), " ".join(w), "s"))
            at = (4 * k) % 236  # the next text of the chain replaces four words in a row
            w = w[:at] + [f"c{rng.randrange(10**6)}" for _ in range(4)] + w[at + 4:]
        shared = [f"p{rng.randrange(3000)}" for _ in range(200)]
        for _ in range(40):  # one long passage, too little of it to be alike
            own = [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([20, 60, 90]))]
            rows.append((len(rows), " ".join(shared + own), "s"))
    want = components_by_hand(rows)
    assert 3 < len(want) < len(rows) / 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for bucket in (2, 32):
        kept = sorted(r.doc_id for r in near_copies.one_per_group(docs, bucket=bucket).collect())
        assert kept == want


def test_different_texts_under_one_id_both_stay(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta", "a"), (1, "one two three four five six", "b"),
            (1, "alpha beta gamma delta epsilon zeta", "c"), (2, "ALPHA beta gamma delta epsilon zeta", "d"),
            (None, "alpha beta gamma delta epsilon zeta", "e")]
    kept = near_copies.one_per_group(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [
        ("1", rows[0][1]), ("1", rows[1][1]), ("None", rows[0][1])]


def test_stage_starts_from_simhash_groups(spark):
    """Texts one SimHash bit or two apart are one group of op6's operator before any key."""
    rows = planted(20, 3, 0.004)
    docs = spark.createDataFrame(rows, SCHEMA)
    signed = near_copies.signed(docs).collect()
    assert {r.doc_id: r.fp % 2**64 for r in signed} == {
        i: simhash.fingerprint(t.encode(), 5) for i, t, _ in rows}
    nodes = spark.createDataFrame([(r.doc_id, r.fp) for r in signed], "node long, fp long")
    heads = {r.b: r.a for r in near_copies._simhash_heads(nodes).collect()}
    want = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, words=5).collect()}
    assert heads == {i: c for i, c in want.items() if i != c} and heads


def test_a_shared_passage_is_not_compared_by_pairs(spark, monkeypatch):
    """Texts alike in one long passage only: comparisons grow with texts, not pairs."""
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(120)]
    rows = [(i, " ".join(passage + [f"o{rng.randrange(10**9)}" for _ in range(26)]), "s") for i in range(240)]
    rows += [(1000 + i, t, s) for i, t, s in planted(1, 80, 0.012)]
    compared, alike_ = [], near_copies._alike

    def counted(sets, pairs, similarity):
        compared.append(pairs.count())
        return alike_(sets, pairs, similarity)

    monkeypatch.setattr(near_copies, "_alike", counted)
    kept = near_copies.one_per_group(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(r.doc_id for r in kept) == components_by_hand(rows)
    assert sum(compared) <= 10 * len(rows)
