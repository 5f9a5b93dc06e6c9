"""Conversation trie, exact top-k search and Merkle manifest against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcore.llm import merkle, prefix_trie, va_search

TURNS = "conv_id long, turn long, role string, text string, ord string, node int, _c string"
VECTORS = "vec_id long, embedding array<float>, label int, key string, v int"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree int, leaf string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- conversation prefix trie


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = digest(f"{len(role.encode())}:", role, text)[:32]
            own[c].append(((t is not None, t or 0), key, (role, text)))
    seq = {}
    for c, turns in own.items():
        turns.sort(key=lambda x: x[:2])
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - int(math.fmod(c, 100)), [])
        seq[c] = tuple(x[2] for x in base[:h]) + tuple(x[2] for x in turns[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[:d - 1]].add(s[:d])
    saved, leaves = defaultdict(int), defaultdict(int)
    for s, m in members.items():
        for d in range(len(s) + 1):
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1]) if s else 0
            leaves[s[:d]] += not kids[s]
    return sorted(
        ((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s],
          saved[s], digest(",".join(str(c) for c in sorted(m) if len(seq[c]) == len(s))))
         for s, m in members.items()), key=str)


def odd_turns():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "tool"]), rng.choice(["a", "bé", "", "c" * 9]))
            for c in range(0, 60) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", f"snapshot {t}") for c in range(400, 430) for t in range(c - 399)]
    rows += [(c, t, "user", "hot") for c in range(1000, 1400, 3) for t in range(4)]
    rows += [(700, t, "user", f"long {t}") for t in range(500)]
    rows += [(-7, 1, "user", "negative"), (-7, 0, None, None), (150, 0, "user", "x" * 50_000)]
    rows += [(151, None, "user", "no turn"), (151, 1, "user", "tie"), (151, 1, "tool", "tie"),
             (151, 1, "user", "tie"), (152, 3, "user", "only one")]
    rows += [(None, 0, "user", "no conversation"), (None, None, None, None)]
    rows = [(*r, "x", 1, None) for r in rows]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns", [1 << 18, 60])
def test_trie_nodes(spark, turns):
    rows = odd_turns()
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    got = prefix_trie.conversation_trie(df, turns=turns)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
               "saved_tokens", "ends_sha256"]
    assert set(got.columns) == {"node", *columns}
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.conversation_trie(empty).count() == 0
    unnamed = spark.createDataFrame([(None, 0, "user", "x", "", 1, "")], TURNS)
    assert prefix_trie.conversation_trie(unnamed).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_exit_node_is_the_deepest_shared_prefix(seed):
    rng = random.Random(seed)
    trie, seen = prefix_trie.ZFastTrie(), {()}
    for _ in range(400):
        s = tuple(rng.choices("ab", k=rng.randint(0, rng.choice([3, 8, 40]))))
        path = [prefix_trie.ROOT]
        for x in s:
            path.append(hashlib.blake2b(path[-1] + x.encode(), digest_size=16).digest())
        node, depth = trie.exit(path)
        assert depth == max(d for d in range(len(s) + 1) if s[:d] in seen)
        assert node.above <= depth <= node.extent and node.path[depth] == path[depth]
        trie.insert(path, [0] * len(path), [0])
        seen |= {s[:d] for d in range(len(s) + 1)}
    for handle, node in trie.handles.items():
        assert node.handle() == handle


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 60):
            want = max(range(low + 1, high + 1), key=lambda n: n & -n)
            assert prefix_trie.two_fattest(low, high) == want


# ---- exact top-k search


def search_by_hand(rows, k, every):
    usable = [(i, [math.floor(256 * x) for x in e]) for i, e, *_ in rows
              if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for n, (i, q) in enumerate(usable):
        if i is None or i % every:
            continue
        others = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0)
                        for m, (j, v) in enumerate(usable) if m != n)
        out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(others[:k])]
    return sorted(out, key=str)


def odd_vectors(seed=2):
    rng = random.Random(seed)
    def some(scale=1.0):
        return [rng.gauss(0, scale) for _ in range(8)]
    common = some()
    rows = [(i, common if i % 3 == 0 else some(), i, "k", 1) for i in range(300)]
    rows += [(300 + i, [x + rng.gauss(0, 1e-4) for x in common], None, None, 0) for i in range(80)]
    rows += [(50, common, 0, "", 0), (50, some(), 0, "", 0), (None, common, 0, "", 0),
             (500, None, 0, "", 0), (501, [1.0, None], 0, "", 0), (502, [float("nan")] * 8, 0, "", 0),
             (503, [float("-inf")] + some()[1:], 0, "", 0), (550, [2.0, 1.0], 0, "", 0),
             (600, [], 0, "", 0), (650, [1e6] * 8, 0, "", 0), (651, [-1e6] * 8, 0, "", 0)]
    rng.shuffle(rows)
    single = lambda x: None if x is None else float(np.float32(x))
    return [(i, None if e is None else [single(x) for x in e], *rest) for i, e, *rest in rows]


@pytest.mark.parametrize("bits,panel", [(6, 1 << 20), (1, 48)])
def test_top_k(spark, monkeypatch, bits, panel):
    monkeypatch.setattr(va_search, "PANEL", panel)  # 48: six queries a panel
    rows = odd_vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = va_search.top_k(df, F.col("vec_id") % 50 == 0, k=5, bits=bits, sample=64)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == search_by_hand(rows, 5, 50)


def test_top_k_of_few_and_of_large(spark):
    asked = F.col("vec_id") % 50 == 0
    assert va_search.top_k(spark.createDataFrame([], VECTORS), asked).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 0, "", 0)], VECTORS)
    assert va_search.top_k(alone, asked).count() == 0
    rows = [(0, [3e38, 1.0], 0, "", 0), (1, [3e38, 2.0], 0, "", 0), (2, [-3e38, 0.0], 0, "", 0)]
    got = va_search.top_k(spark.createDataFrame(rows, VECTORS), asked).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (2, -(2**63))]


# ---- Merkle manifest


def manifest_by_hand(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = defaultdict(list)
    for i, s, lang, n, t, *_ in rows:
        leaf = digest(*map(part, (i, s, lang, n, t)))
        bad = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        by[s].append((i, leaf, digest(*map(part, (i, s, lang, n, t and t.translate(low)))) if bad else leaf))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([digest(*last[k:k + 16]) for k in range(0, len(last), 16)])
        return levels

    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: tree([x[1] for x in by[s]]) for s in names}
    upper = tree([trees[s][-1][0] for s in names])
    root, out = upper[-1][0], []
    for at, s in enumerate(names):
        for k, (i, leaf, changed) in enumerate(by[s]):
            proof, h = [], changed
            for levels, p in ((trees[s], k), (upper, at)):
                for row in levels[:-1]:
                    run, q = row[p // 16 * 16:p // 16 * 16 + 16], p % 16
                    proof += run[:q] + run[q + 1:]
                    h, p = digest(*run[:q], h, *run[q + 1:]), p // 16
            out.append((i, leaf, trees[s][-1][0], root, digest(*proof), h, h == root))
    return sorted(out, key=str)


def odd_docs():
    rows = [(i, "big", "en", i, f"Text {i}") for i in range(66_000)]
    rows += [(i, "b", None, None, "Words") for i in range(257)] + [(i, "a", "en", 1, "x") for i in range(17)]
    rows += [(7, f"s{k}", "fr", 2, "É Word") for k in range(40)]  # more sources than one run holds
    rows += [(5, None, "en", 3, None), (None, None, "en", 3, "A"), (None, "", None, None, ""),
             (11, "a", "en", 1, "same"), (11, "a", "en", 1, "same"), (11, "a", "en", 1, "other"),
             (12, "é", "en", 1, "LONG WORD " * 20_000)]
    return [(*r, 1, "clash") for r in rows]


def test_manifest(spark):
    rows = odd_docs()
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = merkle.manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == manifest_by_hand(rows)


@pytest.mark.parametrize("n", [0, 1, 16, 256])
def test_small_manifests(spark, n):
    rows = [(i, "s", "en", 1, "Aa", 0, "") for i in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == (manifest_by_hand(rows) if rows else [])


def test_versions_share_untouched_nodes():
    tree, levels = merkle.grown([digest(str(i)) for i in range(200)], 200)
    other = merkle.replaced(tree, 37, levels, digest("tampered"))
    assert other.digest != tree.digest
    fresh = [k for k, (a, b) in enumerate(zip(tree.kids, other.kids)) if a is not b]
    assert fresh == [37 // 16]
    assert sum(a is not b for a, b in zip(tree.kids[2].kids, other.kids[2].kids)) == 1
