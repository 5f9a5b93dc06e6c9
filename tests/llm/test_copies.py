"""Exact dedup, SimHash near-dedup and line dedup against brute force."""

import hashlib
import random
import re

import pytest
import xxhash

from panelcore.llm import components, exact_dedup, line_dedup, simhash

SCHEMA = "doc_id long, text string, keep_id string, fp long"
WORDS = [f"w{i}" for i in range(60)]


def odd_rows(seed=1):
    """Copies, near copies, repeated rows, nulls, blanks, one long text, clashing columns."""
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(1, 40))) for _ in range(12)]
    rows = [(i, rng.choice(base), "x", 7) for i in range(80, 0, -1)]
    rows += [(200 + i, base[0] + f" tail{i % 7}", None, i) for i in range(30)]
    rows += [(300, base[1].upper(), "", 0), (301, base[1].replace(" ", " \t\n"), "", 0)]
    rows += [(5, "same row", "", 1), (5, "same row", "", 1), (5, "other text", "", 1)]
    rows += [(400, None, "", 1), (401, "", "", 1), (402, " \t ", "", 1), (None, base[2], "", 1),
             (None, None, "", 1), (403, " ".join(WORDS * 3000), "", 1), (404, "é É x", "", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


def plain(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups(docs):
    got = sorted(exact_dedup.duplicate_groups(docs, width=8, fan=2).collect(), key=str)
    rows = odd_rows()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(plain(t), []).append(i)
    assert len(got) == len(rows)
    kept = {}
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        members = groups[sha[r.text_sha256]]
        ids = [m for m in members if m is not None]
        assert r.group_size == len(members)
        assert r.keep_id == (min(ids) if ids else None)
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    one = exact_dedup.deduplicated(docs)
    assert one.columns == docs.columns and one.count() == len(groups)


def simhash_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[j:j + k]).encode(), 42) for j in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("bucket", [64, 1])
def test_simhash_components(docs, bucket):
    rows = odd_rows()
    fp = [simhash_of(t, 3) for _, t, *_ in rows]
    root = closure(set(fp), lambda a, b: (a ^ b).bit_count() <= 2)
    low = {}
    for (i, *_), f in zip(rows, fp):
        if i is not None:
            low[root[f]] = min(i, low.get(root[f], i))
    want = sorted(((i, f"{f:016x}", low.get(root[f])) for (i, *_), f in zip(rows, fp)), key=str)
    got = simhash.near_duplicates(docs, words=3, bucket=bucket).collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_pigeonring_loses_no_link(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for bits in (1, 2, 3, 4):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), bits)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for bucket in (64, 2):
        edges = simhash.links(df, bucket=bucket)
        comp = {r.node % (1 << 64): r.root for r in components.components(edges).collect()}
        want = closure(fps, lambda a, b: (a ^ b).bit_count() <= 2)
        got = {}
        for f in fps:
            got.setdefault(comp.get(f, f"own{f}"), set()).add(f)
        classes = {}
        for f, r in want.items():
            classes.setdefault(r, set()).add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))


def test_one_per_group_keeps_columns(docs):
    kept = simhash.one_per_group(docs, words=3)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids))


def test_long_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "u long, v long")
    got = dict(components.components(edges).collect())
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000


def test_line_dedup_matches_brute_force(spark):
    s = "one two three four five six seven eight nine."
    rows = [(2, f"Start here now. {s} Mid words only here.\n{s.upper()}", "r"), (1, f"{s}\nshort. line", "r"),
            (3, f"{s} short. line", "r"), (3, f"{s} short. line", "r"), (4, None, "r"), (5, "", "r"),
            (None, s, "r"), (6, "a. " * 50, "r"), (7, "word " * 60000, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    got = {(r.doc_id, r.start, r.stop, r.keep_id, r.keep_start) for r in line_dedup.removed_units(docs).collect()}
    seen = {}
    for i, t, _ in rows:
        for u in line_dedup.units(t or ""):
            seen.setdefault(u[3], set()).add((line_dedup.NO_ID if i is None else i, u[0], u[1]))
    want = set()
    for v in seen.values():
        first, *rest = sorted(v)
        want |= {(None if x[0] == line_dedup.NO_ID else x[0], x[1], x[2], first[0], first[1]) for x in rest}
    assert got == want and (2, 16, 16 + len(s), 1, 0) in got
    out = line_dedup.cleaned(docs)
    text = {r.doc_id: r for r in out.collect()}
    assert sorted(out.columns) == ["doc_id", "removed", "text"]
    assert text[1].text == rows[1][1] and text[4].text is None and s not in text[2].text
    assert text[2].removed[0].start == 16


def test_short_units_need_their_context():
    units = line_dedup.units
    assert units("Yes. No. Maybe.") == []
    long = "a b c d e f g h. "
    assert len(units(long + "Yes.")) == 2
    assert units(long + "Yes.")[1][3] != units("b b c d e f g h. Yes.")[1][3]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.duplicate_groups(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert line_dedup.removed_units(empty).count() == 0
    assert line_dedup.cleaned(empty).count() == 0


def test_whole_lines_go_however_short(spark):
    licence, long = "Licensed under CC BY-NC 4.0.", "one two three four five six seven. Eight nine."
    rows = [(1, f"{licence}\nfirst\n{long}\n---"), (2, f"second\n{licence}\n{long}\nend\n---"),
            (3, licence), (4, f"  {licence.upper()}\n\nlast")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text.split() for r in line_dedup.cleaned(docs).collect()}
    assert out == {1: rows[0][1].split(), 2: ["second", "end"], 3: [], 4: ["last"]}
    for r in line_dedup.cleaned(docs).collect():
        assert all(a.stop <= b.start for a, b in zip(r.removed, r.removed[1:]))
