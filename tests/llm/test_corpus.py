"""Mixing, sharding, decontamination, token scan and HTML extraction against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from panelcore.llm import decontam, html_extract, mixing, sharding, token_scan
from panelcore.llm.queries import ORACLES, QUERIES
from panelcore.session import scratch_path

SCHEMA = "doc_id long, text string, source string, size string, shard int"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        source = None if i % 50 == 0 else "hot" if i % 3 else rng.choice(["a", "b", "é", "Z", "zz"])
        rows.append((i, " ".join(["w"] * rng.randint(0, 30)) + f" {i % 70}", source, "s", 1))
    rows += [(1000, None, "a", "", 1), (1001, "", "a", "", 1), (None, "x y", "b", "", 1),
             (7, "again", "a", "", 1), (7, "again", "a", "", 1), (1002, "long " * 5000, "hot", "", 1),
             (1003, "", "only empty", "", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


def test_mix_follows_targets(docs):
    got = mixing.mix(docs).collect()
    rows = docs.collect()
    sizes = sorted((str(r.doc_id), len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in rows)
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sizes
    total = {}
    for r in got:
        total[r.source] = total.get(r.source, 0) + r["size"]
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        open_ = [s for s in order if s not in capped]
        level = (sum(total.values()) - sum(3 * total[s] for s in capped)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * total[s]}
        if not over:
            break
        capped |= over
    taken = {}
    for r in got:
        want = 3 * total[r.source] if r.source in capped else weight[r.source] * level
        assert r.source_size == total[r.source] and math.isclose(r.target, want)
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for r in got:
        assert abs(taken[r.source] - r.target) <= 30
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in got)


def test_shards_are_even_gapless_and_keep_groups(docs):
    got = sharding.placed(docs, shards=5, per_shard=64, cell_rows=100).collect()
    assert len(got) == docs.count()
    load, slots, group = {}, {}, {}
    for r in got:
        load[r.shard] = load.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        assert group.setdefault(r.grp, r.shard) == r.shard
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    big = max(len(r.text or "") + 8 for r in docs.collect())
    assert max(load.values()) <= max(big, sum(load.values()) / 5 * 1.05)
    out = sharding.sharded_rows(docs, shards=5)
    assert out.columns == ["doc_id", "text", "source", "size", "shard", "slot"]
    assert out.count() == len(got)


def test_heap_gives_largest_first():
    got = dict(sharding.lpt([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 3)], 2))
    assert got == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def words_of(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def contamination(text, items):
    w = words_of(text)
    hit, ids = set(), set()
    for item, t in items:
        v = words_of(t)
        n = min(13, len(v))
        for s in range(len(v) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p:p + n] == v[s:s + n]:
                    hit |= set(range(p, p + n))
                    ids |= {item} - {None}
    names = ",".join(sorted(map(str, ids)))
    return (len(w), len(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(w))


def test_decontamination_is_exact(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(6)]  # few words: many partial and overlapping spans
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 12, 13, 14, 30])))) for i in range(12)]
    items += [(3, "V1, v2; V3"), (None, "v0 v0 v0 v0"), (99, None), (98, "!?")]
    rows = []
    for i in range(60):
        t = " ".join(rng.choices(vocab + [f"u{i}"], k=rng.randint(0, 60)))
        if i % 3 == 0:
            t += " -- " + (items[i % 12][1] or "").upper() + " end"
        rows.append((i, t, 1))
    rows += [(None, items[2][1], 1), (100, None, 1), (101, "", 1), (1, rows[1][1], 1), (102, "v0 " * 4000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontam.contamination(docs, bench).collect()), key=str)
    assert got == sorted(((i, *contamination(t, items)) for i, t, _ in rows), key=str)
    clean = decontam.clean_rows(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not contamination(t, items)[-1] for _, t, _ in rows)
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    none = decontam.contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)


def test_separator_scan_round_trip(spark):
    texts = ["", None, "one", "two words here", "long " * 4000, "é\x00 odd", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    path = scratch_path(spark, "stored")
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    enc = token_scan.encoder()
    for block in (1 << 20, 5):
        got = token_scan.token_counts(docs, scratch_path(spark, "tokens"), block=block).collect()
        assert {r.doc_id: r.n_tokens for r in got} == {
            i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
        at = sorted((r.doc_no, r.start, r.n_tokens) for r in got)
        assert [a[0] for a in at] == list(range(len(texts)))
        assert all(b[1] == a[1] + a[2] + 1 for a, b in zip(at, at[1:]))


def test_documents_may_cross_blocks_and_files(spark, tmp_path):
    stream = np.array([5, 6, 0, 0, 7, 8, 9, 1, 2, 0, 4, 0, 3, 3], "<u2")
    for i, part in enumerate(np.split(stream, [1, 1, 5, 8, 11])):  # one file is empty
        part.tofile(tmp_path / f"f{i}.bin")
    for block in (100, 2):
        got = token_scan.documents(spark, str(tmp_path), block).orderBy("doc_no").collect()
        assert [(r.start, r.n_tokens, r.closed) for r in got] == [
            (0, 2, True), (3, 0, True), (4, 5, True), (10, 1, True), (12, 2, False)]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1><p>Claim, long, with many, commas, to score, some points here.</p></header>
<div class="cookie-notice">We use cookies, all of them, please accept this long text.</div>
<div id="content"><h1>Head &amp; more</h1><p>First, with <a href=x>link</a>, goes on&nbsp;and on, more.
<p>Second<br>line, longer, longer, longer text here.<table><tr><td>one<td>two</table><aside>side</aside>
<form>mail <input></form><ul><li>point one<li>point two</ul>
<ul><li><a href=1>a a a a</a><li><a href=2>b b b b</a><li><a href=3>c c c c</a></ul>
<div class=comments><p>A comment, long, really long, and full, of commas.</p></div></div>
<div class="sidebar"><p>Sidebar text, long enough, to be scored, as a paragraph.</p></div>
<script>document.write("</p><p>script")</script><footer>foot</footer></body></html>"""


def test_html_extraction():
    assert html_extract.main_text(PAGE).split("\n\n") == [
        "Head & more", "First, with link, goes on and on, more.",
        "Second line, longer, longer, longer text here.", "one", "two", "point one", "point two"]
    assert html_extract.main_text("plain  &lt;b&gt; text") == "plain <b> text"
    assert html_extract.main_text("<!-- open <p>gone") == ""
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert html_extract.main_text(deep) == "deep"


def test_html_extraction_of_a_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"),
            (3, "w", "<p>" + "word, " * 100000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert [r.page_id for r in got] == [1, 1, 2, None, 3] and got[2].text == "" and got[3].n_chars == 0
    assert all(r.n_chars == len(r.text) for r in got) and got[4].n_chars == 599999
    assert html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    got = QUERIES[name](spark, d).toPandas()
    want = con.execute(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = lambda x: x[cols].astype(str).sort_values(cols).values.tolist()
    assert order(got) == order(want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    assert sharding.shard_table(empty).count() == 0 and sharding.sharded_rows(empty).count() == 0


def test_counts_do_not_hang_on_a_second_read(spark):
    """Rows come in another order each time they are read."""
    texts = {i: "word " * (i % 37) for i in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)

    def shuffled(batches):
        import os
        for b in batches:
            yield b.take(pa.array(np.argsort(np.frombuffer(os.urandom(8 * b.num_rows), np.uint64))))

    docs = docs.select("doc_id", "text").mapInArrow(shuffled, "doc_id long, text string")
    enc = token_scan.encoder()
    got = {r.doc_id: r.n_tokens for r in token_scan.token_counts(docs, scratch_path(spark, "tokens")).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in texts.items()}


def test_packed_files_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * i) for i in range(200)], "doc_id long, text string").coalesce(1)
    path = scratch_path(spark, "tokens")
    token_scan.pack(docs, path, most=4000)
    files = spark.read.format("binaryFile").load(f"{path}/kind=tokens").select("length").collect()
    assert len(files) > 5 and all(r.length <= 4000 for r in files)
    monkeypatch.setattr(token_scan.pack, "__defaults__", (*token_scan.pack.__defaults__[:-1], 4000))
    got = token_scan.token_counts(docs, scratch_path(spark, "tokens")).collect()
    enc = token_scan.encoder()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(enc.encode_ordinary("word " * i)) for i in range(200)}
