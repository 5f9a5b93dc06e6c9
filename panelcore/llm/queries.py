"""One registered query per operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcore.llm import (
    decontam,
    exact_dedup,
    html_extract,
    line_dedup,
    merkle,
    mixing,
    prefix_trie,
    quality,
    sharding,
    simhash,
    token_scan,
    toxicity,
    va_search,
)
from panelcore.llm.common import table
from panelcore.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.scored(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op2_separator_scan(spark: SparkSession, d: str) -> DataFrame:
    return token_scan.token_counts(table(spark, d, "documents"), scratch_path(spark, "tokens"))


@query
def op3_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.removed_units(table(spark, d, "documents"))


@query
def op4_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), cycle=(5, 2, 1), max_repeats=3)


@query
def op5_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard_table(table(spark, d, "documents"), shards=24)


@query
def op6_simhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"), words=3, budget=2)


@query
def op7_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


ORACLES["op7_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n,
         array_to_string(list_slice(w, s, s + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit))
  GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query
def op8_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return html_extract.extract(table(spark, d, "pages"))


@query
def op9_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, d, "documents"))


ORACLES["op9_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM n
"""


@query
def op10_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.scored(table(spark, d, "documents"), table(spark, d, "labels"))


def _crc32_sql(text: str) -> str:
    """crc32 of a decimal number's text: DuckDB has no such function."""
    byte = "list_transform(string_split(" + text + ", ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    bit = "xor(x >> 1, 3988292384 * (x & 1))"
    fold = f"list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: {bit})"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {byte}), lambda c, b: {fold}))"


@query
def op11_conversation_trie(spark: SparkSession, d: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, d, "conversations")).drop("node")


ORACLES["op11_conversation_trie"] = f"""
WITH t AS (
  SELECT conv_id, s, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, s) AS ord
  FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS n,
               substr(sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '')
                             || coalesce(text, '')), 1, 32) AS s
        FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32_sql("conv_id::VARCHAR")} % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT conv_id, s, n, row_number() OVER (PARTITION BY conv_id ORDER BY part, ord) AS d
      FROM (SELECT c.conv_id, 0 AS part, ord, s, n FROM c JOIN t ON t.conv_id = c.base AND ord <= h
            UNION ALL
            SELECT c.conv_id, 1, ord, s, n FROM c JOIN t ON t.conv_id = c.conv_id AND ord > h)),
p AS (SELECT conv_id, d, n, string_agg(s, ',') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
g AS (SELECT k, max(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS n FROM p GROUP BY k),
e AS (SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
      FROM p JOIN (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id) USING (conv_id, d) GROUP BY k),
up AS (SELECT DISTINCT a.k AS k, b.k AS kid FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.d = a.d + 1),
kids AS (SELECT k, count(*) AS n_children FROM up GROUP BY k),
below AS (SELECT DISTINCT a.k AS top, b.k AS k FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.d >= a.d),
s AS (SELECT top, sum((n_convs - 1) * n) AS saved, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS leaves
      FROM below JOIN g USING (k) LEFT JOIN kids USING (k) GROUP BY top)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, pg.conv_id AS parent_conv_id, g.n_convs,
       coalesce(n_children, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM g JOIN s ON s.top = g.k LEFT JOIN kids ON kids.k = g.k LEFT JOIN e ON e.k = g.k
LEFT JOIN up ON up.kid = g.k LEFT JOIN g pg ON pg.k = up.k
"""


@query
def op12_va_search(spark: SparkSession, d: str) -> DataFrame:
    return va_search.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


ORACLES["op12_va_search"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score,
         row_number() OVER (PARTITION BY q.r ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM s WHERE rank <= 5
"""


@query
def op13_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    return merkle.manifest(table(spark, d, "documents"))


def _merkle_sql(levels: tuple[int, int] = (5, 3)) -> str:
    """Level after level of sources' trees, then of the tree over sources; up to
    16^5 leaves a source and 16^3 sources."""
    def part(c: str) -> str:
        return f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [f"""d AS (
  SELECT doc_id, source IS NOT NULL AS named, coalesce(source, '') AS src, {leaf('text')} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_crc32_sql("doc_id::VARCHAR")} % 5 = 0
              THEN {leaf(low)} ELSE {leaf('text')} END AS changed
  FROM documents)""", """l0 AS (
  SELECT *, leaf AS h, row_number() OVER (PARTITION BY named, src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)"""]

    def climb(kind: str, group: str, count: int) -> None:
        for i in range(count):
            ctes.append(f"""{kind}{i + 1} AS (
  SELECT {group}, pos // 16 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS n FROM {kind}{i}) GROUP BY {group}, pos // 16)""")
            mine = f"PARTITION BY {group}, pos // 16 ORDER BY pos ROWS BETWEEN"
            ctes.append(f"""{kind}{i}s AS (
  SELECT {group}, pos, count(*) OVER (PARTITION BY {group}) > 1 AS live,
         coalesce(string_agg(h, '') OVER ({mine} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
         coalesce(string_agg(h, '') OVER ({mine} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z
  FROM {kind}{i})""")

    climb("l", "named, src", levels[0])
    ctes.append(f"""u0 AS (
  SELECT 1 AS one, named, src, h, row_number() OVER (ORDER BY named, src) - 1 AS pos FROM l{levels[0]})""")
    climb("u", "one", levels[1])
    ctes.append("""f0 AS (
  SELECT l0.*, u0.pos AS upos, u0.h AS subroot, changed AS f, '' AS p FROM l0 JOIN u0 USING (named, src))""")
    k = 0
    for kind, count, on in (("l", levels[0], "s.named = f.named AND s.src = f.src AND s.pos = f.pos // {w}"),
                            ("u", levels[1], "s.pos = f.upos // {w}")):
        for i in range(count):
            ctes.append(f"""f{k + 1} AS (
  SELECT f.* EXCLUDE (f, p), CASE WHEN live THEN sha256(a || f.f || z) ELSE f.f END AS f,
         f.p || CASE WHEN live THEN a || z ELSE '' END AS p
  FROM f{k} f JOIN {kind}{i}s s ON {on.format(w=16**i)})""")
            k += 1
    return "WITH " + ", ".join(ctes) + f"""
SELECT doc_id, leaf, subroot, root.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = root.h AS verified
FROM f{k}, (SELECT h FROM u{levels[1]}) root"""


ORACLES["op13_merkle_manifest"] = _merkle_sql()
