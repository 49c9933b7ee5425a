"""The registered queries of this subpackage, one per operator, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trajspark.llm.common import table

Job = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Job] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Job) -> Job:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


OP7 = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM p),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT g.doc_id, unnest(generate_series(g.i, g.i + 12)) AS j FROM g JOIN f ON g.g = f.g WHERE f.first < g.doc_id),
d AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, ws, coalesce(js, []) AS js,
  list_filter(ws, lambda x, n: NOT list_contains(coalesce(js, []), n)) AS kept FROM w LEFT JOIN d ON w.doc_id = d.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - len(kept))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""


@query("op7_substring_dedup", OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated 13-word passages removed from every document."""
    from trajspark.llm.substrings import repeated_spans
    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


OP5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS node, b AS seen FROM t UNION SELECT r.node, t.b FROM r JOIN t ON t.a = r.seen),
c AS (SELECT node, min(seen) AS first FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(first, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(first, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""


@query("op5_minmax_near_dedup", OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    from trajspark.llm.neardup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


OP3 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  (('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
o AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT min_by(level, cap / weight) FROM l WHERE level * weight <= cap) * weight, cap)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT *, floor(target + 0.5)::BIGINT - whole * source_size AS extra FROM p),
v AS (SELECT *, (length(CASE WHEN size = 0 THEN '0' ELSE ltrim(bin(size), '0') END) // 2)::INTEGER AS level FROM d),
g AS (SELECT source, level, sum(size)::BIGINT AS words FROM v GROUP BY ALL),
h AS (SELECT g.*, (extra - coalesce(sum(words) OVER (PARTITION BY g.source ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / nullif(sum(words * pow(2.0, -level)) OVER (PARTITION BY g.source ORDER BY level ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS rate FROM g JOIN q ON g.source IS NOT DISTINCT FROM q.source),
r AS (SELECT source, coalesce(min_by(coalesce(rate, 0), level) FILTER (coalesce(rate, 0) * pow(2.0, -level) <= 1), 0) AS rate FROM h GROUP BY source),
x AS (SELECT v.*, source_size, target, whole, extra, least(1.0::DOUBLE, rate * pow(2.0, -v.level)) AS chance FROM v JOIN q ON v.source IS NOT DISTINCT FROM q.source JOIN r ON v.source IS NOT DISTINCT FROM r.source),
y AS (SELECT *, CASE WHEN chance > 0 THEN u * (1 - chance) / (chance * (1 - u)) ELSE 'inf'::DOUBLE END AS odds FROM x),
z AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds, u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM y)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, extra - before)))::BIGINT AS taken FROM z
"""


@query("op3_pareto_mix", OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    from trajspark.llm.mixing import mix_sizes
    return mix_sizes(table(spark, sf_dir, "documents"))


@query("op6_min_slack_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens."""
    from trajspark.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"))


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the learned decision list."""
    from trajspark.llm.quality import quality_rules
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_multiset_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    from trajspark.llm.fingerprints import fingerprints
    return fingerprints(table(spark, sf_dir, "documents"))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    from trajspark.llm.toxicity import toxicity
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    from trajspark.llm.langid import languages
    return languages(table(spark, sf_dir, "documents"))


@query("op2_host_trust")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    from trajspark.llm.hosts import url_verdicts
    return url_verdicts(table(spark, sf_dir, "pages"))


@query("op10_html_blocks")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    from trajspark.llm.html import extract
    return extract(table(spark, sf_dir, "pages"))


@query("op12_sentencepiece")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded texts of all documents."""
    from trajspark.llm.pieces import piece_digests
    return piece_digests(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, after the planted repetitions."""
    from trajspark.llm.runs import run_digests
    return run_digests(table(spark, sf_dir, "documents"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of all conversations after the damage, and their cheapest repair."""
    from trajspark.llm.conversations import repair_digests
    return repair_digests(table(spark, sf_dir, "conversations"))
