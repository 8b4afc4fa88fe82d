"""The queries opN_<name> over whole tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.spread import spread
from . import decontamination, divergence, embeddings, fill_in_middle, packing, passages, quality_rules, sequences, sharding, simhash, site_quality, viterbi, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return captures.select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("metadata.refers_to").cast("long").alias("refers_to"),
    )


def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no url: their source stands for the host and the language for the path inside it."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return site_quality.score_sites(docs, labels, F.col("source"), F.col("lang"))


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op5_passage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find_passages(_table(spark, sf_dir, "documents"))


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.arrow_sequences(_table(spark, sf_dir, "documents"))


def op8_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1")
    scored = quality_rules.score_quality(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), trusted)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_grams", "llr")
    return scored.select("doc_id", *(f"quality.{c}" for c in names))


def op10_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_cross_polytope_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicate_embeddings(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents")).drop("output")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_template_decontamination, op2_warc_captures, op3_site_quality, op4_minimax_shards, op5_passage_chains, op6_simhash_components, op7_arrow_sequences, op8_residual_packing, op9_llr_quality, op10_viterbi_counts, op11_cross_polytope_components, op12_fill_in_middle, op13_source_divergence)}

# Base32 of a SHA-1: each 5 hexadecimal digits are 4 characters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, {5 * g + 1}, 5) AS BIGINT) >> {shift}) & 31 AS INTEGER) + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0)
)

ORACLES: dict[str, str] = {
    "op2_warc_captures": "WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p) "
    f"SELECT page_id, strlen(h) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM m",
    "op11_cross_polytope_components": """WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a""",
    "op12_fill_in_middle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
    WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, least(a, b) AS x, greatest(a, b) AS y FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, x) || '<S>' || substr(t, y + 1) || '<M>' || substr(t, x + 1, y - x)
    ELSE '<S>' || substr(t, y + 1) || '<P>' || substr(t, 1, x) || '<M>' || substr(t, x + 1, y - x) END) AS output_sha256, sha256(t) AS restored_sha256 FROM c""",
    "op13_source_divergence": r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t, row_number() OVER () AS i FROM documents),
w AS (SELECT lang, source, i, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS whole FROM k GROUP BY lang),
c AS (SELECT w.lang, source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, source, w.term),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY lang, source),
s AS (SELECT g.lang, g.source, v.v, coalesce(gn.total, 0) AS total FROM g JOIN v ON g.lang = v.lang LEFT JOIN gn ON g.lang = gn.lang AND g.source = gn.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (s.total + 2 * s.v) AS BIGINT) AS p,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (k.n + 2)) // (v.whole + 2 * v.v) AS BIGINT) AS q
    FROM s JOIN k ON s.lang = k.lang JOIN v ON s.lang = v.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10""",
}
