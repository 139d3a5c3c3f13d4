"""Queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, exact_dedup, line_dedup, manifest, maxent, order_minhash, packing, repeats, surrogates, tiling, token_counts, token_output, toxicity
from .common import read_documents


#: The query's key. Whoever uses the operator gives a secret of their own.
EXAMPLE_KEY = "neargrid-example-key"


def op1_rans_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_ids(read_documents(spark, sf_dir))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(read_documents(spark, sf_dir))


def op3_deep_shallow_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read_documents(spark, sf_dir))


def op4_grace_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_texts(read_documents(spark, sf_dir))


def op5_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymize(read_documents(spark, sf_dir), EXAMPLE_KEY)


def op8_maxent_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(read_documents(spark, sf_dir))


def op9_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_documents(spark, sf_dir, "lang", "source", "text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read_documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verify(read_documents(spark, sf_dir, "doc_id", "source", "lang", "n_chars", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


OP4_SQL = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
    FROM documents
), ranked AS (
    SELECT doc_id, content,
           first_value(doc_id) OVER (PARTITION BY content ORDER BY length(text) DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY content) AS group_size
    FROM cut
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM ranked
"""


OP11_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
    SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), langs AS (
    SELECT lang, sum(total) AS n, count(*) AS v FROM kept GROUP BY lang
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), found AS (
    SELECT lang, source, term, count(*) AS count FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), sums AS (
    SELECT g.lang, g.source, coalesce(sum(count), 0) AS n FROM groups g LEFT JOIN found USING (lang, source) GROUP BY g.lang, g.source
), shares AS (
    SELECT s.lang, s.source, k.term, coalesce(f.count, 0) AS count,
           (1 + 1000000000::HUGEINT * (coalesce(f.count, 0) + 1)::HUGEINT // (s.n + l.v)::HUGEINT) AS p,
           (1 + 1000000000::HUGEINT * (k.total + 1)::HUGEINT // (l.n + l.v)::HUGEINT) AS q
    FROM sums s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN found f ON f.lang = s.lang AND f.source = s.source AND f.term = k.term
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
    WHERE x.term IS NULL OR y.term IS NOT NULL
    GROUP BY a.lang, a.source, b.source
), terms AS (
    SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE count > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
OP12_SQL = r"""
WITH cut AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), each AS (
    SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM cut
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each
), told AS (
    SELECT *, length(key) < 10 OR doc_id = min(doc_id) OVER (PARTITION BY key) AS kept FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_FIELDS = " || ".join(_FIELD.format(x) for x in ("doc_id", "source", "lang", "{n}", "text"))
#: crc32 bit by bit, as DuckDB has no such function.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"""
OP13_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256({_FIELDS.format(n="n_chars")}) AS leaf,
           sha256({_FIELDS.format(n="(n_chars + CASE WHEN " + _CRC + " % 7 = 0 THEN 1 ELSE 0 END)")}) AS changed
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), low AS (
    SELECT grp, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY grp) AS nodes FROM placed
    UNION ALL
    SELECT grp, any_value(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(nodes) + 1) // 2 FROM low WHERE nodes > 1 GROUP BY grp, pos // 2
), subroots AS (
    SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS nodes FROM low WHERE nodes = 1
), high AS (
    SELECT 0 AS level, pos, h, nodes FROM subroots
    UNION ALL
    SELECT any_value(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(nodes) + 1) // 2 FROM high WHERE nodes > 1 GROUP BY pos // 2
), steps AS (
    SELECT grp, level, pos, h, nodes FROM low WHERE nodes > 1
), walk AS (
    SELECT doc_id, grp, pos AS place, 0 AS level, pos, false AS up, leaf, changed AS folded, '' AS proof FROM placed
    UNION ALL
    SELECT w.doc_id, w.grp, w.place,
           CASE WHEN NOT w.up AND d.pos IS NULL AND n.pos IS NULL THEN 0 ELSE w.level + 1 END,
           CASE WHEN NOT w.up AND n.pos IS NULL THEN r.pos ELSE w.pos // 2 END,
           w.up OR n.pos IS NULL, w.leaf,
           CASE WHEN NOT w.up AND n.pos IS NULL THEN w.folded WHEN w.pos % 2 = 0 THEN sha256(w.folded || coalesce(d.h, u.h, '')) ELSE sha256(coalesce(d.h, u.h) || w.folded) END,
           w.proof || coalesce(d.h, u.h, '')
    FROM walk w
    LEFT JOIN steps n ON NOT w.up AND n.grp = w.grp AND n.level = w.level AND n.pos = w.pos
    LEFT JOIN steps d ON NOT w.up AND d.grp = w.grp AND d.level = w.level AND d.pos = xor(w.pos, 1)
    LEFT JOIN subroots r ON NOT w.up AND n.pos IS NULL AND r.grp = w.grp
    LEFT JOIN high m ON w.up AND m.level = w.level AND m.pos = w.pos
    LEFT JOIN high u ON w.up AND u.level = w.level AND u.pos = xor(w.pos, 1)
    WHERE NOT w.up OR m.nodes > 1
), ended AS (
    SELECT doc_id, grp, place, leaf, last(folded ORDER BY up, level) AS folded_root, last(proof ORDER BY up, level) AS proof FROM walk GROUP BY doc_id, grp, place, leaf
)
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = t.h AS verified
FROM ended JOIN subroots s USING (grp) CROSS JOIN (SELECT h FROM high WHERE nodes = 1) t
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_grace_exact_dedup": OP4_SQL, "op11_source_divergence": OP11_SQL, "op12_line_dedup": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
