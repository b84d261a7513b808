"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.pii import digest, find_pii

    return digest(find_pii(_docs(spark, sf_dir)))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts before and after personal data is replaced; the edits touch few leaves."""
    from tidewater.llm.token_counts import apply_edits, build_index, counts, redactions

    return counts(apply_edits(redactions(build_index(_docs(spark, sf_dir).select("doc_id", "text")))))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.language_id import identify

    return identify(_docs(spark, sf_dir)).selectExpr("doc_id", "held_out", "lang_pred", "score", "size(spans) as n_spans", "size(filter(spans, s -> s.lang <> lang_pred)) as n_switched")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.decontaminate import contaminated

    return contaminated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.toxicity import toxicity

    return toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.packing import pack

    return pack(_docs(spark, sf_dir))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.ann import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.jaccard_join import jaccard_components

    return jaccard_components(_docs(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.line_dedup import dedup_lines

    return dedup_lines(_docs(spark, sf_dir)).selectExpr("doc_id", "text", "cast(__n_lines as long) as n_lines", "cast(__n_removed as long) as n_removed")


def op10_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.sharding import shard_documents

    return shard_documents(_docs(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.conversation_repair import repair

    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.quality_rules import build_ledger, verdicts

    return verdicts(build_ledger(_docs(spark, sf_dir)))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.source_divergence import audit

    return audit(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_token_counts,
        op3_language_id,
        op4_benchmark_decontamination,
        op5_toxicity,
        op6_best_fit_packing,
        op7_nearest_neighbours,
        op8_ngram_jaccard_join,
        op9_line_dedup,
        op10_balanced_sharding,
        op11_conversation_repair,
        op12_quality_rules,
        op13_source_divergence,
    )
}
ORACLES: dict[str, str] = {
    "op8_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS gs FROM w),
s AS (SELECT doc_id, len(gs)::BIGINT AS n, unnest(gs) AS g FROM g),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM g UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id WHERE r.root < l.y)
SELECT g.doc_id, len(gs)::BIGINT AS n_shingles, c.component_id FROM g JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1) c ON g.doc_id = c.doc_id""",
    "op11_conversation_repair": r"""
WITH RECURSIVE tb AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tb),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c // 256, tb[xor(c, b) % 256 + 1])), 4294967295) % 20 AS how FROM conversations, tb),
d AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE how WHEN 3 THEN [0, 1] ELSE [0] END) AS cp FROM h WHERE how <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, cp)::BIGINT AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, cp) AS j, role[1] AS r FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN j > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS two FROM o),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b')::BIGINT AS blank, count(*) FILTER (fault = 'd')::BIGINT AS duplicate, count(*) FILTER (fault = 't')::BIGINT AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, count(*) AS n FROM f GROUP BY 1),
ins(q, made, mid) AS (VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3), (2, '', 2), (2, 'I', 3), (3, '', 3), (3, 'I', 2)),
ops(mid, op, r, q2, c) AS (VALUES (0, 'D', NULL, 0, 4), (1, 'D', NULL, 1, 4), (2, 'D', NULL, 2, 4), (3, 'D', NULL, 3, 4), (0, 'R', NULL, 2, 3), (1, 'R', NULL, 2, 3), (2, 'R', NULL, 3, 3), (3, 'R', NULL, 2, 3), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0), (0, 'K', '', 0, 0), (1, 'K', '', 1, 0), (2, 'K', '', 2, 0), (3, 'K', '', 3, 0)),
mv AS (SELECT q, q2, made || op AS e, op, r, c + 3 * len(made) AS c FROM ins JOIN ops USING (mid)),
p(conv_id, i, q, b) AS (SELECT conv_id, 0::BIGINT, 0, {'c': 0, 'a': ''} FROM s UNION ALL
  SELECT p.conv_id, p.i + 1, mv.q2, min({'c': p.b.c + mv.c + CASE WHEN f.fault = 't' AND mv.op <> 'D' THEN 3 ELSE 0 END, 'a': p.b.a || mv.e}) FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN mv ON mv.q = p.q AND (mv.r IS NULL OR mv.r = f.r) AND (mv.op = 'D' OR f.fault NOT IN ('b', 'd')) GROUP BY 1, 2, 3),
z AS (SELECT s.conv_id, min({'c': p.b.c + 3 * len(e.t), 'a': p.b.a || e.t}) AS b FROM s JOIN p ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.i = s.n JOIN (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) e(q, t) ON e.q = p.q GROUP BY 1),
l AS (SELECT conv_id, unnest(string_split(b.a, '')) AS e, unnest(range(len(b.a))) AS x FROM z WHERE b.a <> ''),
m AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY x) AS i FROM l),
y AS (SELECT m.conv_id, m.x, e, f.role, CASE e WHEN 'I' THEN '' ELSE f.text END AS text, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.x) AS k, first_value(e = 'K' AND f.r = 's') OVER (PARTITION BY m.conv_id ORDER BY m.x) AS s FROM m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.i = m.i WHERE e <> 'D'),
g AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (k - s::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY x) AS t FROM y GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(z.b.c, 0)::BIGINT AS cost, coalesce(z.b.a, '') AS audit, sha256(coalesce(g.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id""",
    "op12_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
a AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM a WHERE n > 1) GROUP BY 1),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '[!?]')) AS n_marks, len(regexp_extract_all(t, '[A-Za-z]')) AS n_letters, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END AS base, CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_marks > 50 * n_words THEN 8 ELSE 0 END
  + CASE WHEN n_letters >= 100 AND 100 * n_capitals > 50 * n_letters THEN 16 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 64 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 128 ELSE 0 END AS more FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base > 0 AS base_failed, base + more = 0 AS kept, (base + more)::BIGINT AS failed FROM f""",
    "op13_source_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT lang, source, id, unnest(ts) AS t FROM d), k AS (SELECT lang, t FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10), g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT l.lang, count(k.t) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN k USING (lang) GROUP BY 1), c AS (SELECT t.lang, source, t.t, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.t = t.t GROUP BY 1, 2, 3),
m AS (SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS gn, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.t) AS ln, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS lt FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
p AS (SELECT m.lang, source, t, n, (1 + 1000000000::HUGEINT * (n + 2) // (gn + 2 * v))::HUGEINT AS p, (1 + 1000000000::HUGEINT * (ln + 2) // (lt + 2 * v))::HUGEINT AS q FROM m JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT lang, source, 'term', t, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= 10""",
}
