"""Queries of the problems on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from penduline.llm import mixing, overlap, subjects, tokenizer
from penduline.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found(table(spark, d, "view_a"), table(spark, d, "cases"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.counts(table(spark, d, "view_a"), table(spark, d, "cases"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.found(*(table(spark, d, n) for n in ("documents", "subject_areas", "subject_labels")))


def p8_topics(spark: SparkSession, d: str) -> DataFrame:
    return subjects.topics(*(table(spark, d, n) for n in ("documents", "subject_areas", "subject_labels")))


def p8_makeup(spark: SparkSession, d: str) -> DataFrame:
    return subjects.makeup(*(table(spark, d, n) for n in ("documents", "subject_areas", "subject_labels")))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p6_ids, p7_mix, p7_shares, p8_found, p8_topics, p8_makeup)}

_MEMBERS = """
last_release AS (SELECT dataset_id, max(release_no) AS release_no FROM view_a WHERE dataset_id IS NOT NULL GROUP BY dataset_id),
last_delivery AS (SELECT v.dataset_id, v.release_no, max(v.delivered_at) AS at FROM view_a v JOIN last_release l ON v.dataset_id = l.dataset_id AND v.release_no = l.release_no GROUP BY ALL),
scene_rows AS (SELECT unnest(map_entries(v.scenes)) AS s FROM view_a v JOIN last_delivery l ON v.dataset_id = l.dataset_id AND v.release_no = l.release_no AND v.delivered_at IS NOT DISTINCT FROM l.at),
group_rows AS (SELECT unnest(map_entries(s.value)) AS g FROM scene_rows),
members AS (SELECT DISTINCT * FROM (SELECT g.key AS split, unnest(g.value) AS case_id FROM group_rows) WHERE case_id IS NOT NULL),
train AS (SELECT DISTINCT case_id FROM members WHERE split = 'train'),
evaluation AS (SELECT DISTINCT case_id FROM members WHERE split IN ('test_id', 'test_ood1')),
texts AS (SELECT DISTINCT case_id, text.description AS t FROM cases WHERE text.description IS NOT NULL),
word_rows AS (SELECT case_id, t, unnest(regexp_extract_all(lower(t), '[\\p{L}\\p{Nd}]+')) AS w FROM texts),
bags AS (SELECT case_id, t, w, count(*) AS n FROM word_rows GROUP BY ALL),
sizes AS (SELECT case_id, t, sum(n) AS total FROM bags GROUP BY ALL),
shared AS (
  SELECT a.case_id AS train_id, a.t AS t_a, b.case_id AS eval_id, b.t AS t_b, sum(least(a.n, b.n)) AS common
  FROM (SELECT * FROM bags WHERE case_id IN (SELECT case_id FROM train)) a
  JOIN (SELECT * FROM bags WHERE case_id IN (SELECT case_id FROM evaluation)) b ON a.w = b.w AND a.case_id <> b.case_id GROUP BY ALL),
similar_text AS (
  SELECT DISTINCT s.train_id, s.eval_id FROM shared s JOIN sizes a ON a.case_id = s.train_id AND a.t = s.t_a JOIN sizes b ON b.case_id = s.eval_id AND b.t = s.t_b
  WHERE 5 * s.common >= 4 * greatest(a.total, b.total)),
why AS (
  SELECT case_id AS train_id, case_id AS eval_id, 'same_id' AS why FROM train WHERE case_id IN (SELECT case_id FROM evaluation)
  UNION ALL SELECT train_id, eval_id, 'similar_text' FROM similar_text
  UNION ALL SELECT DISTINCT provenance.parent_case_id, case_id, 'parent' FROM cases
    WHERE case_id IN (SELECT case_id FROM evaluation) AND provenance.parent_case_id IN (SELECT case_id FROM train))
"""

#: Encoding, mixing and subjects can't be said in SQL over whole tables: their tests hold them against other ways to the
#: same result.
SQL: dict[str, str] = {
    "p1_found": f"WITH {_MEMBERS} SELECT DISTINCT least(train_id, eval_id) AS case_a, greatest(train_id, eval_id) AS case_b FROM why",
    "p1_counts": f"""WITH {_MEMBERS},
      pairs AS (SELECT train_id, eval_id, max((why = 'same_id')::BIGINT) AS same_id, max((why = 'similar_text')::BIGINT) AS similar_text, max((why = 'parent')::BIGINT) AS parent FROM why GROUP BY ALL),
      kinds AS (SELECT case_id, arg_max(provenance.source_kind, received_at) AS source_kind FROM cases GROUP BY case_id)
      SELECT m.split, coalesce(k.source_kind, '') AS source_kind, count(*) AS pairs, count(DISTINCT p.eval_id) AS eval_cases,
        sum(same_id)::BIGINT AS same_id, sum(similar_text)::BIGINT AS similar_text, sum(parent)::BIGINT AS parent
      FROM pairs p JOIN members m ON m.case_id = p.eval_id AND m.split <> 'train' LEFT JOIN kinds k ON k.case_id = p.eval_id GROUP BY ALL""",
}
