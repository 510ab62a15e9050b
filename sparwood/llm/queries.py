"""Queries of the training-data problems and the SQL they can be held against."""

from __future__ import annotations

from . import groups, leaks, sentences, tokens, topn

QUERIES = {
    "p3_found": topn.p3_found,
    "p4_found": groups.p4_found,
    "p4_sizes": groups.p4_sizes,
    "p6_ids": tokens.p6_ids,
    "p6_counts": tokens.p6_counts,
    "p7_found": leaks.p7_found,
    "p7_spans": leaks.p7_spans,
    "p8_found": sentences.p8_found,
    "p8_sentences": sentences.p8_sentences,
}

_SPECIES = "nullif(regexp_replace(lower(regexp_replace(species, '^\\s+|\\s+$', '', 'g')), '[-\\s]', '_', 'g'), '')"

_LABELS = """
WITH RECURSIVE pairs AS (SELECT id_a AS a, id_b AS b FROM ecotones WHERE id_a IS NOT NULL AND id_b IS NOT NULL),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
labels(id, group_id) USING KEY (id) AS (
  SELECT DISTINCT a, a FROM links
  UNION
  SELECT l.b, min(n.group_id) FROM labels n JOIN links l ON l.a = n.id JOIN recurring.labels k ON k.id = l.b
  WHERE n.group_id < k.group_id GROUP BY l.b)
"""

ORACLE = {
    "p4_found": f"{_LABELS} SELECT id, group_id FROM labels",
    "p4_sizes": f"{_LABELS} SELECT size, count(*) AS n_groups FROM (SELECT count(*) AS size FROM labels GROUP BY group_id) GROUP BY size",
    "p3_found": f"""
        SELECT candidate_id, CAST(place AS INTEGER) AS rank_macrocluster FROM (
          SELECT candidate_id, row_number() OVER (PARTITION BY run_id, sp, macrocluster_id
            ORDER BY scout_score DESC, id_a NULLS LAST, id_b NULLS LAST, candidate_id) AS place
          FROM (SELECT *, {_SPECIES} AS sp FROM scout_candidates)
          WHERE scout_score IS NOT NULL AND NOT isnan(scout_score) AND sp IS NOT NULL AND macrocluster_id IS NOT NULL AND run_id IS NOT NULL)
        WHERE place <= 10""",
}
