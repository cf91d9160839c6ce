"""Query on the divergence of sources."""

from __future__ import annotations

from foliant.llm.registry import query
from foliant.llm.shared import LOWER, UPPER, table
from foliant.llm.source_divergence import source_divergence

_SHARE = "1 + 1000000000::HUGEINT * ({} + 2) // ({} + 2 * v)"
_DIVERGENCE = "((p - q) * (p - q) // (p + q))"


@query("op12_source_divergence", f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
totals AS (SELECT lang, term, count(*) AS c_lang FROM t GROUP BY 1, 2
  HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(c_lang) AS n_lang FROM totals GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS c FROM t JOIN totals USING (lang, term)
  GROUP BY 1, 2, 3),
grid AS (SELECT lang, source, term, coalesce(c, 0) AS c, c_lang FROM groups
  JOIN totals USING (lang) LEFT JOIN counts USING (lang, source, term)),
sizes AS (SELECT lang, source, sum(c) AS n FROM grid GROUP BY 1, 2),
shares AS (SELECT lang, source, term, c, {_SHARE.format('c', 'n')} AS p,
  {_SHARE.format('c_lang', 'n_lang')} AS q FROM grid JOIN sizes USING (lang, source)
  JOIN langs USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, a.term, a.p, b.p AS q FROM shares a
  JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source),
sums AS (SELECT lang, source, item, sum({_DIVERGENCE}) AS value FROM pairs GROUP BY 1, 2, 3),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, {_DIVERGENCE} FROM shares WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM found) WHERE part = 'pair' OR rank <= 10
""")
def op12_source_divergence(spark, sf_dir):
    """Divergence of the sources of each language over the whole texts of all documents."""
    return source_divergence(table(spark, sf_dir, "documents"))
