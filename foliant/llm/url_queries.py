"""Query on addresses."""

from __future__ import annotations

from foliant.llm.path_templates import TemplateRule, judge_urls
from foliant.llm.registry import query
from foliant.llm.shared import LOWER, UPPER, table

#: Verdict, host and beginning of the path.
RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
_RULE = TemplateRule()


def _rule_sql(value: int) -> str:
    """The rule's text (value 1) or verdict (0) for a host and path."""
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    cases = " ".join(
        f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{start}') "
        f"THEN '{own + start if value else verdict}'" for verdict, own, start in ordered
    )
    return f"CASE {cases} END"


_SEGMENT = """
list_transform(list_transform(pieces[1:{depth}], lambda s: {{
    'text': s, 'ending': regexp_extract(s, '\\.[A-Za-z]{{2,5}}$', 0),
    'digits': length(regexp_replace(s, '[^0-9]', '', 'g'))
}}), lambda s: CASE
    WHEN regexp_full_match(left(s.text, length(s.text) - length(s.ending)), '[0-9]+')
        THEN concat('{{number}}', s.ending)
    WHEN regexp_full_match(left(s.text, length(s.text) - length(s.ending)), '[0-9A-Fa-f-]{{8,}}')
        AND s.digits > 0 THEN concat('{{hex}}', s.ending)
    WHEN length(s.text) - length(s.ending) > 32 OR s.digits >= 4
        THEN concat('{{mixed}}', s.ending)
    ELSE s.text END)
""".format(depth=_RULE.depth)


def _smoothed(blocked: str, labelled: str, above: str) -> str:
    return (f"(({blocked})::HUGEINT * 1000000000 + {_RULE.strength} * ({above})::HUGEINT) "
            f"// (({labelled})::HUGEINT + {_RULE.strength})")


def _level_sql(at: int) -> str:
    return f"""
here{at} AS (
    SELECT *, nullif(string_split(shape, '/')[{at + 1}], '') AS segment FROM shapes{at}
), nodes{at} AS (
    SELECT host, template, share, segment, sum(n) AS n, sum(labelled)::DOUBLE AS m,
        sum(blocked)::DOUBLE AS b
    FROM here{at} WHERE segment IS NOT NULL GROUP BY ALL
), parents{at} AS (
    SELECT host, template, count(*) AS children, sum(n) AS all_n, sum(m) AS every_m,
        sum(b) AS every_b
    FROM nodes{at} GROUP BY ALL
), forms{at} AS (
    SELECT host, template, share, segment, m, b, CASE
        WHEN children > {_RULE.children} AND all_n < {_RULE.rows_per_child} * children THEN '*'
        WHEN children > 1 AND (b * every_m - every_b * m) * (b * every_m - every_b * m)
            <= {_RULE.deviations ** 2} * m * every_b * (every_m - every_b) THEN '*'
        ELSE segment END AS form
    FROM nodes{at} JOIN parents{at} USING (host, template)
), below{at} AS (
    SELECT host, template, form, {_smoothed('sum(b)', 'sum(m)', 'share')} AS next
    FROM forms{at} GROUP BY host, template, form, share
), shapes{at + 1} AS (
    SELECT h.host, h.shape, h.n, h.labelled, h.blocked,
        h.template || coalesce('/' || f.form, '') AS template, coalesce(next, h.share) AS share
    FROM here{at} h LEFT JOIN forms{at} f
        ON h.host = f.host AND h.template = f.template AND h.segment = f.segment
    LEFT JOIN below{at} w ON w.host = f.host AND w.template = f.template AND w.form = f.form
)"""


_SQL = f"""
WITH after AS (
    SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
        THEN substr(url, instr(url, '://') + 3) ELSE '' END AS address FROM pages
), plain AS (
    SELECT page_id, split_part(split_part(address, '?', 1), '#', 1) AS address FROM after
), places AS (
    SELECT page_id, translate(split_part(address, '/', 1), '{UPPER}', '{LOWER}') AS host,
        substr(address, length(split_part(address, '/', 1)) + 1) AS path FROM plain
), pieces AS (
    SELECT *, {_rule_sql(1)} AS rule, {_rule_sql(0)} AS label,
        list_filter(string_split(path, '/'), lambda s: s <> '') AS pieces FROM places
), rows AS (
    SELECT *, coalesce(array_to_string({_SEGMENT}, '/'), '')
        || CASE WHEN len(pieces) > {_RULE.depth} THEN '/{{tail}}' ELSE '' END AS shape FROM pieces
), plain_shapes AS (
    SELECT host, shape, count(*) AS n, count(label) AS labelled,
        count(*) FILTER (label = 'block') AS blocked,
        regexp_extract(host, '([^.]*[.])?[^.]*$') AS domain FROM rows GROUP BY host, shape
), every AS (
    SELECT coalesce(sum(blocked), 0)::HUGEINT * 1000000000
        // greatest(1, coalesce(sum(labelled), 0))::HUGEINT AS share FROM plain_shapes
), domains AS (
    SELECT domain, {_smoothed('sum(blocked)', 'sum(labelled)', 'any_value(every.share)')} AS share
    FROM plain_shapes, every GROUP BY domain
), hosts AS (
    SELECT host, {_smoothed('sum(blocked)', 'sum(labelled)', 'any_value(d.share)')} AS share
    FROM plain_shapes JOIN domains d USING (domain) GROUP BY host
), shapes0 AS (
    SELECT host, shape, n, labelled, blocked, '' AS template, share
    FROM plain_shapes JOIN hosts USING (host)
), {",".join(_level_sql(at) for at in range(_RULE.depth + 1))},
verdicts AS (
    SELECT host, template, CASE
        WHEN {_smoothed('sum(blocked)', 'sum(labelled)', 'share')} * 100
            >= {_RULE.threshold_percent * 10 ** 9}
        THEN 'block' ELSE 'allow' END AS verdict
    FROM shapes{_RULE.depth + 1} GROUP BY host, template, share
)
SELECT page_id, r.host, path, rule, coalesce(label, verdict) AS verdict, s.template
FROM rows r JOIN shapes{_RULE.depth + 1} s ON r.host = s.host AND r.shape = s.shape
JOIN verdicts v ON s.host = v.host AND s.template = v.template
"""


@query("op4_path_templates", _SQL)
def op4_path_templates(spark, sf_dir):
    """Verdicts on the addresses of all pages."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, _RULE)
