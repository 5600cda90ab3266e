"""SQL for DuckDB that checks problem 1."""

from __future__ import annotations

from . import survivor as _x


def _wordy(c: str) -> str:
    return (
        f"NOT regexp_matches(lower(trim({c})), $r${_x.STAND_IN}$r$) AND NOT regexp_matches(lower(trim({c})), $r${_x.NOT_GIVEN}$r$)"
        + rf" AND NOT regexp_matches(trim({c}), $r$\x{{FFFD}}|Ã.|â€$r$) AND NOT regexp_matches(trim({c}), $r$^\s*(\.\.\.|…|\[)$r$)"
        + f" AND NOT regexp_matches(lower(trim({c})), $r${_x.OMISSION}" + r"[\s.]*$$r$)"
    )


_DOI = r"^10\.\d{4,9}/\S*[\p{L}\p{N}]\S*$"
_TITLE = (
    r"NOT regexp_matches(trim(journal), '^[\p{Lu}&]{2,6}$') AND NOT regexp_matches(trim(journal), '\p{L}\.(\s|$)')"
    rf" AND NOT regexp_matches(lower(trim(journal)), $r${_x.HEADS}$r$)"
    r" AND regexp_matches(trim(journal), '^[\p{Lu}\p{N}]') AND regexp_matches(trim(journal), '\p{L}{2}')"
)
_PAGES = _x.PAGES.replace("‐-―−", r"\x{2010}-\x{2015}\x{2212}")
_CLOSED = r"""regexp_matches(trim(abstract), $r$[.!?。]["'”’)\]]*$$r$) AND regexp_matches(trim(abstract), '\s')"""

SURVIVE = rf"""
WITH m AS (SELECT c.*, coalesce(o.trust, -2147483648) AS trust, regexp_replace(trim(lower(doi)), '^(https?://[^/\s]+/|doi:\s*)', '') AS d
           FROM merge_candidates c LEFT JOIN origins o ON c.origin = o.origin),
dois AS (SELECT DISTINCT group_id, d FROM m
         WHERE regexp_matches(d, '{_DOI}') AND NOT regexp_matches(d, $r${_x.OMISSION}|\x{{FFFD}}|\?$|/x+$$r$)
           AND length(regexp_replace(d, '[^(]', '', 'g')) = length(regexp_replace(d, '[^)]', '', 'g'))),
whole AS (SELECT * FROM dois a WHERE NOT EXISTS (SELECT 1 FROM dois b WHERE a.group_id = b.group_id AND a.d <> b.d AND starts_with(b.d, a.d))),
names AS (SELECT journal, count(*) AS n FROM m WHERE {_wordy("journal")} AND {_TITLE} GROUP BY 1),
word AS (SELECT DISTINCT journal, n, unnest(regexp_split_to_array(lower(journal), '[^\p{{L}}\p{{M}}]+')) AS w FROM names),
freq AS (SELECT w, sum(n) AS n FROM word WHERE w <> '' AND w NOT IN ({", ".join(f"'{w}'" for w in _x.FUNCTION_WORDS)}) GROUP BY 1),
short AS (SELECT a.w FROM freq a JOIN freq b ON starts_with(b.w, a.w) AND length(b.w) > length(a.w) GROUP BY a.w, a.n HAVING max(b.n) >= 2.0 * a.n),
titles AS (SELECT journal FROM names WHERE journal NOT IN (SELECT journal FROM word WHERE w IN (SELECT w FROM short))),
texts AS (SELECT lower(trim(abstract)) AS k FROM m WHERE {_wordy("abstract")} AND {_CLOSED} GROUP BY 1 HAVING count(DISTINCT group_id) < 5),
ok AS (
  SELECT group_id, 'doi' AS field, member_id, trust, modified FROM m WHERE (group_id, d) IN (SELECT (group_id, d) FROM whole)
  UNION ALL SELECT group_id, 'journal', member_id, trust, modified FROM m WHERE journal IN (SELECT journal FROM titles)
  UNION ALL SELECT group_id, 'abstract', member_id, trust, modified FROM m WHERE lower(trim(abstract)) IN (SELECT k FROM texts)
  UNION ALL SELECT group_id, 'pages', member_id, trust, modified FROM m WHERE regexp_matches(lower(trim(pages)), $r${_PAGES}$r$)
    AND TRY_CAST(regexp_extract(lower(trim(pages)), $r${_PAGES}$r$, 1) AS HUGEINT) < TRY_CAST(regexp_extract(lower(trim(pages)), $r${_PAGES}$r$, 2) AS HUGEINT)),
won AS (SELECT group_id, field, member_id FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id, field ORDER BY trust DESC, modified DESC, member_id) AS rn FROM ok) WHERE rn = 1)
"""
