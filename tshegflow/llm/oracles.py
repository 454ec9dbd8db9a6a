"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

_TERM_COUNTS = """
WITH errors AS (SELECT DISTINCT id, job_id, word FROM spell_errors),
  terms AS (
    SELECT 'error_word' AS field, word AS term, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT job_id) AS BIGINT) AS records
    FROM errors WHERE word IS NOT NULL AND word <> '' GROUP BY word
    UNION ALL
    SELECT 'times_seen', CAST(times_seen AS VARCHAR), CAST(count(*) AS BIGINT), CAST(count(DISTINCT id) AS BIGINT) FROM word WHERE times_seen IS NOT NULL GROUP BY times_seen
  ),
  totals AS (
    SELECT 'error_word' AS field, count(DISTINCT job_id) AS total FROM spell_errors
    UNION ALL SELECT 'times_seen', count(times_seen) FROM word
  ),
  marked AS (
    SELECT field, term, occurrences, records, occurrences < 3 AS is_rare, records * 5 > total AS is_common FROM terms JOIN totals USING (field)
  )
"""

P5_TERM_COUNTS = _TERM_COUNTS + "SELECT * FROM marked"
P5_FOUND = _TERM_COUNTS + "SELECT field, term, 'rare' AS mark FROM marked WHERE is_rare UNION ALL SELECT field, term, 'common' FROM marked WHERE is_common"


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_FOUND, "p5_term_counts": P5_TERM_COUNTS}
