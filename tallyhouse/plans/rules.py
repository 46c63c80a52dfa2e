"""Rules that come as a table, as many as there are parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators import rulebook
from tallyhouse.plans.registry import query
from tallyhouse.sources.tables import Tables, with_

_PATTERN = r"""CASE k % 5 WHEN 0 THEN concat('customer#0*(?:', k, '|', k + 1, ')\\b') WHEN 1 THEN concat('#0*', k, ' +(?P<level>1-urgent|2-high) ')
               WHEN 2 THEN concat('CUSTOMER#0*(', k, '|', k - 1, '|', k + 2, ') .*(?:build|machin)') WHEN 3 THEN concat('([', k) ELSE concat('(?=.*furniture)^ *customer#0*[', k % 10, k % 7, ']', substr(cast(k as string), 2), ' ') END"""
_HITS = " UNION ALL ".join((
    "SELECT l.id, r.k FROM ledger l JOIN r ON l.custkey = r.k WHERE r.k % 5 = 0", "SELECT l.id, r.k FROM ledger l JOIN r ON l.custkey = r.k + 1 WHERE r.k % 5 = 0",
    "SELECT l.id, r.k FROM ledger l JOIN r ON l.custkey = r.k WHERE r.k % 5 = 1 AND l.description[1] IN ('1', '2')",
    *(f"SELECT l.id, r.k FROM ledger l JOIN r ON l.custkey = r.k + {d} WHERE r.k % 5 = 2 AND (l.description LIKE '%BUILDING' OR l.description LIKE '%MACHINERY')" for d in (0, -1, 2)),
    *(f"SELECT l.id, r.k FROM ledger l JOIN r ON l.custkey = TRY_CAST(CAST({digit} AS VARCHAR) || substr(CAST(r.k AS VARCHAR), 2) AS BIGINT) WHERE r.k % 5 = 4 AND l.description LIKE '%FURNITURE'" for digit in ("r.k % 10", "r.k % 7")),
))


@query(with_("ledger", r="SELECT p_partkey AS k, p_partkey % 7 AS priority FROM part", hits=_HITS, first="SELECT h.id, arg_max('category ' || r.k, r.priority * 100000000 - r.k) AS matched FROM hits h JOIN r USING (k) GROUP BY h.id")
       + "SELECT l.id, matched, coalesce(l.category_id, matched) AS category_id FROM ledger l LEFT JOIN first f ON f.id = l.id")
def many_rules(t: Tables) -> DataFrame:
    """A rule a part; of five, one has names that only some engines know, one does not compile, and neighbours match the same rows."""
    rules = t.raw("part").select(F.col("p_partkey").alias("k")).selectExpr(f"{_PATTERN} AS pattern", "concat('category ', k) AS category_id", "k % 7 AS priority", "k AS rule_id")
    return rulebook.apply_rules(t.ledger(), rules).select("id", "matched", "category_id")
