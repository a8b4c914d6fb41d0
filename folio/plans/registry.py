"""The registry of queries, and the ledger as DuckDB SQL for their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.sources import projection

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The two fiscal years that queries compare.
YEAR, BEFORE = 2000, 1999


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


LEDGER = f"""
src AS (SELECT l_linenumber AS n, l_orderkey, l_partkey, l_suppkey % 5 AS s5, p_name, s_name,
  {_list(projection.PNL_ACCOUNTS)}[l_partkey % 24 + 1] AS pnl, {_list(projection.BALANCE_ACCOUNTS)}[l_suppkey % 10 + 1] AS bal,
  {_list(projection.JOURNALS)}[l_suppkey % 6 + 1] AS jrn, CAST(l_shipdate AS DATE) AS ship, l_returnflag = 'R' AS ret,
  CAST(CASE WHEN l_linenumber = 7 THEN floor(l_extendedprice / 1000) * 1000 + 1000 ELSE l_extendedprice END AS DECIMAL(18,2)) AS amt
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
src2 AS (SELECT *, make_date(year(ship), 12, 31) AS ye, 'S' || s5 AS site, starts_with(pnl, '6') <> ret AS deb,
  CASE n WHEN 1 THEN 'FACTURE FA-' || year(ship) || '-' || lpad(CAST(l_orderkey % 1000 AS VARCHAR), 3, '0') || ' ' || p_name
    WHEN 2 THEN 'REGUL ' || p_name || ' ' || lpad(CAST(month(ship) AS VARCHAR), 2, '0') || '/' || year(ship)
    WHEN 3 THEN 'PROVISION ' || p_name WHEN 4 THEN 'EXTOURNE FNP ' || p_name WHEN 5 THEN 'LOYER MENSUEL S' || s5
    WHEN 6 THEN 'ABT CFE' ELSE 'ARRONDI SOLDE ' || p_name END AS label FROM src),
post AS (
  SELECT CASE WHEN pnl IN ('695000', '6815000') THEN ye ELSE ship END AS date, pnl AS account, jrn AS journal, 'P' || l_orderkey AS voucher, label, site, NULL AS third_party, deb, amt FROM src2 WHERE n <> 6
  UNION ALL SELECT CASE WHEN pnl IN ('695000', '6815000') THEN ye ELSE ship END, bal, jrn, 'P' || l_orderkey, label, site, s_name, NOT deb, amt FROM src2 WHERE n <> 6
  UNION ALL SELECT ship, '633100', 'OD', 'A' || l_orderkey || '-' || l_partkey || '-D', label, site, NULL, l_partkey % 2 = 0, amt FROM src2 WHERE n = 6
  UNION ALL SELECT ship, '488000', 'OD', 'A' || l_orderkey || '-' || l_partkey || '-D', label, site, s_name, l_partkey % 2 <> 0, amt FROM src2 WHERE n = 6
  UNION ALL SELECT ye, '633100', 'OD', 'A' || l_orderkey || '-' || l_partkey || '-R', label, site, NULL, l_partkey % 2 <> 0, amt FROM src2 WHERE n = 6
  UNION ALL SELECT ye, '488000', 'OD', 'A' || l_orderkey || '-' || l_partkey || '-R', label, site, s_name, l_partkey % 2 = 0, amt FROM src2 WHERE n = 6),
typed AS (SELECT date, account, journal, voucher, label, site, third_party,
  CAST(CASE WHEN deb THEN amt ELSE 0 END AS DECIMAL(18,2)) AS debit, CAST(CASE WHEN deb THEN 0 ELSE amt END AS DECIMAL(18,2)) AS credit FROM post),
ledger AS (SELECT *, CAST(debit - credit AS DECIMAL(18,2)) AS amount, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, strftime(date, '%Y-%m') AS period,
  account[1] AS class, account[1:2] AS prefix_2, account[1:3] AS prefix_3,
  CAST(CASE account[1] WHEN '6' THEN debit - credit WHEN '7' THEN credit - debit ELSE 0 END AS DECIMAL(18,2)) AS pnl_amount FROM typed)
"""


def query(name: str, sql: str | None = None, head: str = "", once: bool = False) -> Callable[[Callable[[DataFrame], DataFrame]], Callable]:
    """Register a function of the ledger, which reads it once or more often. sql may use the ledger table and the CTEs in head."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(projection.ledger(spark, sf_dir, once))
        if sql:
            ORACLES[name] = f"WITH {LEDGER}{', ' + head if head else ''}\n{sql}"
        return f

    return register


def r(expr: str, places: int = 4) -> str:
    """Rounded double in SQL, never a negative zero; to few places by way of a decimal."""
    if places >= 6:
        return f"(round(CAST({expr} AS DOUBLE), {places}) + 0)"
    return f"(CAST(round(TRY_CAST(CAST({expr} AS DOUBLE) AS DECIMAL(28,6)), {places}) AS DOUBLE) + 0)"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A CTE of literal rows."""
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows) + ")"


def case(pairs: list[tuple[str, str]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def in_list(items) -> str:  # noqa: ANN001
    return "(" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + ")"
