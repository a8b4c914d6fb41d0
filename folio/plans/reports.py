"""Queries of the report tables."""

from __future__ import annotations

from folio.operators import reports as o
from folio.plans.passage import ALL
from folio.plans.registry import BEFORE, YEAR, query, r
from folio.plans.runrate import BRIDGE

query(
    "snk01_drill_down",
    "SELECT status, account, variation, labels, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY status ORDER BY abs(variation) DESC, account) AS INT) AS rank FROM (SELECT status, account, sum(variation) AS variation, count(*) AS labels FROM br GROUP BY ALL)) WHERE rank <= 5", BRIDGE,
)(lambda led: o.comparison_tables(led, YEAR, BEFORE)["drill_down"])
FIGURES = ("gross_charges", "gross_products", "gross_result", "adjustment", "normalized_charges", "normalized_products", "normalized_result")
SUMS = ", ".join(f"{r(f'sum({c})', 2)} AS {c}" for c in FIGURES)
query("snk02_monthly_with_total", f"SELECT CAST(month AS VARCHAR) AS month, {', '.join(f'{r(c, 2)} AS {c}' for c in FIGURES)} FROM pm UNION ALL SELECT 'TOTAL', {SUMS} FROM pm", ALL)(lambda led: o.passage_tables(led, YEAR)["monthly"])
