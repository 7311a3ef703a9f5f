"""Write PLANS.md: the physical plan tree of key queries at a scale factor,
with each scan's pushed filters and read schema.

usage: python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from martlet.registry import queries  # noqa: E402
from martlet.session import build_session  # noqa: E402

KEYS = ["top_items", "trend_day", "growth_month", "dimension_breakdown", "wide_events",
        "first_touch", "funnel_strict", "cohort_matrix", "rfm_base", "rfm_distribution",
        "pareto_share", "kpi_summary"]

NOTES = {
    "top_items": "Per-task partial sums, one exchange on item_id, then TakeOrderedAndProject "
                 "(per-task top-10 + one 10-row merge). Date range pushed into the orders scan.",
    "trend_day": "Groups on the date value (compact key); distinct orders as a two-level aggregate "
                 "keyed first on (date, order_id).",
    "growth_month": "One scan of the union of the three windows, one conditional aggregate.",
    "dimension_breakdown": "Expand + one partial aggregate for the three grouping sets; the rank "
                           "window runs on the aggregated slices only.",
    "wide_events": "Business window pushed to the scan as an epoch range when the log stores ts; "
                   "dimensions are joined without hints (Spark broadcasts below its byte threshold); the left join to "
                   "items becomes inner (null-price drop).",
    "first_touch": "Partial min() per (user, item) before the only exchange.",
    "funnel_strict": "Two aggregates, both partial before their exchanges; the stage unpivot is a "
                     "codegen'd Generate (stack) inside the stage.",
    "cohort_matrix": "Distinct (user, date) with partial aggregation, then a window by user over at "
                     "most one row per active day; cells counted; cohort size from the day-0 cell. "
                     "The users join is removed by Catalyst (distinct over left columns).",
    "rfm_base": "count(distinct order) planned as partial aggregates keyed on (user, order), then "
                "by user: a hot buyer is spread over tasks.",
    "rfm_distribution": "Buyers reduced to distinct ids before the 1:1 join with segments.",
    "pareto_share": "Per-item counts (partial), histogram of counts, cumulative window over the "
                    "histogram only (at most sqrt(2 x events) rows).",
    "kpi_summary": "Funnel totals enter as one scalar subquery; the fact side is one aggregate.",
}


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session()
    q = queries()
    out = ["# Physical plans", "",
           f"Generated by `tools/plans.py` at `{os.path.basename(sf.rstrip('/'))}` on local mode "
           "(broadcast choices reflect the small test tables; the byte threshold and AQE decide "
           "them at scale). Tree, then each scan's pushed filters and read schema.", ""]
    for key in KEYS:
        text = plan_text(q[key](spark, sf))
        tree, _, details = text.partition("\n\n\n")
        scans = re.findall(r"\(\d+\) Scan parquet[^\n]*\n(?:[^\n]+\n)*?(?=\n)", details + "\n")
        out += [f"## {key}", "", NOTES.get(key, ""), "", "```", tree.strip(), "```", ""]
        for scan in scans:
            keep = [ln for ln in scan.splitlines()
                    if ln.startswith(("(", "PushedFilters", "ReadSchema", "PartitionFilters"))]
            out += ["```", *keep, "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
