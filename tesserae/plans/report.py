"""Physical-plan summary per registered query (after AQE re-planning):
shuffles, join strategies, aggregate kinds, Python stages, top-k.

``python -m tesserae.plans.report /root/testdata/sf0.1 > PLANS.md``
"""

from __future__ import annotations

import re
import sys
from contextlib import contextmanager

from pyspark.sql import DataFrameWriter


def final_plan(df) -> str:
    """Run the frame through its own QueryExecution so AQE finalizes the
    very plan that is printed."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    return qe.executedPlan().toString()


def summarize(plan: str) -> dict:
    plan = plan.split("== Initial Plan ==")[0]
    count = lambda pat: len(re.findall(pat, plan))
    joins = sorted({m for m in re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)", plan)})
    kinds = sorted({m for m in re.findall(r"(HashAggregate|SortAggregate|ObjectHashAggregate)", plan)})
    return {
        "shuffles": count(r"\bExchange hashpartitioning|\bExchange rangepartitioning|\bExchange RoundRobinPartitioning|\bExchange SinglePartition"),
        "broadcasts": count(r"BroadcastExchange"),
        "joins": ",".join(joins) or "-",
        "aggregates": ",".join(kinds) or "-",
        "python": "yes" if re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas", plan) else "no",
        "topk": "yes" if "TakeOrderedAndProject" in plan else "no",
        "skew_split": "yes" if "skew=true" in plan else "no",
    }


@contextmanager
def writes(seen: list):
    """Within it, every file write first adds the summary of its frame's plan to ``seen``."""
    kept = {name: getattr(DataFrameWriter, name) for name in ("parquet", "csv", "saveAsTable")}

    def watched(name):
        def write(self, *args, **kwargs):
            seen.append(summarize(final_plan(self._df)))
            return kept[name](self, *args, **kwargs)
        return write

    for name in kept:
        setattr(DataFrameWriter, name, watched(name))
    try:
        yield seen
    finally:
        for name, old in kept.items():
            setattr(DataFrameWriter, name, old)


NOTES = """
Reading the table: every `groupBy`/`distinct` is one shuffle with a partial
aggregate below it; `orderBy` without a limit adds a range shuffle; joins
with a small side are broadcast by AQE's measured size (explicit
`broadcast()` only on one-row picks and one row per range). Queries that write files first
show each written frame in a row of its own before the final read. `SortAggregate` marks `max_by`/`min_by` over structs
(last-write-wins), which still aggregates partially before its shuffle.
`python` = yes only for the pandas generator variants kept for the
partition-function API. At these sizes every input file is one Parquet row group,
so scans run as one task each; at scale the same plans split scans by row
group and file. No query has skewed keys at this scale, so no skew split
shows here; `tests/test_plans.py::test_hub_node_join_is_split_by_aqe` shows
AQE splitting a node that holds a third of all edges.
"""


def main() -> None:
    from ..session import build_session
    from .queries import QUERIES
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    print("# Physical plans per query\n")
    print(f"Generated by `python -m tesserae.plans.report {sf}` from the executed (AQE) plans.\n")
    print("| query | shuffles | broadcasts | joins | aggregates | python | top-k | skew split |")
    print("|---|---|---|---|---|---|---|---|")
    for name, fn in QUERIES.items():
        try:
            with writes([]) as written:
                df = fn(spark, sf)
            jobs = [(f"{name}, write {k}", w) for k, w in enumerate(written, 1)] + [(name, summarize(final_plan(df)))]
        except Exception as e:  # noqa: BLE001
            print(f"| {name} | error: {type(e).__name__} | | | | | | |")
            continue
        for job, s in jobs:
            print(f"| {job} | {s['shuffles']} | {s['broadcasts']} | {s['joins']} | {s['aggregates']} | {s['python']} | {s['topk']} | {s['skew_split']} |")


if __name__ == "__main__":
    main()
    print(NOTES)
