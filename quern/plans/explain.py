"""What Spark will do with a query."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame

MODES = ("simple", "extended", "codegen", "cost", "formatted")


def explain(df: DataFrame, mode: str = "formatted") -> str:
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()


def summary(df: DataFrame) -> dict[str, int | bool]:
    """Counts of what costs most: exchanges, sorts, joins by kind, Python stages, and whether filters reach the scan."""
    text = explain(df)
    count = lambda p: len(re.findall(p, text.split("\n\n")[0]))
    return {"exchanges": count(r"\bExchange\b"), "broadcasts": count("BroadcastExchange"), "sorts": count(r"\bSort\b"), "merge_joins": count("SortMergeJoin"), "hash_joins": count("HashJoin"), "nested_loops": count("NestedLoopJoin|CartesianProduct"), "python": count("Python|Pandas|Arrow"), "pushed": bool(re.search(r"PushedFilters: \[[^\]]", text))}


def warnings(df: DataFrame) -> list[str]:
    """Plans that won't grow well."""
    s, text = summary(df), explain(df)
    out = []
    if s["nested_loops"]:
        out.append("a join without an equality compares all pairs")
    if "SinglePartition" in text:
        out.append("one task gets all rows")
    if s["python"]:
        out.append("rows pass through Python")
    return out
