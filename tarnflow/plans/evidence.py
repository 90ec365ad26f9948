"""How a query is run, read from its physical plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: What a plan can be, from the cheapest on; the last two say nothing for pushdown.
LABELS = ("footer-count", "footer-stats", "scan", "aggregation", "join", "mixed", "fallback", "unknown")


@dataclass
class Evidence:
    label: str
    pushed_filters: list[str] = field(default_factory=list)
    pushed_aggregation: list[str] = field(default_factory=list)
    read_columns: list[str] = field(default_factory=list)
    joins: list[str] = field(default_factory=list)
    exchanges: int = 0
    python: bool = False
    #: of a fallback: what is done instead; of that and of an unknown plan: why
    target: str | None = None
    reason: str | None = None

    @property
    def pushdown(self) -> bool:
        """May the plan be shown as evidence that work was pushed down?"""
        return self.label not in ("fallback", "unknown")


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def _listed(text: str, name: str) -> list[str]:
    out: list[str] = []
    for m in re.finditer(rf"{name}: \[([^\n]*?)\](?:,|\n|$)", text):
        out += [x.strip() for x in re.split(r", (?![^(]*\))", m[1]) if x.strip()]
    return out


def _why_no_footers(text: str) -> str:
    """Why an aggregate that might have been answered from footers wasn't."""
    if re.search(r"(PushedFilters|DataFilters|PartitionFilters): \[[^\]]", text) or re.search(r"^\(\d+\) Filter", text, re.MULTILINE):
        return "a filter on rows can't be answered from footers"
    found = re.search(r"Functions[^\n]*: \[[^\n]*?(?:min|max)\((\w+)#", text)
    return f"footers hold no exact minimum or maximum of {found[1]}" if found else "the aggregate can't be answered from footers"


def inspect(df: DataFrame, footers_wanted: bool = False) -> Evidence:
    """Label, pushed filters and aggregates, columns read, joins and exchanges of a query's plan.

    With ``footers_wanted`` an aggregate that scans rows is a fallback, with its target and reason.
    """
    text = plan_text(df)
    tree = text.split("\n\n\n")[0]
    pushed = [x for x in _listed(text, "PushedAggregation") if x]
    columns = [c.split(":")[0] for m in re.finditer(r"ReadSchema: struct<([^\n]*)>", text) for c in re.split(r",(?![^<]*>)", m[1]) if c]
    joins = re.findall(r"\b(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)\b", tree)
    aggregates = re.search(r"\b(Hash|ObjectHash|Sort)Aggregate\b", tree)
    scans = re.search(r"\b(Scan|BatchScan|FileScan)\b", tree)
    if pushed and not joins:
        label = "footer-count" if all(re.fullmatch(r"COUNT\(\*\)", p, re.IGNORECASE) for p in pushed) else "footer-stats"
    elif joins and aggregates:
        label = "mixed"
    elif joins:
        label = "join"
    elif aggregates:
        label = "aggregation"
    else:
        label = "scan" if scans else "unknown"
    target = reason = None
    if label == "unknown":
        reason = "the plan scans no files"
    elif footers_wanted and label == "aggregation":
        label, target, reason = "fallback", label, _why_no_footers(text)
    return Evidence(label, _listed(text, "PushedFilters"), pushed, columns, joins, len(re.findall(r"\bExchange\b", tree)), bool(re.search(r"Python|Pandas|Arrow", tree)), target, reason)


def statistics(df: DataFrame) -> tuple[int | None, int]:
    """The optimizer's row count (None if it has none) and bytes."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    rows = stats.rowCount()
    return (int(str(rows.get())) if rows.isDefined() else None), int(str(stats.sizeInBytes()))
