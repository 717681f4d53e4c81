"""What a plan's scans read when it ran."""

from __future__ import annotations


def _nodes(plan):
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
        yield from _nodes(plan)
        return
    if kind in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec", "TableCacheQueryStageExec"):
        yield from _nodes(plan.plan())
        return
    yield plan
    children = plan.children()
    for k in range(children.size()):
        yield from _nodes(children.apply(k))


def scans(df) -> list[tuple[str, int]]:
    """Run ``df``; the description and the rows read of each file scan of its plan."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    return [(n.toString(), int(n.metrics().apply("numOutputRows").value())) for n in _nodes(execution.executedPlan()) if "FileSourceScan" in n.getClass().getSimpleName()]


def rows_read(df) -> int:
    return sum(n for _, n in scans(df))
