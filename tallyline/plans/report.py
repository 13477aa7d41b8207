"""The analysis report: profile, plan, analyse, score, rank, summarise."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tallyline.functions.small import small_table
from tallyline.models import AnalysisTask, SemanticModel
from tallyline.operators.findings import rank_findings, summary_or_default, write_out
from tallyline.operators.profile import role_profile
from tallyline.operators.semantic import build_semantic_model, validate_model
from tallyline.plans import modules
from tallyline.plans.tasks import check_tasks, plan_tasks

REASON = "Plan built from analysis mode and validated against semantic model constraints."
TOP_FINDINGS = 3


@dataclass(frozen=True)
class AnalysisReport:
    """A planned report.

    The tables are lazy: ``findings`` has the scores of the modules, ``ranked`` the final ones. ``raw_outputs`` has,
    for every ``module:priority``, functions that make the tables behind the findings.
    """

    dataset_name: str
    question: str
    mode: str
    model: SemanticModel
    tasks: list[AnalysisTask]
    findings: DataFrame
    raw_outputs: dict[str, modules.RawOutputs] = field(default_factory=dict)
    reason: str = REASON

    @property
    def plan(self) -> DataFrame:
        """The tasks in running order."""
        rows = [(task.module, task.metric, task.dimension, task.grain, task.priority) for task in self.tasks]
        schema = "module string, metric string, dimension string, grain string, priority int"
        return small_table(self.findings.sparkSession, rows, schema)

    @property
    def ranked(self) -> DataFrame:
        # A report has a handful of findings for each metric and dimension.
        return rank_findings(self.findings, max_group_rows=None)

    @property
    def top_findings(self) -> DataFrame:
        return self.ranked.filter(f"rank <= {TOP_FINDINGS}")

    @property
    def summary(self) -> DataFrame:
        return summary_or_default(self.findings, self.dataset_name)


def run_tasks(
    df: DataFrame,
    model: SemanticModel,
    tasks: list[AnalysisTask],
    profile: list[Row] | None = None,
    approx: bool = False,
) -> tuple[DataFrame, dict[str, modules.RawOutputs]]:
    """The findings of all tasks, and the raw outputs by ``module:priority``.

    All trend and anomaly tasks share daily states of all metrics, from which their grains are rolled up; those of one
    grain are analysed together. So are all segment tasks of one metric, because their dimensions go through one scan.
    """
    numbered = list(enumerate(tasks, 1))
    states = None
    facts: list[DataFrame] = []
    raw: dict[str, modules.RawOutputs] = {}
    for task_no, task in numbered:
        name = f"{task.module}:{task.priority}"
        if name in raw:
            continue
        if task.module in ("trends", "anomalies"):
            if not task.metric:
                raise ValueError(f"{task.module} task requires a metric")
            make = modules.trends_module if task.module == "trends" else modules.anomalies_module
            together = [item for item in numbered if (item[1].module, item[1].grain) == (task.module, task.grain)]
            states = states or modules.task_states(df, model, tasks)
            found, tables = make(states, model, together)
            for _, member in together:
                raw[f"{member.module}:{member.priority}"] = {
                    output: partial(_of_metric, table, member.metric) for output, table in tables.items()
                }
        elif task.module == "segments":
            if not task.metric or not task.dimension:
                raise ValueError("segments task requires a metric and a dimension")
            raw[name] = modules.segment_tables(df, model, task)
            continue
        elif task.module == "overview":
            found, raw[name] = modules.overview_module(df, model, task_no)
        elif task.module == "diagnostics":
            found, raw[name] = modules.diagnostics_module(df, model, task_no, profile, approx)
        else:
            raise ValueError(f"Unsupported module: {task.module}")
        facts.append(found)
    facts += _segment_facts(df, model, numbered)
    return write_out(reduce(DataFrame.unionByName, facts), model.dataset_name, model.table_name), raw


def _segment_facts(df: DataFrame, model: SemanticModel, numbered: list[tuple[int, AnalysisTask]]) -> list[DataFrame]:
    """The facts of all segment tasks, one scan a metric, and of the overview's top segment in that of the first metric."""
    by_metric: dict[str, list[tuple[int, AnalysisTask]]] = {}
    shares = [task_no for task_no, task in numbered if task.module == "overview" and model.metrics and model.dimensions]
    if shares:
        by_metric[model.metrics[0].name] = []
    for task_no, task in numbered:
        if task.module == "segments":
            by_metric.setdefault(task.metric, []).append((task_no, task))
    first = model.metrics[0].name if model.metrics else None
    return [
        modules.segments_module(df, model, tasks, shares[0] if shares and name == first else None)[0]
        for name, tasks in by_metric.items()
    ]


def _of_metric(table: Callable[[], DataFrame], metric: str) -> DataFrame:
    return table().filter(F.col("metric") == metric)


def run_analysis(
    dataset_name: str,
    df: DataFrame,
    question: str = "",
    mode: str = "executive_summary",
    model: SemanticModel | None = None,
    table_name: str | None = None,
    approx: bool = False,
) -> AnalysisReport:
    """Plan a report over one table.

    The roles of the columns are settled at once, since they decide the metrics and dimensions. All else is lazy. ``approx`` lets the diagnostics count the distinct values of dimensions by a sketch. Write the
    findings with ``sources.store.write_evidence`` to use them more than once.
    """
    profile = role_profile(df)
    rows = sorted(profile.collect(), key=lambda row: row["ordinal"])
    if model is None:
        collected = small_table(df.sparkSession, rows, profile.schema)
        model = build_semantic_model(dataset_name, table_name or dataset_name, collected)
    else:
        validate_model(df, model)
    tasks = plan_tasks(mode, model)
    check_tasks(tasks, model)
    findings, raw = run_tasks(df, model, tasks, rows, approx)
    return AnalysisReport(dataset_name, question, mode, model, tasks, findings, raw)
