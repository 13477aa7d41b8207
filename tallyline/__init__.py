"""Spark-native business analytics: profile a table, derive metrics, report findings."""

from tallyline.models import AnalysisTask, Dimension, Metric, SemanticModel
from tallyline.plans.report import AnalysisReport, run_analysis
from tallyline.plans.workspace import Workspace
from tallyline.session import build_session

__all__ = [
    "AnalysisReport",
    "AnalysisTask",
    "Dimension",
    "Metric",
    "SemanticModel",
    "Workspace",
    "build_session",
    "run_analysis",
]
