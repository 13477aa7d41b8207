"""The wording and the preset scores of every finding."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FindingText:
    title: str
    observation: str
    interpretation: str
    confidence: float
    relevance: float
    module: str
    query_id: str
    caveats: tuple[str, ...] = ()


# Texts and scores, in report order.
FINDING_TEXTS = {
    "headline": FindingText(
        title="Headline metric: {metric}",
        observation="Current aggregate value for {metric} is {value}",
        interpretation="High-level baseline metric for executive context.",
        confidence=0.8,
        relevance=0.85,
        module="overview",
        query_id="overview_metric_{metric}",
    ),
    "date_coverage": FindingText(
        title="Dataset date coverage",
        observation="Data spans from {min_date} to {max_date}",
        interpretation="Useful for framing trend and seasonality confidence.",
        confidence=0.9,
        relevance=0.7,
        module="overview",
        query_id="overview_date_coverage",
    ),
    "top_concentration": FindingText(
        title="Top segment concentration on {metric}",
        observation="Top {dimension} segment contributes {share} of top-10 visible {metric}.",
        interpretation="Higher concentration can indicate exposure risk.",
        confidence=0.75,
        relevance=0.78,
        module="overview",
        query_id="overview_top_segments_{metric}_{column}",
        caveats=("Contribution uses top-10 segment preview.",),
    ),
    "increase": FindingText(
        title="Strongest increase in {metric}",
        observation="Largest period gain is {delta} on {period}",
        interpretation="Largest positive period-over-period movement.",
        confidence=0.78,
        relevance=0.82,
        module="trends",
        query_id="trends_{metric}_{grain}",
    ),
    "decrease": FindingText(
        title="Strongest decrease in {metric}",
        observation="Largest period decline is {delta} on {period}",
        interpretation="Largest negative period-over-period movement.",
        confidence=0.78,
        relevance=0.82,
        module="trends",
        query_id="trends_{metric}_{grain}",
    ),
    "volatility": FindingText(
        title="{metric} volatility",
        observation="Volatility ratio is {ratio} at {grain} grain",
        interpretation="Higher ratios indicate unstable trend behavior.",
        confidence=0.74,
        relevance=0.7,
        module="trends",
        query_id="trends_{metric}_{grain}",
        caveats=("Computed from visible time series only.",),
    ),
    "spikes": FindingText(
        title="Spike/drop flags for {metric}",
        observation="Detected {count} anomaly candidate periods.",
        interpretation="Potential change-points requiring diagnostic follow-up.",
        confidence=0.69,
        relevance=0.76,
        module="trends",
        query_id="trends_{metric}_{grain}",
        caveats=("Anomaly flag is statistical, not causal.",),
    ),
    "leader": FindingText(
        title="Top segment for {metric}",
        observation="{winner} leads {metric} with value {value}",
        interpretation="Largest contributor segment in current ranking.",
        confidence=0.82,
        relevance=0.85,
        module="segments",
        query_id="segments_{metric}_{column}",
        caveats=("Based on current grouped aggregation.",),
    ),
    "long_tail": FindingText(
        title="Long-tail share for {dimension}",
        observation="Long-tail share outside top 10 is {share}",
        interpretation="Higher share implies less concentration among leaders.",
        confidence=0.76,
        relevance=0.74,
        module="segments",
        query_id="segments_{metric}_{column}",
    ),
    "concentration": FindingText(
        title="Concentration index for {dimension}",
        observation="HHI-style concentration index is {index}",
        interpretation="Higher index means fewer segments dominate results.",
        confidence=0.7,
        relevance=0.72,
        module="segments",
        query_id="segments_{metric}_{column}",
    ),
    "spread": FindingText(
        title="Winner/loser spread on {dimension}",
        observation="Top segment {winner} exceeds tail segment {loser} by {spread}.",
        interpretation="Simple spread view for segment disparity.",
        confidence=0.72,
        relevance=0.79,
        module="segments",
        query_id="segments_{metric}_{column}",
        caveats=("Loser comparison uses last row in returned segment ordering.",),
    ),
    "anomalies": FindingText(
        title="Anomaly candidates detected for {metric}",
        observation="Detected {count} statistical anomaly candidate periods.",
        interpretation="{pattern}",
        confidence=0.68,
        relevance=0.81,
        module="anomalies",
        query_id="anomalies_{metric}_{grain}",
        caveats=("Statistical anomaly does not imply root cause.",),
    ),
    "no_anomalies": FindingText(
        title="No strong anomaly signals for {metric}",
        observation="No periods exceeded configured z-score/MAD thresholds.",
        interpretation="Series looks relatively stable at selected grain.",
        confidence=0.72,
        relevance=0.55,
        module="anomalies",
        query_id="anomalies_{metric}_{grain}",
        caveats=("Threshold-based detection can miss subtle anomalies.",),
    ),
    "missing": FindingText(
        title="Data missingness risk",
        observation="Highest null-rate columns: {list}",
        interpretation="High null rates can lower confidence in downstream insights.",
        confidence=0.85,
        relevance=0.8,
        module="diagnostics",
        query_id="diagnostics_missingness",
    ),
    "near_unique": FindingText(
        title="Sparse/high-cardinality dimensions",
        observation="{list} show near-unique category behavior.",
        interpretation="High-cardinality dimensions can create unstable segmentation outputs.",
        confidence=0.72,
        relevance=0.7,
        module="diagnostics",
        query_id="diagnostics_sparse_dims",
    ),
    "instability": FindingText(
        title="Category explosion risk",
        observation="{list} shows unstable category growth over time.",
        interpretation="Can indicate taxonomy drift or noisy identifiers leaking as dimensions.",
        confidence=0.68,
        relevance=0.73,
        module="diagnostics",
        query_id="diagnostics_category_explosion",
        caveats=("Explosion ratio is month-to-month heuristic.",),
    ),
    "duplicates": FindingText(
        title="Suspicious duplicates on key candidate",
        observation="Found {count} duplicate rows for key candidate {key}.",
        interpretation="Potential primary-key quality issue.",
        confidence=0.86,
        relevance=0.84,
        module="diagnostics",
        query_id="diagnostics_duplicates",
    ),
    "no_alerts": FindingText(
        title="No critical diagnostics alerts",
        observation="No severe data-quality red flags triggered default heuristics.",
        interpretation="Dataset passes baseline diagnostic checks.",
        confidence=0.7,
        relevance=0.55,
        module="diagnostics",
        query_id="diagnostics_summary",
        caveats=("Heuristic diagnostics do not replace full data QA.",),
    ),
}

ANOMALY_PATTERNS = {
    "persistent": "Pattern appears persistent across multiple periods.",
    "one-off": "Pattern appears one-off and should be verified.",
}
NULL_METRIC_CAVEAT = "Metric returned null"
DATE_COVERAGE_IMPACT = 0.45
QUIET_IMPACT = 0.2
LISTED_DIMENSIONS = 3
