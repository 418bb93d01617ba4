"""The three jobs a user runs end to end: profile and extract, synthesize, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame

from netloom import config as cfg
from netloom.models import fitting, generating
from netloom.operators import divergence, filters, marginals, profile, sampling, windows
from netloom.operators.rule_report import rule_summary
from netloom.session import materialize, shared_path
from netloom.sources import sinks


def profile_and_extract(flows: DataFrame, day: str | None, path: str, users: int = 100, seed: int = 131) -> DataFrame:
    """Profile the hosts of a day, pick users of middling activity and write their flows.

    Returns the profile, which is computed once and kept in the shared folder.
    """
    chosen = filters.on_day(flows, day) if day else flows
    stats = materialize(profile.user_stats(chosen))
    picked = sampling.sample_n(profile.middle_half(stats), users, "ip", seed=seed)
    extracted = filters.extract_users(chosen, picked.select(picked.ip.alias("user")))
    sinks.write_user_flows(extracted, path)
    return stats


def synthesize(
    flows: DataFrame, users: DataFrame, days: int, epochs: int, plan: cfg.ColumnPlan | None = None,
    span: float = 86_400.0, batch_rows: int = fitting.BATCH_ROWS, seed: int = 0, key: str = "this_ip",
    path: str | None = None,
) -> tuple[DataFrame, fitting.Fitted, DataFrame]:
    """Fit the column models on real flows and generate flow records for every user and day.

    Returns the generated flows, the model and the training log.  ``path`` keeps the fit, so
    that a call after an interruption goes on with it.
    """
    plan = plan or cfg.flow_plan()
    training = windows.prepare_windows(flows, agg=plan.window, key=key, hour_max=24, clip=True)
    fitted, losses = fitting.fit_batches(training, plan, epochs, batch_rows, seed, path=path)
    return generating.generate_many_users(users, days, fitted, span, seed), fitted, losses


def evaluation_reports(flows: DataFrame, real: str, binning: str = "own") -> dict[str, DataFrame]:
    """Every evaluation table of datasets named in column ``dataset``, by report name."""
    reports = {
        "scale": marginals.scale_check(flows),
        "protocol": marginals.protocol_share(flows),
        "system_ports": marginals.system_port_top(flows),
        "user_ports": marginals.user_port_hist(flows),
        "rules": rule_summary(flows, "dataset"),
        "divergence": divergence.js_scorecard(flows, real, binning),
        "user_stats": profile.user_stats(flows, by="dataset"),
        "ip_occurrence": marginals.ip_occurrence_curve(flows, by="dataset"),
        "ip_volume": marginals.ip_volume_curve(flows, by="dataset"),
    }
    return reports


def evaluate(flows: DataFrame, real: str, path: str | None = None, run: str = "run") -> str:
    """Write all evaluation tables to one report store and return its path."""
    path = path or shared_path(flows.sparkSession, "reports")
    for name, report in evaluation_reports(flows, real).items():
        sinks.write_report(report, path, name, run)
    return path
