"""User decisions (#24, #25, #34).

The reference asks in pop-ups; here the answers are a ``decisions``
DataFrame (see ``model.DECISIONS``) plus a default policy per anomaly kind,
so a run is repeatable and needs no person at the console. Decisions are
human-sized input; they join like any other small table (AQE broadcasts
them when they are small, shuffles them when they are not).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmerge.model import CANCEL_FILE, DEFAULT_POLICY, DROP, KIND_UNSELECTED, KINDS, SELECT

POLICY_FAIL = "fail"


def _priority(action: F.Column) -> F.Column:
    # several answers for one anomaly: cancelling wins, then the first action name
    return F.when(action == CANCEL_FILE, F.lit(0)).otherwise(F.lit(1))


def anomaly_decisions(decisions: DataFrame) -> DataFrame:
    """One answer per anomaly key. -> (file, sheet, kind, col_idx, action)

    A decision without ``col_idx`` answers all columns of that kind in its
    sheet that have no answer of their own; it keeps its null here.
    """
    return (
        decisions.where(F.col("action") != SELECT)
        .groupBy("file", "sheet", "kind", "col_idx")
        .agg(F.min_by("action", F.struct(_priority(F.col("action")), F.col("action"))).alias("action"))
    )


def resolve_actions(anomalies: DataFrame, decisions: DataFrame, policy: dict[str, str] | str | None = None) -> DataFrame:
    """Adds ``decided`` (the decision for the column, else for its kind in the
    sheet) and ``action`` (that, else the policy's default)."""
    answers = anomaly_decisions(decisions)
    by_column = answers.where(F.col("col_idx").isNotNull()).withColumnRenamed("action", "_own")
    by_kind = answers.where(F.col("col_idx").isNull()).select("file", "sheet", "kind", F.col("action").alias("_all"))
    joined = anomalies.join(by_column, ["file", "sheet", "kind", "col_idx"], "left").join(by_kind, ["file", "sheet", "kind"], "left")
    decided = F.coalesce("_own", "_all")
    return joined.withColumn("decided", decided).withColumn("action", F.coalesce("decided", policy_action(policy))).drop("_own", "_all")


def files_to_cancel(decided: DataFrame, actions: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Every file that isn't merged, with one reason. -> (file, reason)

    ``decided``: files a decision cancels (:func:`cancelled_files`);
    ``actions``: anomalies with their resolved action, of which a policy may
    cancel; ``failed``: files that couldn't be read. Each kind of reason
    comes before the next.
    """
    ranked = decided.select("file", F.lit(1).alias("_rank"), "reason").unionByName(
        actions.where(F.col("action") == CANCEL_FILE).select("file", F.lit(2).alias("_rank"), F.col("kind").alias("reason"))
    )
    if failed is not None:
        ranked = ranked.unionByName(failed.select("file", F.lit(0).alias("_rank"), "reason"))
    return ranked.groupBy("file").agg(F.min(F.struct("_rank", "reason")).alias("_first")).select("file", F.col("_first.reason").alias("reason"))


def cancelled_files(decisions: DataFrame, headers: DataFrame) -> DataFrame:
    """Files a decision cancelled, with the reason (the kind when none given).

    Only files that are among the sources. -> (file, reason)
    """
    return (
        decisions.where(F.col("action") == CANCEL_FILE)
        .join(headers.select("file").distinct(), "file", "left_semi")
        .groupBy("file")
        .agg(F.min(F.coalesce("reason", "kind")).alias("reason"))
    )


def policy_action(policy: dict[str, str] | str | None) -> F.Column:
    """Default action per kind as a column expression over ``kind``."""
    if policy == POLICY_FAIL:
        # columns a choice left out are dropped; names still to choose are checked as open slots
        return F.when(F.col("kind") == KIND_UNSELECTED, F.lit(DROP))
    chosen = dict(DEFAULT_POLICY)
    if isinstance(policy, dict):
        chosen.update(policy)
    expr = None
    for kind in KINDS:
        branch = F.lit(chosen[kind])
        expr = F.when(F.col("kind") == kind, branch) if expr is None else expr.when(F.col("kind") == kind, branch)
    return expr


def apply_decisions(
    anomalies: DataFrame,
    decisions: DataFrame,
    cancelled: DataFrame,
    policy: dict[str, str] | str | None = None,
) -> DataFrame:
    """Attach the answer and the resulting operation to every anomaly.

    ``anomalies`` needs (file, sheet, kind, col_idx). Adds ``action`` (the
    decision, else the policy default) and ``operation`` ('cancel_file' for
    every anomaly of a cancelled file, else the action).
    """
    cancelled_flag = cancelled.select("file", F.lit(True).alias("_cancelled"))
    joined = resolve_actions(anomalies, decisions, policy).join(cancelled_flag, "file", "left")
    operation = F.when(F.col("_cancelled").isNotNull(), F.lit(CANCEL_FILE)).otherwise(F.col("action"))
    return joined.withColumn("operation", operation).drop("_cancelled", "decided")


def unresolved(with_actions: DataFrame) -> DataFrame:
    """Anomalies with neither a decision nor a default (policy='fail')."""
    return with_actions.where(F.col("operation").isNull())


def cancel_files(rows: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Drop every row of a cancelled file (anti-join on the cancel list,
    broadcast after a size check)."""
    from sheetmerge.plans.sizing import broadcast_if_small

    return rows.join(broadcast_if_small(cancelled.select("file")), "file", "left_anti")
