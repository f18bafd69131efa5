"""Score feature rows as they arrive against frozen baselines, and decide on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.decisions import decide, decision_events
from ..plans.risk_model import RiskModel


def score_stream(features: DataFrame, model: RiskModel) -> DataFrame:
    """Stateless: the model tables are static, so the batch expressions apply unchanged."""
    return model.transform(features)


def decide_stream(scored: DataFrame, entitlements: DataFrame, model: RiskModel, folder: str) -> DataStreamWriter:
    """Decisions, audit events and rejects (sessions without a score) per micro-batch. A batch
    that is retried overwrites its own output, so each lands exactly once. The scored batch is
    written first, so that its sessions are scored once and not for each of the outputs."""

    def write(batch: DataFrame, number: int) -> None:
        path = f"{folder}/scored/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        batch = batch.sparkSession.read.schema(batch.schema).parquet(path)
        decisions = decide(batch.where("risk_score IS NOT NULL"), model.cfg)
        batch.where("risk_score IS NULL").drop("top_features").write.mode("overwrite").parquet(f"{folder}/rejects/batch={number}")
        decisions.drop("top_features").write.mode("overwrite").parquet(f"{folder}/decisions/batch={number}")
        decision_events(decisions, entitlements, model.cfg).write.mode("overwrite").parquet(f"{folder}/events/batch={number}")

    return scored.writeStream.foreachBatch(write)
