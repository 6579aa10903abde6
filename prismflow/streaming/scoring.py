"""Score arriving facts with a fitted model, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from prismflow.config import MahalanobisConfig, SpeConfig
from prismflow.operators.pca import PcaModel, transform_pca


def score_stream(facts: DataFrame, model: PcaModel, path: str, checkpoint: str, mahalanobis: MahalanobisConfig | None = None, spe: SpeConfig | None = None, once: bool = True) -> StreamingQuery:
    """Start scoring a stream of facts (source, feature_id, value); a source's facts arrive in one batch.

    Each batch goes to its own folder, which a repeated batch overwrites, so results are exactly once. A batch
    without a source that can be scored writes none, and the stream goes on.
    """

    def score(batch: DataFrame, number: int) -> None:
        transform_pca(model, batch, mahalanobis, spe, allow_empty=True).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = facts.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
