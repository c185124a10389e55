"""A stream of questions answered from index tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def start_answers(
    questions: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    path: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Apply `answer` to every batch of `query_id, question` rows and store its result.

    Ranking needs all of a question's scores, which a streaming plan cannot order, so each
    batch is ranked as a static table.  A repeated batch overwrites its own folder.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{path}/answers/batch={batch_id}")

    return (
        questions.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
