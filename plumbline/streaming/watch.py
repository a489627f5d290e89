"""Checks of one document at a time over a stream of documents.

Table sums, like all checks whose result depends on a single document, need no
state: each batch of a stream of (path, text) is parsed and checked as it comes.
Checks across documents run over the whole corpus, in plans.scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.operators.markdown import parsed
from plumbline.operators.numbers import table_sums


def start(files: DataFrame, sink, checkpoint: str, labels: list[str] | None = None):
    """The running query: sink(rows, batch id) gets the findings of each batch. A batch
    that runs again after a failure has the same id and the same rows."""

    def check(batch: DataFrame, batch_id: int) -> None:
        rows = table_sums(parsed(batch), labels)
        sink(rows.select("path", "table_line", "line", "col_idx", "column", "parts_sum", "declared", "direction", "severity"), batch_id)

    return files.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).start()
