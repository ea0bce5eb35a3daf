"""Token counts of whole texts, over a table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casesignal.llm.bpe_count import load_counter
from casesignal.llm.common import arrow_map, texts_of

#: Texts are counted in slices of so many bytes, to bound a task's memory.
SLICE = 8 << 20


def count_tokens(docs: DataFrame, model: bytes, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit of every row, in no shuffle.

    A null text counts as empty: no bytes, no tokens. Each row gives a row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def count(batch: pa.RecordBatch) -> dict[str, object]:
        counter = load_counter(sent.value)
        texts = texts_of(batch.column(1))
        tokens, part, size = [], [], 0
        for t in texts:
            part.append(t.decode("utf-8", "replace"))
            size += len(t)
            if size >= SLICE:
                tokens += counter.count_texts(part)
                part, size = [], 0
        tokens += counter.count_texts(part)
        return {
            "id": batch.column(0),
            "n_bytes": [len(t) for t in texts],
            "n_tokens": tokens,
            "over_limit": [n > limit for n in tokens],
        }

    kind = docs.schema[id_col].dataType.simpleString()
    out = arrow_map(
        docs.select(F.col(id_col), F.col(text_col)), count, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
    return out.withColumnRenamed("id", id_col)
