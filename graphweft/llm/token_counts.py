"""Token counts without ids.

Plan: no shuffle. Each task cuts its texts to pre-tokens as the library does, white space of any kind
and length included, counts the pieces of each distinct pre-token once, joins these counts to the
pre-token frequencies of each document and sums. The join is local to the task: sent through a shuffle,
the (document, pre-token) rows would be larger than the texts themselves, while a pre-token costs a few
microseconds to count again in another task (and after a cache of 300,000 has been full).

Defined results: a null or empty text has 0 bytes and 0 tokens; a very long text is counted whole;
every row gives one row, repeated ones too; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, lean
from .tokenizing import ByteCounter, coder


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, for a byte-level BPE file with the default split."""
    kind = docs.schema[id_col].dataType.simpleString()

    @lean
    def count(batches):
        with coder(ByteCounter, path) as counter:
            for whole in batches:
                for batch in byte_slices(whole, "text"):
                    counts = pa.array(counter.count(batch.column("text")))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text")
    )
    out = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
