"""Token counts: batch encoding inside Arrow functions that return lengths only.

A task reads its Arrow batches, which are bounded by bytes and rows, and groups their texts anew into batches of
about `batch_bytes` of text. A text longer than that is cut at safe boundaries (see `encoding.safe_cuts`), its parts
go through as texts of their own, and their counts are added. No text is shortened.

Nulls and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .encoding import balanced, worker_encoder

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048, batch_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, UTF-8 bytes, tokens, and whether there are more tokens than `limit`."""
    small_batches(docs.sparkSession)

    def run(batches):
        encoder = worker_encoder(vocabulary, ids=False)
        for batch in batches:
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            counts = np.zeros(len(texts), dtype=np.int64)
            for group in balanced(texts, batch_bytes):
                np.add.at(counts, [i for i, _ in group], encoder.count_ids([part for _, part in group]))
            sizes = np.array([len(x) for x in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
