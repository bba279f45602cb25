"""Token counts with a whole-token shortcut: pre-tokens that the vocabulary holds whole count at once, only the rest is merged."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import resting, schema, text_chunks
from .pretokens import ByteLevel, encoder


def _counted(path: str):
    @resting
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encoder(ByteLevel, path)
        for part, texts in text_chunks(batches):
            n = counter.counts([x.decode("utf-8", "replace") for x in texts])
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"].cast(pa.int64()), "n_bytes": pa.array(map(len, texts), pa.int64()), "n_tokens": pa.array(n, pa.int64())})

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens for each row of docs (doc_id, text), as the tokenizer file at path gives them.

    No shuffle: one pass, rows keep their number and order. A null or empty text counts 0 and 0; a null doc_id stays null; repeated rows
    are counted each; other columns are ignored. A special token's string inside a text is that one token, as the library has it.
    Every worker remembers a bounded number of pre-tokens.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_counted(path), schema("doc_id long, n_bytes long, n_tokens long"))
