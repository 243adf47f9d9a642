"""Token counts with a whole-token shortcut.

Most pre-tokens of ordinary text are single entries of the vocabulary. Once per
worker the operator proves which vocabulary strings encode alone as one token;
such pre-tokens count 1 at once. Only the others are merged.

Defined results: a null or empty text has 0 bytes and 0 tokens; null ids pass
through; repeated rows give repeated results; an empty table gives an empty
result; other columns of the input are not read, so their names can't clash.
Special strings inside a text count as the library counts them by default: one
token each. Nothing is shuffled or sampled; a task holds one slice of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.bpe import PieceCounts, PieceEncoder, counting
from folioforge.llm.columns import giving_back, text_slices


def count_tokens(encoder: PieceEncoder, counts: PieceCounts, text: str) -> int:
    """Tokens of one text."""
    if encoder.unsettled(text):
        return len(encoder.library_ids(text))
    total = 0
    for pieces, mark in encoder.segments(text):
        total += sum(map(counts.__getitem__, pieces)) + (mark is not None)
    return total


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    ``tokenizer_path`` is read on the driver; the file (of fixed size) goes to the
    executors as a broadcast variable.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts = counting(spec.value)
        for batch in batches:
            tokens, sizes = [], []
            for _, _, texts in text_slices(batch, "text"):
                for t in texts.to_pylist():
                    tokens.append(count_tokens(encoder, counts, t))
                    sizes.append(len(t) if t.isascii() else len(t.encode()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(giving_back(run), f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
