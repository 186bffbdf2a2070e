"""Packing by power-of-two decomposition.

A document of n ids (its end id included) is cut into full sequences of ``most`` ids and then
into pieces whose lengths are the powers of two in the remainder, longest first. Each piece is
a sequence of its own, and sequences of one length form a bucket (the high bits of
sequence_id), so batches are made of equal lengths: no sequence crosses documents and none is padded.

One narrow pass over the documents: no shuffle at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewheel.llm.common import text_slices
from tidewheel.llm.tokens import BATCH, encoder

MOST = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cuts(n: int, most: int = MOST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; most is a power of two."""
    found = [(at, most) for at in range(0, n - n % most, most)]
    at = n - n % most
    for power in range(most.bit_length() - 2, -1, -1):
        if n >> power & 1:
            found.append((at, 1 << power))
            at += 1 << power
    return found


def sequence_id(length: int, part: int, ordinal: int) -> int:
    """Bucket (power of the length) in bits 58 to 61, then the partition, then the place in it."""
    return (length.bit_length() - 1) << 58 | part << 32 | ordinal


def _pack(path: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, ordinals = encoder(path).encode_all, TaskContext.get().partitionId(), {}
        end = end_id.to_bytes(4, "little")
        for batch in text_slices(batches, *BATCH):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                for start, length in cuts(n, most):
                    k = ordinals[length] = ordinals.get(length, -1) + 1
                    rows.append((doc, start, length, ids[4 * start : 4 * (start + length)], n, sequence_id(length, part, k), 0))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, most: int = MOST) -> DataFrame:
    """One row per piece: doc_id, start (ids of the document before it), length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id and offset (always 0: a piece is a whole sequence).

    A null or empty text has only the end id. Each row of docs is a document of its own, also
    where doc_id repeats or is null. Texts of any length are encoded whole. The path of the
    tokenizer file must exist on the executors. sequence_id depends on how the input is split
    into partitions; everything else depends on the row alone.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pack(tokenizer or default_tokenizer(), end_id, most), SCHEMA)


def write_buckets(packed: DataFrame, path: str) -> DataFrame:
    """Writes the rows of pack() to a folder for each length, and returns them read again.

    Whoever reads one length's folder has sequences of one shape. Each task writes its rows
    where they belong: no shuffle, and no task has all of a common length. An empty table has no folders.
    """
    packed.write.partitionBy("length").parquet(path)
    return packed.sparkSession.read.schema(packed.schema).parquet(path)
