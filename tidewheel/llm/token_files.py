"""Token ids in binary files with Elias-Fano document boundaries.

Documents are range-partitioned and sorted by doc_id; each range writes one shard:

``NNNNNN.ids``  all ids of the shard's documents, end ids included, one after the other, as
                little-endian uint16 if the vocabulary fits, else uint32; no separators.
``NNNNNN.idx``  three Elias-Fano parts: document i's first id, counted from the shard's start
                (n + 1 values), and the sorted doc_ids of the documents that have one; before
                them the number of documents without a doc_id, which come first (uint64).

``manifest``    Parquet, a row a shard: shard, docs, ids, width.

A shard is written under a name of its task attempt and then renamed, so a task that runs
again leaves one whole shard. Files go through pyarrow's file systems: any URI it opens that
all executors reach.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import fresh_path, text_slices
from tidewheel.llm.elias_fano import EliasFano, encode
from tidewheel.llm.tokens import BATCH, encoder

END_ID = 0
#: Units whose ids a worker keeps: this tokenizer has words with and without a space, so it needs more.
CACHE = 1_000_000
#: Ids and documents of a batch of rows that the reader hands on.
_READ_IDS, _READ_DOCS = 1 << 20, 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write_shard(path: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard = encoder(tokenizer, CACHE), TaskContext.get().partitionId()
        width = 2 if max(words.vocabulary - 1, end_id) < 1 << 16 else 4
        files, root = _filesystem(path)
        end, name = end_id.to_bytes(4, "little"), f"{root}/{shard:06d}"
        temporary = f"{root}/_writing-{shard:06d}-{uuid.uuid4().hex}"
        lengths, docs, out = [0], [], None
        for batch in text_slices(batches, *BATCH):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.encode_all(batch.column("text").to_pylist()), strict=True):
                ids += end
                if out is None:
                    out = files.open_output_stream(f"{temporary}.ids")
                out.write(np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids)
                lengths.append(len(ids) // 4)
                docs.append(doc)
        if out is None:
            return
        out.close()
        known = np.array([d for d in docs if d is not None], dtype=np.int64)
        with files.open_output_stream(f"{temporary}.idx") as index:
            index.write(struct.pack("<Q", len(docs) - len(known)) + encode(np.cumsum(np.array(lengths, dtype=np.int64))) + encode(known))
        for kind in ("ids", "idx"):
            files.move(f"{temporary}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, len(docs), sum(lengths), width)], names=["shard", "docs", "ids", "width"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> str:
    """Writes the ids of all documents (doc_id, text) in ascending order of doc_id to path, and returns it.

    A null or empty text has only the end id. Rows without a doc_id come first; repeated ids
    are documents of their own, in the order of their texts. An empty table writes an empty manifest.
    """
    files, root = _filesystem(path)
    files.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_write_shard(path, tokenizer or default_tokenizer(), end_id), "shard long, docs long, ids long, width long").write.parquet(f"{path}/manifest")
    return path


class Shard:
    """One shard's documents by number: bounds from select, ids from a ranged read."""

    def __init__(self, path: str, shard: int, width: int):
        self.files, root = _filesystem(path)
        self.name, self.kind = f"{root}/{shard:06d}", "<u2" if width == 2 else "<u4"
        with self.files.open_input_file(f"{self.name}.idx") as f:
            data = f.read()
        self.without = struct.unpack_from("<Q", data)[0]
        self.starts = EliasFano(data[8:])
        self.known = EliasFano(data[8 + self.starts.nbytes :])

    def __len__(self) -> int:
        return len(self.starts) - 1

    def doc_id(self, i: int) -> int | None:
        return None if i < self.without else self.known.select(i - self.without)

    def doc_ids(self, begin: int, end: int) -> list[int | None]:
        known = max(begin, self.without)
        return [None] * (min(end, self.without) - begin) + self.known.select_range(known - self.without, max(known, end) - self.without).tolist()

    def ids(self, i: int) -> np.ndarray:
        begin, end = self.starts.select(i), self.starts.select(i + 1)
        size = np.dtype(self.kind).itemsize
        with self.files.open_input_file(f"{self.name}.ids") as f:
            f.seek(begin * size)
            return np.frombuffer(f.read((end - begin) * size), self.kind).astype("<u4")


def _read_shards(path: str, most_docs: int = _READ_DOCS, most_ids: int = _READ_IDS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base, width in zip(*(batch.column(c).to_pylist() for c in ("shard", "base", "width")), strict=True):
                one = Shard(path, shard, width)
                with one.files.open_input_stream(f"{one.name}.ids") as f:
                    at = 0
                    while at < len(one):  # bounds of a batch of documents at a time, by select
                        starts = one.starts.select_range(at, min(at + most_docs, len(one)) + 1)
                        n = max(1, int(np.searchsorted(starts, starts[0] + most_ids, "right")) - 1)
                        starts = starts[: n + 1]
                        ids = np.frombuffer(f.read(int(starts[-1] - starts[0]) * width), one.kind).astype("<u4").tobytes()
                        cut = (starts - starts[0]) * 4
                        blobs = [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                        columns = [pa.array(one.doc_ids(at, at + n), pa.int64()), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(blobs, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])
                        at += n

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files at path, read back shard by shard.

    start counts the ids of all documents before it; ids are little-endian unsigned 32-bit.
    """
    manifest = spark.read.schema("shard long, docs long, ids long, width long").parquet(f"{path}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    based = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return based.select("shard", "base", "width").repartitionByRange(parts, "shard").mapInArrow(_read_shards(path), "doc_id long, start long, n_tokens long, ids binary")


def new_path(spark: SparkSession) -> str:
    return fresh_path(spark, "tokens")
