"""Line dedup: range-partitioned line hashes, secondary sort, per-document keep bitmaps.

One pass hashes each document's lines. The hashes are range-partitioned and sorted by
(hash, document descending, text), so each run of one hash starts with the largest document
that holds the line, and a very common line spreads over many ranges, as the document is part
of the range key. A pass over each range streams the runs and holds the rows of at most
``min_docs`` documents at a time. Only the first and the last run of a range can go on in
another range; for these, each range reports one line of totals, and their fate is settled with
the totals. Documents get zlib-compressed bitmaps of the lines they keep; no text is shuffled
to find them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import as_bytes, quoted, same, signed, slices, small_table, stored, unused

_ROWS = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("lines", T.ArrayType(T.IntegerType()))])
#: kind 0: these lines go; 1: they go if the totals say so; 2: totals of a first or last run (doc_id: its largest, n_lines: its documents).
_FOUND = T.StructType([*_ROWS.fields, T.StructField("kind", T.IntegerType()), T.StructField("range", T.IntegerType()), T.StructField("least", T.LongType()), T.StructField("null_least", T.BooleanType())])


def line_key(line: bytes) -> bytes:
    """The line without \\x20 and \\x09-\\x0D at both ends, A-Z in lower case."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= chars)


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if not text:
                    continue
                at: dict[bytes, list[int]] = {}
                lines = text.split(b"\n")
                for i, line in enumerate(lines):
                    key = line_key(line)
                    if _long_enough(key, min_chars):
                        at.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
                if at:
                    whole = signed(xxhash.xxh64_intdigest(text, 42))
                    out += [(signed(int.from_bytes(h[:8], "big")), signed(int.from_bytes(h[8:], "big")), doc, whole, len(lines), places) for h, places in at.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=_ROWS.names)

    return run


def _stream_runs(min_docs: int):
    """Streams sorted rows; a run's rows wait only until it has min_docs documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        key, first, largest, last, docs, waiting = None, True, None, None, 0, []

        def close(ends: bool) -> None:
            """Ends a run; a first or last one is left open, with its totals."""
            nonlocal waiting
            if key is not None and (first or ends):
                out.extend((*r, 1, part, None, None) for r in waiting)
                out.append((*key, largest, 0, docs, None, 2, part, last, last is None))
            waiting = []

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in _ROWS.names), strict=True):
                if r[:2] != key:
                    close(False)
                    first = key is None
                    key, largest, last, docs = r[:2], r[2], r[2], 1
                elif r[2] != last:
                    docs, last = docs + 1, r[2]
                if first:
                    out.append((*r, 1, part, None, None))
                elif docs < min_docs:
                    waiting.append(r)
                else:
                    if waiting:
                        out.extend((*w, 0, part, None, None) for w in waiting if w[2] != largest)
                        waiting = []
                    out.append((*r, 0, part, None, None))
                if len(out) >= 20_000:
                    yield _found(out)
                    out.clear()
        close(True)
        yield _found(out)

    return run


def _found(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=_FOUND.names)


def _totals(ends: list) -> list[tuple]:
    """(h1, h2, documents, largest document) of the open runs, from at most two rows a range."""
    found: dict[tuple[int, int], list] = {}
    for r in sorted(ends, key=lambda r: r["range"]):
        key = (r["h1"], r["h2"])
        if key not in found:
            found[key] = [r["n_lines"], r["doc_id"], r["least"]]
        else:  # a document on both sides of a cut counts once
            found[key][0] += r["n_lines"] - (found[key][2] == r["doc_id"])
            found[key][2] = r["least"]
    return [(*k, v[0], v[1]) for k, v in found.items()]


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            keep = np.ones(n, dtype=np.uint8)
            keep[np.array(gone, dtype=np.int64)] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), batch.column("n_lines"), pa.array(maps, pa.binary())], names=["doc_id", "text_key", "n_lines", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text_key, n_lines, keep) of the documents that lose lines.

    Lines whose key has min_chars code points or more and occurs in min_docs documents or more
    go, except those of the largest doc_id that holds the key. keep is a zlib-compressed bitmap
    (most significant bit first) of the lines that stay; text_key is xxhash64 of the text.
    A null or empty text has one empty line, which stays. Rows that share a doc_id count as one
    document; a null doc_id is one document, less than any other. Repeated rows share a bitmap.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_hash_lines(min_chars), _ROWS)
    order = ["h1", "h2", F.col("doc_id").desc_nulls_last(), "text_key"]
    found = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream_runs(min_docs), _FOUND), "lines")
    ends = found.where("kind = 2").select("h1", "h2", "n_lines", "doc_id", "range", "least").collect()
    totals = small_table(docs.sparkSession, [r for r in _totals(ends) if r[2] >= min_docs], "k1 long, k2 long, n long, largest long")
    open_rows = found.where("kind = 1").join(totals, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).where(~same(F.col("doc_id"), F.col("largest")))
    gone = found.where("kind = 0").select("doc_id", "text_key", "n_lines", "lines").union(open_rows.select("doc_id", "text_key", "n_lines", "lines"))
    per_doc = gone.groupBy("doc_id", "text_key", "n_lines").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone"))
    return per_doc.mapInArrow(_bitmaps, "doc_id long, text_key long, n_lines long, keep binary")


def _apply(names: list[str], added: tuple[str, str]):
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, n, dropped = [], [], []
            for text, packed in zip(as_bytes(batch.column(at)), batch.column(len(names)).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                n.append(len(lines))
                if packed is None:
                    kept.append(text)
                    dropped.append(0)
                    continue
                keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), dtype=np.uint8), count=len(lines)).tolist()
                kept.append(b"\n".join(x for x, k in zip(lines, keep, strict=True) if k))
                dropped.append(len(lines) - sum(keep))
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array([None if x is None else x.decode("utf-8", "replace") for x in kept], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, *added])

    return run


def drop_lines(docs: DataFrame, bitmaps: DataFrame, added: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with the lines that a bitmap drops taken out of text, then the lines before and the lines dropped.

    ``added`` names the two new columns; where docs has a column of such a name, it keeps it and
    the new one gets an underscore behind its name.
    """
    added = tuple(unused(docs.columns, *added))
    doc, key, keep = unused(docs.columns, "doc", "key", "keep")
    marks = bitmaps.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("keep").alias(keep))
    joined = docs.join(marks, same(F.col("doc_id").cast("long"), F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left").select(*map(quoted, docs.columns), keep)
    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.LongType()), T.StructField(added[1], T.LongType())])
    return joined.mapInArrow(_apply(docs.columns, added), schema)
