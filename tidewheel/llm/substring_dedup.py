"""Substring dedup over windows of consecutive words.

Words hash to 64 bits; a Rabin-Karp polynomial over them gives every window of ``WINDOW`` words a
hash from running sums, all windows of a text at once. Spark counts the windows: for each hash,
the least and the largest doc_id that holds it. A window repeats if a smaller doc_id holds
it, and repeated windows that touch merge into maximal intervals.

Most windows need not be shuffled to be counted. A window's mark is the least hash of its
sequences of ``GRAM`` words; equal windows have equal marks, and consecutive windows that share a
mark are a run. Three steps give the same answer as counting every window:

* a run whose mark occurs in one document only repeats nothing;
* a run that is equal, window for window, to one of a smaller document repeats as a whole, and
  only the least document that holds it stands for it from here on;
* what is left are marks with several different runs; their windows are counted one by one.

Texts meet what was found in them by sort and merge at every size: that side grows with the
corpus and is never broadcast. Counts combine on the map side, and the joins that bring a
hash's documents their answer are plain joins of tables, which AQE splits where a passage is
very common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import as_bytes, discard, mixed, packed_texts, powers, slices, stored, unpacked

WINDOW = 50
GRAM = 16
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_digest = xxhash.xxh64_intdigest


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_digest, words), np.uint64, len(words))


class Rolling:
    """Rabin-Karp hashes of all windows of a text, modulo 2 ** 64.

    sums[i] is the sum of words k < i times base ** -k, so a window's polynomial is a
    difference of two sums times one power.
    """

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        self.powers = powers(_BASE, self.n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(_INVERSE, self.n), dtype=np.uint64)])

    def windows(self, width: int) -> np.ndarray:
        if self.n < width:
            return np.zeros(0, dtype=np.uint64)
        return mixed((self.sums[width:] - self.sums[:-width]) * self.powers[width - 1 :])

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words begin .. end - 1 of each pair; equal words give equal hashes wherever they stand."""
        return mixed((self.sums[end] - self.sums[begin]) * self.powers[end - 1])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width values, by running minima from both ends of blocks."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    full[: len(x)] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def marks(rolling: Rolling, window: int, gram: int) -> np.ndarray:
    """The mark of each window."""
    if rolling.n < window:
        return np.zeros(0, dtype=np.int64)
    return sliding_least(rolling.windows(gram), window - gram + 1).view(np.int64)


def _tag(text: bytes) -> int:
    """Tells apart texts of rows that repeat a doc_id: 31 bits, above the place in a long."""
    return (_digest(text, 42) & 0x7FFFFFFF) << 32


def _text_tag():
    """_tag() above the place, in Spark."""
    return F.xxhash64("text").bitwiseAND(0x7FFFFFFF).alias("tag")


def _place_tag():
    return F.shiftright("at", 32).alias("tag")


def _runs(window: int, gram: int):
    """(mark, run, n, doc_id, at) of all runs: run hashes the words that n windows from at on cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                words = text.split()
                if len(words) < window:
                    continue
                rolling = Rolling(word_hashes(words))
                own = marks(rolling, window, gram)
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                after = np.r_[first[1:], len(own)]
                out[0].append(own[first])
                out[1].append(rolling.spans(first, after + window - 1).view(np.int64))
                out[2].append((after - first).astype(np.int32))
                out[3].append(np.full(len(first), doc, dtype=np.int64))
                out[4].append(first + _tag(text))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["mark", "run", "n", "doc_id", "at"])

    return run


def _windows(window: int):
    """(h1, h2, doc_id, at) of the windows in the runs asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for doc, body, asked in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                text = unpacked(body)
                tag = _tag(text)
                own = [(r["at"] - tag, r["n"]) for r in asked if r["at"] >> 32 == tag >> 32]
                if not own:
                    continue
                hashes = word_hashes(text.split())
                at = np.unique(np.concatenate([np.arange(a, a + n) for a, n in own]))
                out[0].append(Rolling(hashes).windows(window)[at].view(np.int64))
                out[1].append((Rolling(mixed(hashes)).windows(window)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                out[2].append(np.full(len(at), doc, dtype=np.int64))
                out[3].append(at + tag)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["h1", "h2", "doc_id", "at"])

    return run


def _intervals(window: int):
    """Merges the repeated windows of a document into maximal intervals of words, text by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags, firsts = [], [], []
            for doc, places in zip(batch.column("doc_id").to_pylist(), batch.column("places"), strict=True):
                fields = places.values
                at, n = (fields.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n"))
                order = np.argsort(at, kind="stable")
                at, end = at[order], np.maximum.accumulate((at + n - 1)[order])  # first and last window; tags do not mix
                starts = np.flatnonzero(np.r_[True, at[1:] - end[:-1] > window])
                last = end[np.r_[starts[1:] - 1, len(at) - 1]]
                for a, b in zip(at[starts].tolist(), last.tolist(), strict=True):
                    docs.append(doc)
                    tags.append(a >> 32)
                    firsts.append((a & 0xFFFFFFFF, b - a + window))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(tags, pa.int64()), pa.array([f for f, _ in firsts], pa.int64()), pa.array([n for _, n in firsts], pa.int64())], names=["doc_id", "tag", "first", "words"])

    return run


def repeated_intervals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, tag, first, words): maximal intervals of words that repeat windows of smaller doc_ids.

    A window of ``window`` consecutive words repeats if a row with a smaller doc_id holds the
    same words in a row. Windows are those of the input. Rows without a doc_id repeat nothing
    and are not repeated; null, empty and short texts have no windows; rows that share a
    doc_id do not repeat each other, and tag (31 bits of the text's hash) tells their intervals
    apart. Repeated rows share their intervals.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = stored(rows.mapInArrow(_runs(window, gram), "mark long, run long, n int, doc_id long, at long"), "runs")
    twice = stored(found.groupBy("mark").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("mark"), "twice")
    runs = stored(found.join(twice, "mark"), "repeated-marks")
    discard(found)
    key = ["mark", "run", "n"]
    owners = stored(runs.groupBy(*key).agg(F.min("doc_id").alias("owner")), "owners")
    placed = runs.join(owners, key)
    whole = placed.where("doc_id > owner").select("doc_id", "at", "n")

    several = stored(owners.groupBy("mark").agg(F.count("*").alias("c")).where("c > 1").select("mark"), "several")
    open_runs = stored(placed.where("doc_id = owner").select("mark", "doc_id", "at", "n").join(several, "mark"), "open-runs")
    asked = stored(open_runs.groupBy("doc_id", _place_tag()).agg(F.collect_set(F.struct("at", "n")).alias("runs")), "asked")
    texts = packed_texts(rows.select("doc_id", _text_tag(), "text"))
    windows = stored(texts.hint("merge").join(asked, ["doc_id", "tag"]).mapInArrow(_windows(window), "h1 long, h2 int, doc_id long, at long"), "windows")
    least = stored(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("h1", "h2", "owner"), "least")
    single = windows.join(least, ["h1", "h2"]).where("doc_id > owner").select("doc_id", "at", F.lit(1).alias("n"))

    places = whole.union(single).groupBy("doc_id", _place_tag()).agg(F.collect_set(F.struct("at", "n")).alias("places"))
    merged = stored(places.mapInArrow(_intervals(window), "doc_id long, tag long, first long, words long"), "intervals")
    for old in (twice, runs, owners, several, open_runs, asked, windows, least):
        discard(old)
    return merged


def _without(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, n_words, n_removed = [], [], []
            for body, cuts in zip(batch.column("body").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                text = unpacked(body) or b""
                words = text.split()
                n_words.append(len(words))
                own = (_tag(text) >> 32) if cuts else None
                gone = sorted((c["first"], c["first"] + c["words"]) for c in cuts or () if c["tag"] == own)
                left, at = [], 0
                for a, b in gone:
                    left += words[at:a]
                    at = max(at, b)
                left += words[at:]
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept"])

    return run


def without(docs: DataFrame, intervals: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row: kept is the words that stay, joined by one space."""
    cuts = intervals.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("tag", "first", "words")).alias("cuts"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_tag(), "text")
    joined = packed_texts(rows).hint("merge").join(cuts, ["doc_id", "tag"], "left").select("doc_id", "body", "cuts")
    return joined.mapInArrow(_without(["doc_id"]), "doc_id long, n_words long, n_removed long, kept string")
