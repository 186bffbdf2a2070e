"""SimHash near-dedup by a segment-popcount grid.

A fingerprint's bits are cut into 2-bit segments; the vector of segment bit counts (0, 1 or 2
each) embeds it so that the Manhattan distance of two vectors never exceeds the Hamming
distance of the fingerprints. Within a Manhattan distance of 4 over both 32-bit halves, one
half is within 2; then some grid cell is within 1 of both vectors in that half. Every distinct
fingerprint goes to the cells within 1 of each half (25 on average), cells are dealt by their
key, and candidates that share a cell are verified by Hamming distance. A cell reports a
spanning forest of its verified links, never all pairs; connected components join the forests.

Equal fingerprints collapse to one row before any cell is made, so copies cost nothing. Cells
of more than ``CELL_ROWS`` fingerprints are cut into chunks that meet each other in pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import as_bytes, same, signed, slices, stored, unused
from tidewheel.llm.components import components

SEED = 42
SHINGLE = 4
DISTANCE = 4
#: Fingerprints of a cell that are compared in one piece.
CELL_ROWS = 4096
#: Hashes whose bits are unpacked at a time.
_BLOCK = 1 << 16


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint32)
    return total


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of word shingles; A-Z count as a-z, words are runs outside \\x20 and \\x09-\\x0D.

    A text of fewer words is one shingle; one without words, or null, has fingerprint 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[shingle - 1 :].tolist()
    begins = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins, stops, strict=True)], dtype="<u8")
    over = _bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = as_bytes(batch.column("text"))
            found = [signed(fingerprint(x, shingle)) for x in texts]
            keys = [SEED if x is None else signed(xxhash.xxh64_intdigest(x, SEED)) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "text_key", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp): xxhash64 and the 64-bit SimHash of every row's whole text, as signed longs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(shingle), "doc_id long, text_key long, fp long")


# In each 32-bit half, bits 2i and 2i+1 are segment i. A cell is the half's 16 counts, 2 bits each.
_LOW = np.uint64(0x5555555555555555)


def _counts(half: np.ndarray) -> np.ndarray:
    """The 16 segment counts of 32-bit halves, packed 2 bits each."""
    return (half & _LOW) + ((half >> np.uint64(1)) & _LOW)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint's own cell and all cells one step away, in both halves."""
    for batch in slices(batches, 8192):
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        row = np.arange(len(fp))
        rows, cells = [], []
        for side in (0, 1):
            own = _counts((fp >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF))
            tag = np.uint64(side << 32)
            rows.append(row)
            cells.append(own | tag)
            for i in range(16):
                count, step = (own >> np.uint64(2 * i)) & np.uint64(3), np.uint64(1 << 2 * i)
                up, down = count < 2, count > 0
                rows += [row[up], row[down]]
                cells += [(own[up] + step) | tag, (own[down] - step) | tag]
        take = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).view(np.int64)), batch.column("fp").take(take)], names=["cell", "fp"])


def _forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a few thousand fingerprints, all from the first of a tree."""
    links = []
    left = np.argsort(fp, kind="stable")
    while len(left) > 1:
        wave, left = left[:1], left[1:]
        root = int(fp[wave[0]])
        while len(wave) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for at in range(0, len(wave), 256):
                near |= (np.bitwise_count(fp[wave[at : at + 256], None] ^ fp[None, left]) <= distance).any(axis=0)
            wave, left = left[near], left[~near]
            links += [(root, int(x)) for x in fp[wave]]
    return links


def _small_runs(cell: np.ndarray, fp: np.ndarray, distance: int, most: int) -> tuple[list, list]:
    """Links in runs of at most ``most`` rows, by comparing each row with the next few."""
    a, b = [], []
    for step in range(1, most):
        close = np.flatnonzero(cell[step:] == cell[:-step])
        if not len(close):
            break
        close = close[np.bitwise_count(fp[close] ^ fp[close + step]) <= distance]
        a.append(fp[close])
        b.append(fp[close + step])
    return a, b


def _links(distance: int):
    def one(parts: list[tuple]) -> pa.RecordBatch | None:
        key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        a, b = [], []
        few = np.repeat(sizes <= 16, sizes)
        x, y = _small_runs(key[few], fp[few], distance, 16)
        a += x
        b += y
        for s, n in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
            found = _forest(fp[s : s + n], distance)
            a.append(np.array([u for u, _ in found], dtype=np.uint64))
            b.append(np.array([v for _, v in found], dtype=np.uint64))
        if not a:
            return None
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.array(batch.column("key").to_numpy(zero_copy_only=False))
            fp = np.array(batch.column("fp").to_numpy(zero_copy_only=False)).view(np.uint64)
            held.append((key, fp))
            rows += len(key)
            if rows < 200_000 or key[0] == key[-1]:
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last run may go on
            rest = (key[cut:], fp[cut:])
            held[-1] = (key[:cut], fp[:cut])
            if (found := one(held)) is not None:
                yield found
            held, rows = [rest], len(rest[0])
        if rows and (found := one(held)) is not None:
            yield found

    return run


def _largest_own_cell(prints: DataFrame) -> int:
    """Most fingerprints with one vector of segment counts; a cell holds those of at most 33 vectors."""
    low = 0x55555555
    halves = [F.shiftrightunsigned("fp", 32 * side).bitwiseAND(0xFFFFFFFF) for side in (0, 1)]
    own = [h.bitwiseAND(low) + F.shiftright(h, 1).bitwiseAND(low) for h in halves]
    each = prints.select(F.explode(F.array(own[0], own[1] + F.lit(1 << 32))).alias("cell")).groupBy("cell").count()
    return each.agg(F.max("count")).first()[0] or 0


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between fingerprints that connect all that are within the distance.

    prints: distinct fp (long). Not every pair within the distance is listed, but every such
    pair is connected by the listed links, which join only fingerprints that chains of such pairs connect.
    """
    if distance > 4:
        raise ValueError("two halves within 2 need a distance of at most 4")
    cells = prints.select("fp").mapInArrow(_cells, "cell long, fp long")
    keyed = cells.select(F.col("cell").alias("key"), "fp")
    if _largest_own_cell(prints) > CELL_ROWS // 33:
        # chunks i and j of a large cell meet under the key (cell, i, j)
        counts = stored(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS), "cells")
        large = cells.join(counts, "cell", "left").withColumn("c", F.coalesce(F.ceil(F.col("n") / (CELL_ROWS // 2)), F.lit(1))).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("c")))
        met = large.select("cell", "fp", "i", "c", F.explode(F.expr("sequence(0L, c - 1)")).alias("j"))
        keyed = met.select(F.when(F.col("c") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("i", "j"), F.greatest("i", "j"))).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links(distance), "a long, b long").distinct()


def group(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, text_key, fp, group_fp, component_id) of every row: component_id is the least doc_id reachable by links.

    Fingerprints within ``distance`` bits are linked; null, empty and wordless texts share
    fingerprint 0 and are linked to each other and to whatever is near 0. Repeated rows and ties
    share their fingerprint's component. Rows without a doc_id take part in links; component_id is
    null only where no row of the group has an id; group_fp is the group's least fingerprint.
    """
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct.select("fp"), distance))
    linked = found.join(distinct, F.col("node") == F.col("fp")).select("node", "component", "least")
    named = stored(linked.groupBy("component").agg(F.min("least").alias("first")), "named")
    owners = stored(linked.select("node", F.col("component").alias("_component")).join(named, F.col("_component") == F.col("component")).select("node", "component", "first"), "owners")
    classes = distinct.join(owners, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "fp").alias("group_fp"), F.when(F.col("node").isNotNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(stored(classes, "classes"), F.col("fp") == F.col("_fp")).select("doc_id", "text_key", "fp", "group_fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs of which one of each group stays: the one with the least doc_id.

    Where that doc_id has several texts in the group, the one with the least text hash stays;
    a row that repeats doc_id and text stays once. In a group without any doc_id the least
    text hash decides.
    """
    return one_of_each(docs, group(docs, shingle, distance))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """keep_one for any groups: doc_id, text_key, group_fp and component_id of every row of docs."""
    firsts = groups.where(same(F.col("doc_id"), F.col("component_id")))
    rows = stored(firsts.groupBy("group_fp", "doc_id", "text_key").agg(F.count("*").alias("n")), "firsts")
    doc, key = unused(docs.columns, "doc", "key")
    chosen = rows.groupBy("group_fp").agg(F.min(F.struct("text_key", "doc_id")).alias("c")).select(F.col("c.doc_id").alias(doc), F.col("c.text_key").alias(key))
    kept = docs.join(chosen, same(F.col("doc_id").cast("long"), F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left_semi")
    return kept if rows.where("n > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])
