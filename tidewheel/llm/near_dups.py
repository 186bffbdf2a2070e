"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash as in ``simhash``, on fingerprints that are wide enough for this similarity: ``WORDS``
times 64 bits, cut into 2-bit segments. A grid takes the counts of some segments; sets in one cell
of one of many grids are compared by the Hamming distance of their first ``SKETCH`` bits, and
those that chains of at most ``RADIUS`` bits connect there are candidates. Every link is verified on the
two whole sets, in integers. Two sets of similarity 0.8 differ in ``FLIP`` of the bits (arccos(8/9) / pi,
less if their sizes differ), so a segment's counts agree with probability ``AGREE``; cells get smaller and
grids more numerous with the table such that one of them holds such a pair with probability 1 - ``MISS``, by the formula.

Candidates are settled in two passes, each of which ships a set at most once to each place that needs
it. First each group's hub, its member with the most candidates, meets the others. Then the members
of groups that still hold several components all meet. Places of more than ``PLACE`` sets are cut
into chunks, in the second pass into chunks that meet each other in pairs, as do chunks of cells of more
than ``CELL_ROWS``. A place reports a spanning forest of its links, never all pairs; connected components join the forests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import as_bytes, discard, mixed, signed, slices, stored
from tidewheel.llm.components import components
from tidewheel.llm.simhash import SEED

SHINGLE = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
#: 64-bit words of a fingerprint.
WORDS = 8
#: Bits that are compared in a cell, and the distance up to which: 5 standard deviations above that at the least similarity.
SKETCH, RADIUS = 128, 40
FLIP = math.acos(8 / 9) / math.pi
AGREE = (1 - FLIP) ** 2 + FLIP**2 / 2
MISS = 0.001
#: Sets of a chunk.
PLACE = 128
#: Sets of a cell that are compared in one place.
CELL_ROWS = 4096
#: Shingles whose bits are counted at a time: counts fit a byte.
_BLOCK = 255
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; words and short texts as in simhash.fingerprint."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8"))


def wide_fingerprint(hashes: np.ndarray) -> bytes | None:
    """The SimHash of a set: a bit is 1 if it is set in over half the shingles' hashes; none of an empty set."""
    if not len(hashes):
        return None
    total = np.zeros(64 * WORDS, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        x = np.multiply.outer(hashes[at : at + _BLOCK], _FACTORS)
        x ^= x >> np.uint64(32)
        x *= _FACTORS[0]
        total += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(hashes), bitorder="little").tobytes()


def grids(n: int) -> np.ndarray:
    """The segments that each grid takes, for n sets: some hundred of them share a cell."""
    segments = max(3, round(math.log(max(n, 2)) / math.log(8 / 3)) - 6)
    number = math.ceil(math.log(MISS) / math.log1p(-(AGREE**segments)))
    rng = np.random.default_rng(SEED)
    return np.stack([rng.permutation(32 * WORDS)[:segments] for _ in range(number)])


def _cells(grid: np.ndarray):
    """(cell, uid, a, b) of each fingerprint in each grid; a and b are the bits that are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, segments = grid.shape
        tags = np.arange(number, dtype=np.int64) << 48
        for batch in slices(batches, 1024):
            bits = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(-1, 8 * WORDS)
            counts = np.unpackbits(bits, axis=1, bitorder="little").reshape(len(bits), -1, 2).sum(axis=2, dtype=np.uint8)
            cells = np.repeat(tags[None, :], len(bits), axis=0)
            for i in range(segments):
                cells += counts[:, grid[:, i]].astype(np.int64) << 2 * i
            words = bits[:, : SKETCH // 8].copy().view("<i8")
            columns = [np.repeat(x, number) for x in (batch.column("uid").to_numpy(), words[:, 0], words[:, 1])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cells.ravel(), *columns)], names=["cell", "uid", "a", "b"])

    return run


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row the first row of its group: those that chains of at most RADIUS bits connect."""
    n = len(a)
    label = np.arange(n)
    if n <= 512:
        near = np.bitwise_count(a[:, None] ^ a) + np.bitwise_count(b[:, None] ^ b) <= RADIUS
        if near.sum() > n:
            while (after := np.where(near, label, n).min(axis=1)).tolist() != label.tolist():
                label = after
        return label
    left = np.arange(n)
    while len(left) > 1:
        root, wave = left[0], [left[0]]
        left = left[1:]
        while wave and len(left):
            x = wave.pop()
            near = np.bitwise_count(a[left] ^ a[x]) + np.bitwise_count(b[left] ^ b[x]) <= RADIUS
            label[left[near]] = root
            wave += left[near].tolist()
            left = left[~near]
    return label


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, uid, n) of each group of candidates in each run of rows with one cell; equal groups have equal keys."""

    def one(parts: list[tuple]) -> pa.RecordBatch:
        cell, uid, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        keys, uids, sizes = [], [], []
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
            if e - s < 2:
                continue
            label = _near(a[s:e], b[s:e])
            size = np.bincount(label)[label]
            if (many := size > 1).any():
                sums = np.zeros(e - s, dtype=np.uint64)
                np.add.at(sums, label, mixed(uid[s:e].view(np.uint64) + np.uint64(1)))
                keys.append(mixed(sums[label[many]] + size[many].astype(np.uint64)).view(np.int64))
                uids.append(uid[s:e][many])
                sizes.append(size[many])
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, uids, sizes)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["key", "uid", "n"])

    held: list[tuple] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(np.array(batch.column(c).to_numpy()).view(t) for c, t in zip(("cell", "uid", "a", "b"), ("i8", "i8", "u8", "u8"), strict=True)))
        rows += batch.num_rows
        cell = held[-1][0]
        if rows < 100_000 or cell[0] == cell[-1]:
            continue
        cut = int(np.searchsorted(cell, cell[-1]))  # the last run may go on
        rest = tuple(x[cut:] for x in held[-1])
        held[-1] = tuple(x[:cut] for x in held[-1])
        yield one(held)
        held, rows = [rest], len(rest[0])
    if rows:
        yield one(held)


def candidates(sets: DataFrame) -> DataFrame:
    """(key, uid, n): the groups of candidates, each of n members.

    sets: uid, print of one row of each distinct set.
    """
    known = sets.where("print IS NOT NULL").select("uid", "print")
    run = _cells(grids(known.count()))
    cells = known.mapInArrow(run, "cell long, uid long, a long, b long")
    large = stored(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS), "cells")
    if not large.isEmpty():
        # chunks i and j of a large cell meet under the key (cell, i, j)
        chunks = F.coalesce(F.ceil(F.col("n") / (CELL_ROWS // 2)), F.lit(1))
        dealt = cells.join(large, "cell", "left").withColumn("c", chunks).withColumn("i", F.pmod(F.xxhash64("uid"), F.col("c")))
        met = dealt.select("cell", "uid", "a", "b", "i", "c", F.explode(F.expr("sequence(0L, c - 1)")).alias("j"))
        key = F.when(F.col("c") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("i", "j"), F.greatest("i", "j")))
        cells = met.select(key.alias("cell"), "uid", "a", "b")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_groups, "key long, uid long, n long").distinct()


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = as_bytes(batch.column("text"))
            found = [shingles(x, shingle) for x in texts]
            columns = [
                pa.array([SEED if x is None else signed(xxhash.xxh64_intdigest(x, SEED)) for x in texts], pa.int64()),
                pa.array([signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)) for x in found], pa.int64()),
                pa.array([wide_fingerprint(x) for x in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), *columns], names=["uid", "doc_id", "text_key", "set_key", "print"])

    return run


def _bodies(shingle: int):
    """(uid, body) of rows of (uid, text); rows that repeat the one before are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in slices(batches):
            uids = batch.column("uid").to_pylist()
            new = [i for i, (x, y) in enumerate(zip(uids, [last, *uids], strict=False)) if x != y]
            last, texts = uids[-1], as_bytes(batch.column("text").take(pa.array(new, pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array([uids[i] for i in new], pa.int64()), pa.array([shingles(x, shingle).tobytes() for x in texts], pa.binary())], names=["uid", "body"])

    return run


def _forest(uids: list[int], bodies: list[bytes]) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets that are not empty."""
    sizes = np.array([len(x) // 8 for x in bodies])
    codes = np.unique(np.frombuffer(b"".join(bodies), dtype="<u8"), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    held = np.zeros(len(codes), dtype=np.uint8)
    left, links = np.ones(len(uids), dtype=bool), []
    up, down = LEAST
    for root in range(len(uids)):
        wave = [root] if left[root] else []
        left[root] = False
        while wave and left.any():
            x = wave.pop()
            own = codes[starts[x] : ends[x]]
            held[own] = 1
            common = np.add.reduceat(held[codes], starts, dtype=np.int64)
            held[own] = 0
            # common / (both - common) >= up / down
            near = np.flatnonzero(left & (common * (up + down) >= (sizes + sizes[x]) * up)).tolist()
            left[near] = False
            links += [(uids[x], uids[y]) for y in near]
            wave += near
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of rows with one key."""
    place, uids, bodies = None, [], []
    for batch in slices(batches):
        found = []
        for key, uid, body in zip(*(batch.column(c).to_pylist() for c in ("key", "uid", "body")), strict=True):
            if key != place:
                found += _forest(uids, bodies) if len(uids) > 1 else []
                place, uids, bodies = key, [], []
            uids.append(uid)
            bodies.append(body)
        yield _pairs(found)
    yield _pairs(_forest(uids, bodies) if len(uids) > 1 else [])


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _verified(places: DataFrame, bodies: DataFrame) -> DataFrame:
    """Links (a, b) among the sets of each place; places: (key, uid)."""
    met = places.join(bodies, "uid").select("key", "uid", "body")
    return stored(met.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long"), "links")


def links(docs: DataFrame, sets: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Links (a, b) between uids that connect all candidates with the least similarity.

    sets: uid, text_key, print of one row of each distinct set. Whole sets are made again, of candidates only, from docs.
    """
    shared = stored(candidates(sets), "shared")
    wanted = shared.select("uid").distinct().join(sets.select("uid", "text_key"), "uid").select("uid", F.col("text_key").alias("_key"))
    texts = docs.select("text").join(wanted, F.xxhash64("text") == F.col("_key")).select("uid", "text")
    bodies = stored(texts.mapInArrow(_bodies(shingle), "uid long, body binary").dropDuplicates(["uid"]), "bodies")
    scores = shared.groupBy("uid").agg(F.sum("n").alias("score"))
    hubs = shared.join(scores, "uid").groupBy("key").agg(F.max(F.struct("score", "uid"))["uid"].alias("hub"))
    pairs = stored(shared.join(hubs, "key").where("hub <> uid").select("hub", "uid").distinct(), "pairs")
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PLACE).alias("c"))
    chunk = F.xxhash64("hub", F.pmod(F.xxhash64("uid"), F.col("c")))
    spokes = stored(pairs.join(parts, "hub").select(chunk.alias("key"), "hub", "uid"), "spokes")
    first = _verified(spokes.select("key", "uid").union(spokes.select("key", "hub").distinct()), bodies)

    known = stored(components(first), "known")
    named = shared.join(known, F.col("uid") == F.col("node"), "left").select("key", "uid", "n", F.coalesce("component", "uid").alias("component"))
    members = F.sum(F.xxhash64("uid").cast("decimal(38,0)"))
    several = named.groupBy("key", "n").agg(F.min("component").alias("low"), F.max("component").alias("high"), members.alias("members")).where("low <> high")
    # keys with the same members are settled once
    several = several.groupBy("members", "n").agg(F.min("key").alias("key")).select("key")
    rest = shared.join(several, "key").withColumn("c", F.ceil(F.col("n") / PLACE)).withColumn("i", F.pmod(F.xxhash64("uid"), F.col("c")))
    met = rest.select("key", "uid", "i", F.explode(F.expr("sequence(0L, c - 1)")).alias("j"))
    second = _verified(met.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "uid"), bodies)
    return first.union(second)


def group(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, group_fp, component_id) of every row, as simhash.group has them.

    Null, empty and wordless texts have the empty set and are one group. A text of fewer words
    than a shingle is one shingle. Rows of equal sets are one node and cost nothing more.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stored(numbered.mapInArrow(_sets(shingle), "uid long, doc_id long, text_key long, set_key long, print binary"), "sets")
    prints = stored(sets.select("uid", "doc_id", "text_key", "set_key"), "prints")
    distinct = stored(prints.groupBy("set_key").agg(F.min("uid").alias("node_uid"), F.min("doc_id").alias("least")), "distinct")
    owners = stored(sets.select("uid", "text_key", "print").join(distinct.select(F.col("node_uid").alias("uid")), "uid", "left_semi"), "owners")
    discard(sets)
    found = links(docs, owners, shingle)
    classes = distinct.join(stored(components(found), "components"), F.col("node_uid") == F.col("node"), "left").select("set_key", "least", F.coalesce("component", "node_uid").alias("group_fp"))
    classes = stored(classes, "classes")
    firsts = classes.groupBy("group_fp").agg(F.min("least").alias("component_id"))
    named = stored(classes.select("set_key", "group_fp").join(firsts, "group_fp"), "named")
    return prints.select("doc_id", "text_key", "set_key").join(named, "set_key").select("doc_id", "text_key", "group_fp", "component_id")
