"""Mixing sources to target weights, in fixed-length blocks.

Sizes are words. Each source's documents are dealt to hash buckets and laid end to end in
them; blocks of ``block`` words number through the buckets of a source. A source with target T
and size S gives round(T / S x its blocks) blocks. The output is cut into shards of
``shard_slots`` slots. A shard's counts of the sources are multinomial, given that all shards
together take exactly each source's number: the counts come from halving the shards again and
again with hypergeometric draws, so every shard finds its own counts and those of all shards
before it without the others. The k-th block taken from a source is k modulo its blocks under
the epoch's pseudorandom permutation of its block indices (a keyed Feistel network), so no
block is taken once more before all have been taken as often. Slots and blocks then meet in an
ordinary join on (source, block). Everything is a function of the seed: reruns agree.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import as_bytes, discard, quoted, same, signed, slices, small_table, stored, unused

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_TIMES = 2.0
#: Words of a block, and slots of an output shard.
BLOCK = 64
SHARD_SLOTS = 4096
#: Words that a bucket should hold, and buckets that are numbered together.
BUCKET_WORDS, BUCKETS = 1 << 17, 4096
#: Populations from which numpy's generator draws; larger ones go through large_draw. Both draw exactly.
NUMPY_MOST = 10**9 - 1


def targets(sizes: list[float], weights: list[float], total: float, most: float = MOST_TIMES) -> list[float]:
    """Shares of total by weight, none above most times its size; the excess is shared again by weight."""
    found = [0.0] * len(sizes)
    free = [i for i in range(len(sizes)) if sizes[i] > 0]
    left = float(total)
    while free:
        weight = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in free:
                found[i] = left * weights[i] / weight
            break
        for i in full:
            found[i] = most * sizes[i]
        left -= sum(found[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return found


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = as_bytes(batch.column("text"))
        size = [len(x.split()) if x else 0 for x in texts]
        key = [42 if x is None else signed(xxhash.xxh64_intdigest(x, 42)) for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(key, pa.int64()), pa.array(size, pa.int64())], names=["doc_id", "source", "text_key", "size"])


def _stirling_error(n: float) -> float:
    """log n! less Stirling's approximation of it."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    square = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * square)) / square) / square) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where x is near mean."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, power = (x - mean) * v, 2 * x * v
    for j in range(1, 1000):
        power *= v * v
        more = total + power / (2 * j + 1)
        if more == total:
            break
        total = more
    return total


def _log_binomial(x: int, n: int, p: float) -> float:
    """Log-probability of x successes in n, by the saddle-point expansion (Loader, 2000): accurate at any n."""
    if x in (0, n):
        return n * math.log1p(-p) if x == 0 else n * math.log(p)
    error = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x)
    return error - _deviance(x, n * p) - _deviance(n - x, n * (1 - p)) - 0.5 * math.log(2 * math.pi * x * (1 - x / n))


def log_hypergeometric(k: int, good: int, bad: int, need: int) -> float:
    """Log-probability that k of need draws without replacement are good."""
    p = need / (good + bad)
    return _log_binomial(k, good, p) + _log_binomial(need - k, bad, p) - _log_binomial(need, good + bad, p)


def large_draw(rng: np.random.Generator, good: int, bad: int, need: int) -> int:
    """A hypergeometric draw from a population of any size, by ratio of uniforms (Stadlober, 1990)."""
    if good > bad:
        return need - large_draw(rng, bad, good, need)
    if 2 * need > good + bad:
        return good - large_draw(rng, good, bad, good + bad - need)
    rest = good + bad
    low, high = max(0, need - bad), min(good, need)
    mean = need * (good / rest)
    variance = mean * (bad / rest) * ((rest - need) / (rest - 1))
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(variance + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    mode = min(high, max(low, (need + 1) * (good + 1) // (rest + 2)))
    top = log_hypergeometric(mode, good, bad, need)
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log_hypergeometric(k, good, bad, need) - top:
            return k


def _split(rng: np.random.Generator, left: np.ndarray, slots: int) -> np.ndarray:
    """How many of each source fall in the first ``slots`` slots, when left[s] of each are dealt at random."""
    out, rest, need = np.zeros_like(left), int(left.sum()), slots
    for s, n in enumerate(left.tolist()):
        others = rest - n
        low, high = max(0, need - others), min(n, need)
        if low == high:
            take = low
        elif rest <= NUMPY_MOST:
            take = int(rng.hypergeometric(n, others, need))
        else:
            take = large_draw(rng, n, others, need)
        out[s] = take
        need -= take
        rest = others
    return out


def shard_counts(draws: list[int], shard: int, shard_slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks of each source in this shard, blocks of each source in all shards before it)."""
    left, before = np.array(draws, dtype=np.int64), np.zeros(len(draws), dtype=np.int64)
    low, high = 0, max(1, -(-int(left.sum()) // shard_slots))
    while high - low > 1:
        mid = (low + high) // 2
        first = _split(np.random.default_rng([seed, low, high]), left, (mid - low) * shard_slots)
        if shard < mid:
            left, high = first, mid
        else:
            left, before, low = left - first, before + first, mid
    return left, before


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size - 1: a four-round Feistel network, walked until in range."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for turn in range(4):
            mixed = (right + np.uint64((key * 4 + turn + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        x = left << np.uint64(half) | right
        out[todo] = x
        todo = todo[x >= size]
    return out.astype(np.int64)


def _slots(draws: list[int], blocks: list[int], shard_slots: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                count, before = shard_counts(draws, shard, shard_slots, seed)
                sid = np.repeat(np.arange(len(draws)), count)
                block, epoch = np.zeros(len(sid), dtype=np.int64), np.zeros(len(sid), dtype=np.int64)
                at = 0
                for s, n in enumerate(count.tolist()):
                    if n:
                        k = before[s] + np.arange(n)
                        epoch[at : at + n] = k // blocks[s]
                        for e in np.unique(epoch[at : at + n]).tolist():
                            here = at + np.flatnonzero(epoch[at : at + n] == e)
                            block[here] = permuted(k[here - at] % blocks[s], blocks[s], xxhash.xxh64_intdigest(struct.pack("<qqq", seed, s, e)))
                        at += n
                slot = np.random.default_rng([seed, 1, shard]).permutation(len(sid))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (sid, block, epoch, np.full(len(sid), shard), slot)], names=["sid", "block", "epoch", "shard", "slot"])

    return run


@dataclass
class Mixture:
    """pieces: one row per document and block; slots: one row per output place; empty: documents without words."""

    pieces: DataFrame
    slots: DataFrame
    empty: DataFrame
    #: (source, size, target, blocks, blocks taken) of each source.
    sources: list[tuple]

    # Both sides grow with the corpus, but the planner sees only the few rows that they are
    # generated from and would broadcast them; hence the hints.

    def sequence(self) -> DataFrame:
        """The mix: shard, slot, and the words [first, first + words) of a document that stand there, in order of start."""
        return self.slots.join(self.pieces.hint("merge"), ["sid", "block"])

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target and taken (words, repeats counted) of every row."""
        row = ["doc_id", "sid", "bucket", "start", "size", "source_size", "target"]
        met = self.pieces.join(self.slots.hint("merge"), ["sid", "block"], "left")
        summed = met.groupBy(*row).agg(F.sum(F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0)).cast("long").alias("taken"))
        kept = ["doc_id", "size", "source_size", "target", "taken"]
        return summed.select(*kept).union(self.empty.withColumn("taken", F.lit(0).cast("long")).select(*kept))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_TIMES, block: int = BLOCK, seed: int = 20, shard_slots: int = SHARD_SLOTS) -> Mixture:
    """Plans a mix of docs (doc_id, source, text) by source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times
    all words; a target stops at ``most`` (at most 2 here) times its source's words. Null and empty texts and
    texts of white space have no words and nothing of them is taken. Repeated rows are documents
    of their own; null ids too. The per-source figures go through the driver: one row a source.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    sized = stored(rows.mapInArrow(_sizes, "doc_id long, source string, text_key long, size long"), "sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    sources = sorted(((r["source"], r["n"]) for r in found), key=lambda r: (r[0] is None, r[0] or ""))
    words = [n for _, n in sources]
    aim = targets(words, [weights[i % len(weights)] for i in range(len(words))], share * sum(words), most)
    table = [(i, s, n, aim[i], max(1, -(-n // BUCKET_WORDS))) for i, (s, n) in enumerate(sources)]
    known = small_table(spark, table, "sid long, _source string, source_size long, target double, buckets long")
    dealt = sized.join(known, same(F.col("source"), F.col("_source"))).drop("_source").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_key"), F.col("buckets")))
    per_bucket = dealt.groupBy("sid", "bucket").agg(F.ceil(F.sum("size") / F.lit(block)).alias("n"))
    per_bucket = stored(per_bucket.withColumn("run", F.expr(f"bucket div {BUCKETS}")), "buckets")
    # runs of buckets are numbered first, then the buckets in each, so no task sees all buckets of a source
    runs = per_bucket.groupBy("sid", "run").agg(F.sum("n").alias("in_run"))
    runs = runs.withColumn("before", F.sum("in_run").over(Window.partitionBy("sid").orderBy("run")) - F.col("in_run"))
    inside = F.sum("n").over(Window.partitionBy("sid", "run").orderBy("bucket")) - F.col("n")
    bases = stored(per_bucket.withColumn("inside", inside).join(runs, ["sid", "run"]).select("sid", "bucket", "n", (F.col("before") + F.col("inside")).alias("base")), "bases")
    discard(per_bucket)
    blocks = {r["sid"]: r["n"] for r in bases.groupBy("sid").agg(F.sum("n").alias("n")).collect()}
    blocks = [int(blocks.get(i, 0)) for i in range(len(words))]
    draws = [min(round(aim[i] / words[i] * blocks[i]), int(most * blocks[i])) if words[i] else 0 for i in range(len(words))]

    line = Window.partitionBy("sid", "bucket").orderBy("doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.where("size > 0").withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0)))
    placed = placed.join(bases.select("sid", "bucket", "base"), ["sid", "bucket"])
    lined = placed.withColumn("local", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    first = F.greatest(F.col("start"), F.col("local") * block)
    after = F.least(F.col("start") + F.col("size"), (F.col("local") + 1) * block)
    own = ["bucket", "doc_id", "text_key", "source", "size", "source_size", "target", "start"]
    pieces = lined.select("sid", (F.col("base") + F.col("local")).alias("block"), *own, (first - F.col("start")).alias("first"), (after - first).alias("words"))
    shards = -(-sum(draws) // shard_slots)
    parts = max(1, min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    slots = spark.range(0, shards, 1, parts).mapInArrow(_slots(draws, blocks, shard_slots, seed), "sid long, block long, epoch long, shard long, slot long")
    return Mixture(pieces, slots, dealt.where("size = 0"), [(s, n, aim[i], blocks[i], draws[i]) for i, (s, n) in enumerate(sources)])


def _texts(names: list[str]):
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(rb"[^\x20\x09-\x0D]+")
        for batch in slices(batches):
            take, out = [], []
            for i, (text, takes) in enumerate(zip(as_bytes(batch.column("text")), batch.column(len(names)).to_pylist(), strict=True)):
                spans = None
                for one in takes:
                    ranges = _merged(one["ranges"])
                    if len(ranges) == 1 and ranges[0][0] == 0 and ranges[0][1] == one["size"]:
                        out.append(text)
                    else:
                        spans = spans or [m.span() for m in word.finditer(text)]
                        out.append(b"\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in ranges))
                    take.append(i)
            columns = [batch.column(i).take(pa.array(take, pa.int64())) for i in range(len(names))]
            columns[at] = pa.array([x.decode("utf-8", "replace") for x in out], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _merged(ranges: list[dict]) -> list[tuple[int, int]]:
    found: list[list[int]] = []
    for r in sorted(ranges, key=lambda r: r["first"]):
        a, b = r["first"], r["first"] + r["words"]
        if found and found[-1][1] >= a:
            found[-1][1] = b
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


def mixed_documents(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """The mix as rows of docs: one for each document and epoch in which words of it are taken.

    Its text is the whole text where all words are taken, else the runs of taken words joined by
    a line break. Documents of which nothing is taken, and those without words, are not in it.
    Rows that repeat doc_id and text are counted apart in the plan and are one document here.
    """
    row = ["doc_id", "text_key", "sid", "bucket", "start", "epoch"]
    each = mixture.sequence().groupBy(*row, "size").agg(F.collect_list(F.struct("first", "words")).alias("ranges"))
    doc, key, taken = unused(docs.columns, "doc", "key", "takes")
    takes = each.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).agg(F.collect_list(F.struct("ranges", "size")).alias(taken))
    base = docs
    if not mixture.pieces.select("doc_id", "text_key", "sid", "bucket", "start").distinct().groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        base = base.dropDuplicates(["doc_id", "text"])
    joined = base.join(takes, same(F.col("doc_id").cast("long"), F.col(doc)) & (F.xxhash64("text") == F.col(key))).select(*map(quoted, base.columns), taken)
    return joined.mapInArrow(_texts(base.columns), T.StructType(base.schema.fields))
