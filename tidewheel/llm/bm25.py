"""Exact top-k search by BM25 over sharded inverted indexes with block-max pruning.

Terms are runs of ASCII letters, digits and all non-ASCII characters, A-Z as a-z; a term is
known by 64 bits of a Rabin-Karp hash, which two of ten million terms share with a probability of some 1e-5. Document
frequencies, the number of documents and their mean length are global, so scores from
different shards compare exactly and the merge of the shards' lists is the list of the whole.

A search task builds the inverted index of a shard of documents, ordered so that documents of
one language and length lie together. Queries come in batches from a table in the shared
folder, never all at once, with each batch's distinct terms numbered once. The terms of a shard
are split as WAND splits them: contributions of the rare ones are summed from their postings,
document by document; for the frequent ones each block of ``BLOCK_DOCS`` documents has a largest
contribution. A block's bound for a query is its best sum of rare terms plus the block maxima
of the query's frequent terms. Only queries and blocks whose bound reaches the query's threshold
go on to the frequent terms, as one matrix product in single precision; whatever comes within
its error of the threshold is scored again in double precision, term by term.

Thresholds come from rounds over nested samples of the documents, each SAMPLE_OF times the one
before: the k-th score over a sample is never above the k-th score over all documents, so
nothing is missed, and a round returns about k x SAMPLE_OF rows a query however many shards there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import as_bytes, fresh_path, mixed, powers, same, signed, stored, text_slices

K1, B = 1.2, 0.75
#: Documents, and bytes of text, of a shard's index; documents of a block; queries of a batch.
SHARD_DOCS, SHARD_BYTES, BLOCK_DOCS, BATCH = 2048, 1 << 23, 64, 256
#: Terms of a batch's queries, but for a longer single query.
BATCH_TERMS = 1 << 18
#: Terms in more than this share of a shard's documents are frequent: the matrix has their columns, at most so many.
FREQUENT, MOST_FREQUENT = 1 / 20, 1024
#: Relative error of a single-precision sum of up to MOST_FREQUENT and as many rare terms as a text has, with room.
ERROR = 1e-3
#: Each round of thresholds looks at so many times the documents of the one before.
SAMPLE_OF = 32
#: Scores are compared rounded to so many decimals.
DECIMALS = 6
_NEAR = 10.0**-DECIMALS
#: Terms that a task counts before it hands them on.
_COUNTED = 500_000
#: Queries whose rare terms are summed at a time, and pairs that are scored in double precision at a time.
_TOGETHER, _PAIRS = 16, 2048
_NO_ID = np.iinfo(np.int64).max

_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text whose terms are hashed at a time, but for a longer single text.
_HASHED = 1 << 20
_TABLES = [np.zeros(0, np.uint64)] * 2


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    if len(_TABLES[0]) < n:
        _TABLES[:] = [powers(base, max(n, _HASHED + (_HASHED >> 2))) for base in (_BASE, _INVERSE)]
    return _TABLES


def hashed_terms(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the texts' terms in order, and how many each text has."""
    found, counts, part, size = [], np.zeros(len(texts), dtype=np.int64), [], 0
    for i, text in enumerate(texts):
        part.append(text or b"")
        size += len(part[-1]) + 1
        if size >= _HASHED or i + 1 == len(texts):
            hashes, starts = _hashed(b" ".join(part) + b" ")
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            counts[i + 1 - len(part) : i + 1] = np.diff(np.searchsorted(starts, ends), prepend=0)
            found.append(hashes)
            part, size = [], 0
    return np.concatenate(found) if found else np.zeros(0, np.int64), counts


def _hashed(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the terms of a text that ends in a space."""
    up, down = _tables(len(blob) + 1)
    x = np.frombuffer(blob.lower().translate(_BLANK), np.uint8)
    edges = np.flatnonzero(np.diff((x != 32).view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x * down[: len(x)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * up[ends]).view(np.int64), starts


def _tallied(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n, words): documents with the term; the null term counts all documents and their words."""
    keys, counts, waiting = [], [], 0
    docs = words = 0

    def told() -> pa.RecordBatch:
        key, n = _tallied(np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts]))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([None], pa.int64()), pa.array(key)]), pa.array(np.r_[docs, n]), pa.array(np.r_[words, np.zeros_like(n)])], names=["term", "n", "words"])

    for batch in text_slices(batches):
        hashes, lengths = hashed_terms(as_bytes(batch.column("text")))
        docs, words = docs + len(lengths), words + len(hashes)
        own, at = np.unique(hashes, return_inverse=True)
        if len(own):
            once = np.unique(np.repeat(np.arange(len(lengths)) * len(own), lengths) + at) % len(own)
            keys.append(own)
            counts.append(np.bincount(once, minlength=len(own)))
            waiting += len(own)
        if waiting > _COUNTED:
            yield told()
            keys, counts, waiting, docs, words = [], [], 0, 0, 0
    yield told()


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        texts = as_bytes(batch.column("text"))
        hashes, lengths = hashed_terms(texts)
        own, at = np.unique(hashes, return_inverse=True)
        key, n = np.unique(np.repeat(np.arange(len(lengths)) * max(1, len(own)), lengths) + at, return_counts=True)
        row, term = np.divmod(key, max(1, len(own)))
        tags = np.array([signed(xxhash.xxh64_intdigest(x or b"")) for x in texts], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(row)), pa.array(tags[row]), pa.array(own[term]), pa.array(n)], names=["query_id", "tag", "term", "n"])


class Shard:
    """Documents on their way into an index, as the hashes of their terms; those without a term are left out."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.terms: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: list[int | None], texts: list[bytes | None]) -> None:
        hashes, lengths = hashed_terms(texts)
        self.ids += [i for i, n in zip(ids, lengths.tolist(), strict=True) if n]
        self.terms.append(hashes)
        self.lengths.append(lengths[lengths > 0])
        self.size += sum(len(x) for x in texts if x)


class Queries:
    """A batch of queries: the distinct terms, sorted, and each query's term numbers, weights and threshold."""

    def __init__(self, ids: list, tags: list, terms: np.ndarray, ends: np.ndarray, at: np.ndarray, weight: np.ndarray, threshold: np.ndarray):
        self.ids, self.tags, self.terms = ids, tags, terms
        self.ends, self.at, self.weight, self.threshold = ends, at, weight, threshold

    def __len__(self) -> int:
        return len(self.ends)


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = end - begin
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Index:
    """The inverted index of a shard."""

    def __init__(self, shard: Shard, mean: float):
        ids, lengths = shard.ids, np.concatenate(shard.lengths)
        self.terms, flat = np.unique(np.concatenate(shard.terms), return_inverse=True)
        n_terms, n_docs = len(self.terms), len(ids)
        keys, tf = np.unique(np.repeat(np.arange(n_docs) * n_terms, lengths) + flat, return_counts=True)
        doc, term = np.divmod(keys, n_terms)
        first = np.searchsorted(doc, np.arange(n_docs))
        # documents with the same most frequent term come together, by length
        lead = np.maximum.reduceat(tf * n_terms + (n_terms - 1 - term), first) % n_terms
        order = np.lexsort((lengths, lead))
        place = np.empty(n_docs, dtype=np.int64)
        place[order] = np.arange(n_docs)
        self.ids = np.array([_NO_ID if i is None else i for i in ids], dtype=np.int64)[order]
        norm = K1 * (1 - B + B * lengths / mean) if mean else np.ones(n_docs)
        impact = tf * (K1 + 1) / (tf + norm[doc])
        doc = place[doc]
        df = np.bincount(term, minlength=n_terms)
        frequent = np.argsort(-df, kind="stable")[:MOST_FREQUENT]
        frequent = frequent[df[frequent] > max(1, FREQUENT * n_docs)]
        self.column = np.full(n_terms, -1, dtype=np.int64)
        self.column[frequent] = np.arange(len(frequent))
        # frequent terms: a row of impacts each, and the largest impact of each block
        self.blocks = -(-n_docs // BLOCK_DOCS)
        self.matrix = np.zeros((len(frequent), self.blocks * BLOCK_DOCS), dtype=np.float32)
        inside = self.column[term] >= 0
        self.matrix[self.column[term[inside]], doc[inside]] = impact[inside]
        self.top = self.matrix.reshape(len(frequent), self.blocks, BLOCK_DOCS).max(axis=2) if len(frequent) else np.zeros((0, self.blocks), np.float32)
        self.rows = np.zeros((n_docs, len(frequent)))
        self.rows[doc[inside], self.column[term[inside]]] = impact[inside]
        # rare terms: postings
        doc, impact, term = doc[~inside], impact[~inside], term[~inside]
        at = len(doc).bit_length()
        by_term = np.sort((term * n_docs + doc) << at | np.arange(len(doc))) & ((1 << at) - 1)
        self.doc, self.impact = doc[by_term], impact[by_term]
        self.at = np.searchsorted(term[by_term], np.arange(n_terms + 1))

    def search(self, batch: Queries, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(document numbers, scores) of the best k of each query, as far as they reach its threshold."""
        n, width, docs = len(batch), self.matrix.shape[1], len(self.ids)
        known = np.minimum(np.searchsorted(self.terms, batch.terms), len(self.terms) - 1)
        known[self.terms[known] != batch.terms] = -1
        query = np.repeat(np.arange(n), np.diff(batch.ends, prepend=0))
        term, weight = known[batch.at], batch.weight
        there = term >= 0
        query, term, weight = query[there], term[there], weight[there]
        cuts = np.searchsorted(query, np.arange(n + 1))
        column = self.column[term]
        frequent = column >= 0
        double = np.zeros((n, len(self.matrix)))
        double[query[frequent], column[frequent]] = weight[frequent]
        weights = double.astype(np.float32)
        exact = self._rare(query[~frequent], term[~frequent], weight[~frequent], n, width)
        scores = exact.astype(np.float32)
        used = np.flatnonzero(weights.any(axis=0))  # a batch of one language uses few of the columns
        weights = weights[:, used]
        bounds = scores.reshape(n, self.blocks, BLOCK_DOCS).max(axis=2) + weights @ self.top[used]
        floor = (batch.threshold - _NEAR) * (1 - ERROR)
        chosen = (bounds >= floor[:, None]) & (bounds > 0)
        asking, blocks = np.flatnonzero(chosen.any(axis=1)), np.flatnonzero(chosen.any(axis=0))
        found = [(np.zeros(0, np.int64), np.zeros(0))] * n
        if not len(asking):
            return found
        place = (blocks[:, None] * BLOCK_DOCS + np.arange(BLOCK_DOCS)).ravel()
        place = place[place < docs]
        matrix = self.matrix[used]
        if 4 * len(place) > 3 * docs:  # copying the columns would cost more than it saves
            place = np.arange(docs)
            part = scores[asking, :docs] + weights[asking] @ matrix[:, :docs]
        else:
            part = scores[np.ix_(asking, place)] + weights[asking] @ matrix[:, place]
        low = floor[asking]
        if len(place) > k:  # a shard gives no more than its own k best
            many = np.flatnonzero((part >= low[:, None]).sum(axis=1) > k)
            if len(many):
                kth = np.partition(part[many], len(place) - k, axis=1)[:, len(place) - k]
                low[many] = np.maximum(low[many], kth * (1 - ERROR) - _NEAR)
        q, d = np.divmod(np.flatnonzero(part >= np.maximum(low, _NEAR)[:, None]), max(1, len(place)))
        here = place[d]
        score = exact[asking[q], here]
        for at in range(0, len(q), _PAIRS):
            some = slice(at, at + _PAIRS)
            score[some] += np.einsum("ij,ij->i", double[asking[q[some]]], self.rows[here[some]])
        score = np.round(score, DECIMALS)
        enough = (score >= batch.threshold[asking[q]] - _NEAR) & (score > 0)
        q, here, score = q[enough], here[enough], score[enough]
        order = np.lexsort((self.ids[here], -score, q))
        q, here, score = q[order], here[order], score[order]
        ends = np.searchsorted(q, np.arange(len(asking) + 1)).tolist()
        for own, a, b in zip(asking.tolist(), ends[:-1], ends[1:], strict=True):
            found[own] = (here[a : min(b, a + k)], score[a : min(b, a + k)])
        return found

    def _rare(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, width: int) -> np.ndarray:
        """Sums of the rare terms' contributions: a row for each query, a column for each document."""
        out = np.empty((n, width))
        cuts = np.searchsorted(query, np.arange(0, n + _TOGETHER, _TOGETHER))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):  # few at a time, so that they stay in the cache
            first = i * _TOGETHER
            rows = min(_TOGETHER, n - first)
            begin, end = self.at[term[a:b]], self.at[term[a:b] + 1]
            at, many = _ranges(begin, end), end - begin
            key = np.repeat((query[a:b] - first) * width, many) + self.doc[at]
            out[first : first + rows] = np.bincount(key, self.impact[at] * np.repeat(weight[a:b], many), rows * width).reshape(rows, width)
        return out


_BATCH = "ids array<long>, tags array<long>, terms binary, ends binary, at binary, weight binary, threshold binary"


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each batch of (query_id, tag, terms, weights, threshold): BATCH queries and, but for a longer single one, BATCH_TERMS terms."""
    for whole in batches:
        ends = np.cumsum(pc.list_value_length(whole.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < whole.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(at + BATCH, max(at + 1, int(np.searchsorted(ends, before + BATCH_TERMS, "right"))))
            batch = whole.slice(at, to - at)
            own, numbers = np.unique(batch.column("terms").flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            columns = [
                pa.array([batch.column("query_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([batch.column("tag").to_pylist()], pa.list_(pa.int64())),
                pa.array([own.astype("<i8").tobytes()], pa.binary()),
                pa.array([(ends[at:to] - before).astype("<i4").tobytes()], pa.binary()),
                pa.array([numbers.astype("<i4").tobytes()], pa.binary()),
                pa.array([batch.column("weights").flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()], pa.binary()),
                pa.array([batch.column("threshold").to_numpy(zero_copy_only=False).astype("<f8").tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "tags", "terms", "ends", "at", "weight", "threshold"])
            at = to


def _query_batches(path: str) -> Iterator[Queries]:
    """The batches in the table at path, through pyarrow's file systems."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(path)
    names = sorted(f.path for f in files.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-"))
    for name in names:
        with files.open_input_file(name) as f:
            for rows in pq.ParquetFile(f).iter_batches(1):
                for r in rows.to_pylist():
                    numbers = (np.frombuffer(r[c], kind) for c, kind in (("terms", "<i8"), ("ends", "<i4"), ("at", "<i4"), ("weight", "<f8"), ("threshold", "<f8")))
                    yield Queries(r["ids"], r["tags"], *numbers)


def _search(path: str, mean: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(shard: Shard) -> Iterator[pa.RecordBatch]:
            index = Index(shard, mean)
            shard.terms.clear()
            for batch in _query_batches(path):
                rows: list[list] = [[], [], [], []]
                for query, tag, (docs, scores) in zip(batch.ids, batch.tags, index.search(batch, k), strict=True):
                    if len(docs):
                        rows[0] += [query] * len(docs)
                        rows[1] += [tag] * len(docs)
                        rows[2] += [None if i == _NO_ID else i for i in index.ids[docs].tolist()]
                        rows[3] += scores.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "tag", "doc_id", "score"])

        shard = Shard()
        for batch in text_slices(batches):
            shard.add(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")))
            if len(shard.ids) >= SHARD_DOCS or shard.size >= SHARD_BYTES:
                yield from found(shard)
                shard = Shard()
        if shard.ids:
            yield from found(shard)

    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "tag").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, tag, rank, doc_id, score): the k best documents of each query by BM25.

    docs: doc_id and text; queries: query_id and text, searched with all terms of the whole
    text, each as often as it occurs. Scores are rounded to 6 decimals before they are compared; ties go to the smaller doc_id,
    null last. Null and empty texts match nothing and find nothing. Repeated rows of docs are
    results of their own; queries that repeat id and text are one, and tag, a hash of the
    text, tells apart texts that share an id. Documents that share no term with a query are not results.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = rows.select("text").mapInArrow(_document_counts, "term long, n long, words long").groupBy("term").agg(F.sum("n").alias("df"), F.sum("words").alias("words"))
    asked = stored(queries.select(F.col("query_id").cast("long").alias("query_id"), "text").mapInArrow(_query_terms, "query_id long, tag long, term long, n long").distinct(), "query-terms")
    counts = stored(counts, "frequencies")
    known = counts.join(asked.select("term").distinct(), "term")
    total = counts.where("term IS NULL").first()
    n, words = (total["df"], total["words"]) if total else (0, 0)
    mean = words / n if words else 0.0
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(known, "term").select("query_id", "tag", "term", (F.col("n") * idf).alias("w"), "n")
    # queries that share their most frequent term stand together
    table = weighed.groupBy("query_id", "tag").agg(F.sort_array(F.collect_list(F.struct("n", "term", "w")), False).alias("t"))
    table = stored(table.select("query_id", "tag", F.col("t")[0]["term"].alias("lead"), F.col("t.term").alias("terms"), F.col("t.w").alias("weights")), "queries")

    def run(part: DataFrame, threshold: DataFrame | None) -> DataFrame:
        with_threshold = table.withColumn("threshold", F.lit(0.0))
        if threshold is not None:
            low = threshold.select(F.col("query_id").alias("_query"), F.col("tag").alias("_tag"), "threshold")
            with_threshold = table.join(low, same(F.col("query_id"), F.col("_query")) & (F.col("tag") == F.col("_tag")), "left").select(*table.columns, F.coalesce("threshold", F.lit(0.0)).alias("threshold"))
        path = fresh_path(spark, "searched")
        with_threshold.orderBy("lead", "query_id", "tag").select("query_id", "tag", "terms", "weights", "threshold").mapInArrow(_batched, _BATCH).write.parquet(path)
        return _best(part.mapInArrow(_search(path, mean, k), "query_id long, tag long, doc_id long, score double"), k)

    threshold = None
    for level in range(_rounds(n), 0, -1):
        every = SAMPLE_OF**level
        sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).repartition(max(1, -(-n // (every * SHARD_DOCS))))
        threshold = stored(run(sample, threshold).where(F.col("rank") == k).select("query_id", "tag", F.col("score").alias("threshold")), "thresholds")
    return run(rows, threshold).select("query_id", "tag", "rank", "doc_id", "score")


def _rounds(documents: int) -> int:
    """Rounds of thresholds until a sample is one shard."""
    level = 0
    while documents > SHARD_DOCS * SAMPLE_OF**level:
        level += 1
    return level
