"""Embedding near-dedup by product quantisation.

Equal vectors of one label collapse to a class first (by 128 bits of hashes), so copies are
never compared. Unit vectors go to the nearest of ``lists`` coarse centroids; the residual is
coded by the nearest codeword in each of ``PARTS`` subspaces, and its coding error is kept.

Each class also probes the lists that its neighbours may lie in. Of two neighbours in different
lists, one is at most half the threshold's radius from the plane that bisects the two centroids,
so nothing is missed if both probe that far. In many directions neighbours hardly ever differ by
the whole radius in the one that matters: where ``SIGMAS`` standard deviations of a residual in
that direction, measured on the sample, come to less, that is how far a class probes. In few
directions it is not less, and no neighbour is missed.

In a list, a lookup table of each query gives asymmetric distances to the members; by the
triangle inequality the coding error decides which members can be within the radius, and those
are compared exactly in double precision. A pair is found if either vector probes the other's list.

Lists come in cells, groups of neighbouring centroids. A vector travels once to its own cell,
where it is member and query, and once to every other cell in which it probes a list. A cell's
work is keyed by chunks of members and of queries, so no task holds more than MEMBERS and QUERIES
vectors, and reports counts and a spanning forest, never pairs. There are as many lists as the
square root of the classes, at every size. Centroids and codewords are fitted on about SAMPLE
classes, or PER_LIST a list where that is more; every class is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import discard, stored
from tidewheel.llm.components import components

THRESHOLD = 0.93
#: Classes that the model is fitted on: so many, and so many a list.
SAMPLE, PER_LIST = 16_384, 16
SIGMAS = 3.0
PARTS, WORDS = 8, 256
#: Vectors that a cell should hold, the most members and queries of one piece of a cell, and queries compared at a time.
CELL, MEMBERS, QUERIES, BLOCK = 2048, 4096, 32_768, 512
#: Numbers of a matrix of distances at a time.
_NUMBERS = 1 << 22


@dataclass
class Quantiser:
    centroids: np.ndarray
    #: The cell of each list.
    cells: np.ndarray
    #: For each subspace its dimensions (begin, end) and codewords.
    parts: list[tuple[int, int, np.ndarray]]
    #: Second moments of the residuals, with trace 1.
    spread: np.ndarray


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; large and small components do not overflow."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :], 0.0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, _NUMBERS // len(c))
    return np.concatenate([np.zeros(0, np.int64), *(_squares(x[at : at + step], c).argmin(axis=1) for at in range(0, len(x), step))])


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        order = np.argsort(near, kind="stable")
        full, first = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        centres[full] = sums / np.diff(np.r_[first, len(x)])[:, None]
    return centres


def fit(sample: np.ndarray, lists: int, cells: int = 1, seed: int = 10) -> Quantiser:
    """sample: unit vectors."""
    centroids = _kmeans(sample, min(lists, len(sample)), 8, seed)
    rest = sample - centroids[_nearest(sample, centroids)]
    size = sample.shape[1]
    bounds = np.linspace(0, size, min(PARTS, size) + 1).astype(int).tolist()
    spans = zip(bounds[:-1], bounds[1:], strict=True)
    parts = [(a, b, _kmeans(rest[:, a:b], min(WORDS, len(rest)), 6, seed + a + 1)) for a, b in spans]
    spread = rest.T @ rest
    trace = np.trace(spread)
    spread = spread / trace if trace > 0 else np.eye(size)  # without residuals, nothing is known: the whole radius
    cell = _nearest(centroids, _kmeans(centroids, min(cells, len(centroids)), 8, seed))
    return Quantiser(centroids, cell, parts, spread)


def probes(model: Quantiser, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The home list of each unit vector, and which lists it probes (home among them)."""
    c = model.centroids
    d = _squares(x, c)
    home = d.argmin(axis=1)
    own = c[home]
    turned = c @ model.spread
    quadratic = (turned * c).sum(axis=1)
    along = quadratic[home][:, None] + quadratic[None, :] - 2 * turned[home] @ c.T
    reach = np.minimum(np.sqrt(_squares(own, c)), SIGMAS * np.sqrt(np.maximum(along, 0.0)))
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    return home, d - d[np.arange(len(x)), home][:, None] <= radius * reach + 1e-12


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _lists_of(mask: np.ndarray) -> pa.Array:
    """The columns that are set in each row."""
    row, column = np.nonzero(mask)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(mask) + 1)), pa.int32()), pa.array(column, pa.int32()))


def _assign(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Quantiser = shared.value
        c = model.centroids
        step = max(1, min(2048, _NUMBERS // len(c)))
        member = np.zeros((len(c), int(model.cells.max()) + 1), dtype=np.float32)
        member[np.arange(len(c)), model.cells] = 1
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = unit(_matrix(batch.column("x")))
                home, asked = probes(model, x, threshold)
                rest = x - c[home]
                codes, error = np.zeros((len(x), len(model.parts)), dtype=np.uint8), np.zeros(len(x))
                for i, (a, b, words) in enumerate(model.parts):
                    far = _squares(rest[:, a:b], words)
                    codes[:, i] = far.argmin(axis=1)
                    error += far[np.arange(len(x)), codes[:, i]]
                elsewhere = asked.astype(np.float32) @ member > 0
                elsewhere[np.arange(len(x)), model.cells[home]] = False
                columns = [
                    *(batch.column(name) for name in ("cid", "label", "x", "m")),
                    pa.array(home, pa.int32()),
                    pa.array(model.cells[home], pa.int32()),
                    _lists_of(elsewhere),
                    _lists_of(asked),
                    pa.array([r.tobytes() for r in codes], pa.binary()),
                    pa.array(np.sqrt(error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["cid", "label", "x", "m", "home", "cell", "others", "probes", "codes", "error"])

    return run


class Vectors:
    """Members or queries of a piece of a cell."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        self.cid, self.m, self.home, self.error = (column(c).to_numpy(zero_copy_only=False) for c in ("cid", "m", "home", "error"))
        self.x = unit(_matrix(column("x")))
        self.codes = np.frombuffer(b"".join(column("codes").to_pylist()), np.uint8).reshape(len(self.cid), -1)
        asked = column("probes")
        self.row = np.repeat(np.arange(len(self.cid)), np.diff(asked.offsets.to_numpy()))
        self.probe = asked.flatten().to_numpy(zero_copy_only=False)

    def asks(self, row: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Whether each of some rows probes a list; probes come in order."""
        width = 1 + max(int(self.probe.max(initial=0)), int(lists.max(initial=0)))
        keys = self.row * width + self.probe
        wanted = row * width + lists
        at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        return keys[at] == wanted


def met(model: Quantiser, threshold: float, cell: int, members: Vectors, queries: Vectors) -> Iterator[np.ndarray]:
    """(kind, a, b) rows of a piece of a cell: kind 0 links of class a, kind 1 edges that join the linked."""
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    here = model.cells[queries.probe] == cell
    row, lists = queries.row[here], queries.probe[here]
    order = np.argsort(lists, kind="stable")
    row, lists = row[order], lists[order]
    by_home = np.argsort(members.home, kind="stable")
    homes = members.home[by_home]
    found, linked = np.zeros(len(queries.cid), dtype=np.int64), np.zeros(len(members.cid), dtype=np.int64)
    nodes, node = np.unique(np.concatenate([queries.cid, members.cid]), return_inverse=True)
    asker, owner = node[: len(queries.cid)], node[len(queries.cid) :]
    label = np.arange(len(nodes))
    for number in np.unique(lists).tolist():
        own = by_home[slice(*np.searchsorted(homes, [number, number + 1]))]
        if not len(own):
            continue
        asking = row[slice(*np.searchsorted(lists, [number, number + 1]))]
        codes, error, theirs = members.codes[own].T, members.error[own], members.x[own]
        for at in range(0, len(asking), BLOCK):
            some = asking[at : at + BLOCK]
            rest = queries.x[some] - model.centroids[number]
            about = np.zeros((len(some), len(own)))
            for code, (a, b, words) in zip(codes, model.parts, strict=True):
                about += np.take(_squares(rest[:, a:b], words), code, axis=1)
            near = np.sqrt(about) <= radius + error[None, :] + 1e-9
            q, y = np.nonzero(near & (queries.cid[some][:, None] != members.cid[own][None, :]))
            exact = np.zeros(len(q))
            for i in range(0, len(q), 65536):
                exact[i : i + 65536] = np.einsum("ij,ij->i", queries.x[some[q[i : i + 65536]]], theirs[y[i : i + 65536]])
            close = exact >= threshold
            q, y = some[q[close]], own[y[close]]
            if not len(q):
                continue
            found += np.bincount(q, weights=members.m[y], minlength=len(found)).astype(np.int64)
            unseen = ~members.asks(y, queries.home[q])  # such members do not look where the query lives
            linked += np.bincount(y[unseen], weights=queries.m[q[unseen]], minlength=len(linked)).astype(np.int64)
            was, u, v = label.copy(), asker[q], owner[y]
            while (label[u] != label[v]).any():  # least labels spread over the links
                least = np.minimum(label[u], label[v])
                np.minimum.at(label, u, least)
                np.minimum.at(label, v, least)
            moved = np.flatnonzero(label != was)
            if len(moved):
                edges = np.unique(np.stack([nodes[was[moved]], nodes[label[moved]]], axis=1), axis=0)
                yield np.column_stack([np.ones(len(edges), np.int64), edges])
    for cid, n in ((queries.cid, found), (members.cid, linked)):
        some = np.flatnonzero(n)
        yield np.column_stack([np.zeros(len(some), np.int64), cid[some], n[some]])


def _search(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(key: tuple, held: tuple[list, list]) -> Iterator[pa.RecordBatch]:
            _, cell, _, _, whole = key
            if not held[0] or not (held[1] or whole):
                return
            members = Vectors(held[0])
            # in a cell of one piece the members are queries too
            sides = ([members] if whole else []) + ([Vectors(held[1])] if held[1] else [])
            for queries in sides:
                for rows in met(shared.value, threshold, cell, members, queries):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[:, i], pa.int64()) for i in range(3)], names=["kind", "a", "b"])

        now, held = None, ([], [])
        for batch in batches:
            names = ("label", "cell", "i", "j", "whole", "role")
            keys = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            at = 0
            while at < len(keys):
                to = at
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if keys[at][:5] != now:
                    if now is not None:
                        yield from told(now, held)
                    now, held = keys[at][:5], ([], [])
                held[keys[at][5]].append(batch.slice(at, to - at).select(["cid", "x", "m", "home", "codes", "error", "probes"]))
                at = to
        if now is not None:
            yield from told(now, held)

    return run


_USABLE = """
    label IS NOT NULL AND embedding IS NOT NULL
    AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))
    AND exists(embedding, x -> x <> 0)"""
_KEY = ["label", "h1", "h2"]


def _hashes() -> list[Column]:
    return [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding").alias("h2")]


def _keyed(vectors: DataFrame) -> DataFrame:
    """Usable vectors with the hashes that equal ones share."""
    return vectors.where(_USABLE).select("*", *_hashes())


def _fitted(rows: DataFrame, count: int, labels: int, lists: int | None) -> Quantiser:
    """Fits on the classes in a share of the hashes; copies are dropped before they reach the driver."""
    wanted = lists or max(1, math.isqrt(count))
    share = math.ceil(min(1.0, max(SAMPLE, PER_LIST * wanted) / count) * 1_000_003)
    chosen = rows.where(F.pmod("h1", F.lit(1_000_003)) < share).dropDuplicates(["h1", "h2"])
    sample = chosen.select("embedding").toArrow().column(0).combine_chunks()
    if not len(sample):
        sample = rows.limit(1).select("embedding").toArrow().column(0).combine_chunks()
    x = unit(_matrix(sample))
    return fit(x[np.lexsort(x.T)], wanted, max(1, round(count / (labels * CELL))))


def _found(classes: DataFrame, model: Quantiser, threshold: float) -> DataFrame:
    """(kind, a, b) of classes with equally many components."""
    shared = classes.sparkSession.sparkContext.broadcast(model)  # as many centroids as the root of the classes
    kind = classes.schema["x"].dataType.simpleString()
    schema = f"cid long, label string, x {kind}, m long, home int, cell int, others array<int>, probes array<int>"
    schema += ", codes binary, error double"
    placed = stored(classes.select("cid", "label", "x", "m").mapInArrow(_assign(shared, threshold), schema), "placed")
    own = placed.groupBy("label", "cell").agg(F.count("*").alias("n"))
    away = placed.select("label", F.explode("others").alias("cell")).groupBy("label", "cell").agg(F.count("*").alias("asking"))
    asking = F.col("n") + F.coalesce("asking", F.lit(0))
    pieces = own.join(away, ["label", "cell"], "left")
    pieces = pieces.select("label", "cell", F.ceil(F.col("n") / MEMBERS).alias("ci"), F.ceil(asking / QUERIES).alias("cj"))
    pieces = stored(pieces.withColumn("whole", (F.col("ci") == 1) & (F.col("cj") == 1)), "pieces")
    key, body = ["label", "cell", "i", "j", "whole"], ["cid", "x", "m", "home", "codes", "error", "probes"]
    i, j = (F.pmod(F.xxhash64("cid"), F.col(c)) for c in ("ci", "cj"))
    every_i, every_j = (F.explode(F.expr(f"sequence(0L, {c} - 1)")) for c in ("ci", "cj"))
    members = placed.join(pieces, ["label", "cell"])
    members = members.select("label", "cell", i.alias("i"), every_j.alias("j"), "whole", F.lit(0).alias("role"), *body)
    asked = placed.select("label", F.explode(F.concat("others", F.array("cell"))).alias("to"), "cell", *body)
    asked = asked.join(pieces.withColumnRenamed("cell", "to"), ["label", "to"]).where("to <> cell OR NOT whole")
    queries = asked.select("label", F.col("to").alias("cell"), every_i.alias("i"), j.alias("j"), "whole", F.lit(1).alias("role"), *body)
    met_by = members.union(queries).repartition(*key).sortWithinPartitions(*key, "role")
    return met_by.mapInArrow(_search(shared, threshold), "kind long, a long, b long")


def link(vectors: DataFrame, threshold: float = THRESHOLD, lists: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of vectors (vec_id, embedding, label).

    Vectors with equal labels, not null, and as many components are linked where their cosine
    is found to be threshold or more. Null, empty and zero vectors and those with null or
    non-finite components have no links. n_links counts rows: copies link each other. Rows
    without a vec_id take part; component_id is the least vec_id of the component. A model is
    fitted for each number of components.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    keyed = _keyed(rows)
    sized = keyed.select(F.size("embedding").alias("n"), *_KEY)
    # one row for each number of components
    spread = sized.distinct().groupBy("n").agg(F.count("*").alias("count"), F.count_distinct("label").alias("labels")).collect()
    grouped = keyed.groupBy(*_KEY).agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("embedding").alias("x"))
    numbered = grouped.select(F.monotonically_increasing_id().alias("cid"), *_KEY, "x", F.size("x").alias("n"), "least", "m")
    classes = stored(numbered, "classes")
    found = None
    for r in spread:
        model = _fitted(keyed.where(F.size("embedding") == r["n"]), r["count"], r["labels"], lists)
        part = _found(classes.where(F.col("n") == r["n"]), model, threshold)
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "kind long, a long, b long")
    found = stored(found, "found")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("linked"))
    owner = components(found.where("kind = 1").select("a", "b"))
    least = classes.select("cid", "least")
    named = stored(owner.join(least, owner["node"] == least["cid"]).groupBy("component").agg(F.min("least").alias("first")), "named")
    owned = owner.withColumnRenamed("component", "_component").join(named, F.col("_component") == F.col("component"))
    firsts = stored(owned.select(F.col("node").alias("cid"), "first"), "firsts")
    links = (F.coalesce("linked", F.lit(0)) + F.col("m") - 1).alias("n_links")
    whole = classes.join(counts, "cid", "left").join(firsts, "cid", "left")
    whole = whole.select(*(F.col(c).alias(f"_{c}") for c in _KEY), links, F.least("first", "least").alias("component_id"))
    whole = stored(whole, "whole")
    for old in (classes, found, named, firsts):
        discard(old)
    hashed = rows.select("vec_id", "label", *_hashes(), F.expr(_USABLE).alias("usable"))
    keys = hashed.select("vec_id", *(F.expr(f"if(usable, {c}, null)").alias(c) for c in _KEY))
    joined = keys.join(whole, [F.col(c) == F.col(f"_{c}") for c in _KEY], "left")
    component = F.when(F.col("_h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
