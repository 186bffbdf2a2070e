"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's
probability is the sum, over all ways to cut it into pieces, of the product of the pieces'
probabilities (a forward algorithm); a text's is the product over its words. Piece
probabilities are fitted by expectation-maximisation with the matching forward-backward sums.

Texts are lower-cased and cut into words at everything in ASCII that is no letter; a word
carries the vocabulary's word-start mark. A character that no piece covers is a piece of its
own with a small probability, so every word has a score.

Training reads a bounded sample of the labelled rows (``sample_docs`` per language, chosen by a
hash of doc_id; whole texts). Prediction reads nothing but the text.
"""

from __future__ import annotations

import itertools
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import as_bytes, quoted, resident, slices, text_slices

START = "▁"
#: Characters, start mark included, of the words whose probabilities are multiplied as they are; longer words' are added as logarithms.
SHORT = 24
#: Places of a long word whose segmentations are held at a time, and numbers of a group of long words.
PLACES, NUMBERS = 1024, 1 << 20
#: Short words whose scores a Python worker keeps.
CACHE_WORDS = 250_000
#: Share of probability that a language gives to pieces it was never seen to use.
UNSEEN = 1e-3
#: A text is in no learned language if its log-probability a character is lower than the training texts' by
#: FAR, and by SLACK / sqrt(characters) more, as short texts scatter.
FAR, SLACK = 2.5, 12.0

_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_LETTER = re.compile(r"[A-Za-z]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_of(path: str) -> list[str]:
    """Lower-case pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            kept.setdefault(piece.lower(), None)
    return list(kept)


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    #: len(pieces) + 1 rows, one column per language; the last row is for uncovered characters.
    p: np.ndarray
    #: Of a calibrated model: log-probability a character of each language's training texts.
    typical: np.ndarray | None = None


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(_BLANK).split()


def _size(word: bytes) -> int:
    """Characters of a word, its start mark included."""
    return len(word.decode("utf-8", "replace")) + 1


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text))


class Trie:
    """Pieces by prefix: a hash table of (node, character) steps that arrays of places walk together."""

    def __init__(self, pieces: list[str]):
        steps: dict[tuple[int, int], int] = {}
        self.ids, self.depth = len(pieces), max(map(len, pieces), default=1)
        ends = {}
        for i, piece in enumerate(pieces):
            node = 0
            for c in piece:
                node = steps.setdefault((node, ord(c)), len(steps) + 1)
            ends[node] = i
        self.end = np.full(len(steps) + 1, -1, dtype=np.int32)
        self.end[list(ends)] = list(ends.values())
        self.bits = max(4, (4 * len(steps)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.next = np.zeros(1 << self.bits, dtype=np.int32)
        keys = np.array([n << 21 | c for n, c in steps], dtype=np.int64)
        slots = self._slot(keys).tolist()
        for key, slot, node in zip(keys.tolist(), slots, steps.values(), strict=True):
            while self.keys[slot] != -1:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.next[slot] = key, node

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The nodes after one more character, -1 where no piece goes on so."""
        keys = nodes.astype(np.int64) << 21 | chars
        slot, out = self._slot(keys), np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            here = self.keys[slot[todo]]
            hit = here == keys[todo]
            out[todo[hit]] = self.next[slot[todo[hit]]]
            todo = todo[~hit & (here != -1)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out


def _edges(texts: list[str], trie: Trie, begins: int) -> tuple[np.ndarray, np.ndarray]:
    """(end, begin, text, piece) of each piece at each of the first ``begins`` places of each text, by end and text; where each end starts."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    text = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)
    room = size[text] - place
    at = np.flatnonzero(place < begins)
    node, found, n = np.zeros(len(at), dtype=np.int64), [], 0
    while len(at):
        n += 1
        node = trie.step(node, chars[at + n - 1])
        ids = np.where(node >= 0, trie.end[node], -1)
        if n == 1:
            ids = np.where(ids < 0, trie.ids, ids)
        hit = ids >= 0
        here = at[hit]
        found.append(np.stack([place[here] + n, place[here], text[here], ids[hit]], axis=1))
        on = (node >= 0) & (room[at] > n)
        at, node = at[on], node[on]
    e = np.concatenate(found) if found else np.zeros((0, 4), dtype=np.int64)
    e = e[np.argsort(e[:, 0] * max(1, len(texts)) + e[:, 2], kind="stable")]
    last = int(e[-1, 0]) if len(e) else 0
    return e, np.searchsorted(e[:, 0], np.arange(last + 2))


def _log_sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Logarithms of the sums of exp of runs of rows."""
    top = np.maximum.reduceat(x, starts, axis=0)
    top[~np.isfinite(top)] = 0.0
    with np.errstate(divide="ignore"):
        return top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.r_[starts, len(x)]), axis=0)), starts, axis=0))


def _runs(column: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, column[1:] != column[:-1]])


class _Long:
    """Some words, longest first, whose segmentations are walked PLACES places at a time, in logarithms."""

    def __init__(self, words: list[str], trie: Trie, p: np.ndarray):
        self.words, self.trie, self.log = words, trie, np.log(p)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.shape = (PLACES + trie.depth + 1, len(words), p.shape[1])

    def _part(self, first: int) -> tuple[np.ndarray, np.ndarray]:
        last = first + PLACES + self.trie.depth
        going = int((self.size > first).sum())
        return _edges([w[first:last] for w in self.words[:going]], self.trie, PLACES)

    def _ahead(self, state: np.ndarray, edges: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Log-probability of all ways to reach each place, from what the places before this part give."""
        alpha = np.full(self.shape, -np.inf)
        alpha[: len(state)] = state
        for j in range(1, len(cuts) - 1):
            e = edges[cuts[j] : cuts[j + 1]]
            if len(e):
                starts = _runs(e[:, 2])
                more = _log_sums(alpha[e[:, 1], e[:, 2]] + self.log[e[:, 3]], starts)
                which = e[starts, 2]
                alpha[j, which] = np.logaddexp(alpha[j, which], more)
        return alpha

    def forward(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The words' log-probabilities, and what reaches the beginning of each part."""
        state = np.full((self.trie.depth + 1, *self.shape[1:]), -np.inf)
        state[0] = 0.0
        total, states = np.zeros(self.shape[1:]), []
        for first in range(0, int(self.size.max()), PLACES):
            states.append(state)
            alpha = self._ahead(state, *self._part(first))
            ends = np.flatnonzero((self.size > first) & (self.size <= first + PLACES))
            total[ends] = alpha[self.size[ends] - first, ends]
            state = alpha[PLACES:]
        return total, states

    def expected(self, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece when word w occurs counts[w, language] times."""
        total, states = self.forward()
        uses = np.zeros_like(self.log)
        beta = np.full(self.shape, -np.inf)
        for number in range(len(states) - 1, -1, -1):
            first = number * PLACES
            edges, cuts = self._part(first)
            alpha = self._ahead(states[number], edges, cuts)
            after = beta[: self.trie.depth + 1].copy()
            beta[:] = -np.inf
            beta[PLACES:] = after
            ends = np.flatnonzero((self.size > first) & (self.size <= first + PLACES))
            beta[self.size[ends] - first, ends] = 0.0
            back = edges[np.argsort(edges[:, 1] * len(self.words) + edges[:, 2], kind="stable")]
            for j in range(min(PLACES, int(back[-1, 1]) + 1) - 1, -1, -1):  # a place is reached back from all its ends
                e = back[slice(*np.searchsorted(back[:, 1], [j, j + 1]))]
                starts = _runs(e[:, 2])
                flow = beta[e[:, 0], e[:, 2]] + self.log[e[:, 3]]
                which = e[starts, 2]
                beta[j, which] = np.logaddexp(beta[j, which], _log_sums(flow, starts))
                with np.errstate(invalid="ignore"):
                    share = np.exp(alpha[j, e[:, 2]] + flow - total[e[:, 2]])
                np.add.at(uses, e[:, 3], np.nan_to_num(share) * counts[e[:, 2]])
        return uses


class Lattice:
    """All segmentations of many words at once: an edge for each piece at each place.

    The short words' probabilities cannot underflow and are sums of products; long words, of any
    length, are summed in logarithms. Both are the sum over all segmentations of the whole word.
    """

    def __init__(self, words: list[bytes], trie: Trie):
        texts = b" ".join(words).decode("utf-8", "replace").split(" ") if words else []
        self.trie, self.marked = trie, [START + x for x in texts]
        self.size = np.fromiter(map(len, self.marked), np.int64, len(texts))
        self.short = np.flatnonzero(self.size <= SHORT)
        self.edges, self.cuts = _edges([self.marked[i] for i in self.short.tolist()], trie, SHORT)

    def _longs(self, p: np.ndarray) -> Iterator[tuple[np.ndarray, _Long]]:
        """Groups of long words of like length."""
        where = np.flatnonzero(self.size > SHORT)
        where = where[np.argsort(-self.size[where], kind="stable")]
        step = max(1, NUMBERS // ((PLACES + self.trie.depth + 1) * max(1, p.shape[1])))
        for at in range(0, len(where), step):
            some = where[at : at + step]
            yield some, _Long([self.marked[i] for i in some.tolist()], self.trie, p)

    def _forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[place, short word, language]: probability of all ways to reach a place."""
        alpha = np.zeros((SHORT + 1, len(self.short), p.shape[1]))
        alpha[0] = 1.0
        for j in range(1, len(self.cuts) - 1):
            e = self.edges[self.cuts[j] : self.cuts[j + 1]]
            if len(e):  # edges of one end place come word by word
                starts = _runs(e[:, 2])
                alpha[j, e[starts, 2]] = np.add.reduceat(alpha[e[:, 1], e[:, 2]] * p[e[:, 3]], starts, axis=0)
        return alpha

    def log_scores(self, p: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability in each language; no p is below 1e-12."""
        out = np.zeros((len(self.marked), p.shape[1]))
        out[self.short] = np.log(self._forward(p)[self.size[self.short], np.arange(len(self.short))])
        for where, words in self._longs(p):
            out[where] = words.forward()[0]
        return out

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece when word w occurs counts[w, language] times."""
        alpha = self._forward(p)
        every, size = np.arange(len(self.short)), self.size[self.short]
        beta = np.zeros_like(alpha)
        beta[size, every] = 1.0
        weight = counts[self.short] / alpha[size, every]
        uses = np.zeros_like(p)
        for j in range(len(self.cuts) - 2, 0, -1):
            e = self.edges[self.cuts[j] : self.cuts[j + 1]]
            if len(e):
                flow = p[e[:, 3]] * beta[j, e[:, 2]]
                np.add.at(uses, e[:, 3], alpha[e[:, 1], e[:, 2]] * flow * weight[e[:, 2]])
                np.add.at(beta, (e[:, 1], e[:, 2]), flow)
        for where, words in self._longs(p):
            uses += words.expected(counts[where])
        return uses


def _smoothed(uses: np.ndarray) -> np.ndarray:
    share = uses / np.maximum(uses.sum(axis=0), 1e-300)
    p = (1 - UNSEEN) * share + UNSEEN / len(uses)
    p[-1] = np.minimum(p[-1], 1e-6)
    return p


def fit(counts: dict[bytes, np.ndarray], languages: list[str], pieces: list[str], rounds: int = 4, block: int = 4096, calibrate: bool = False) -> Model:
    """Piece probabilities from each word's count in each language; ``calibrate`` also sets what is typical."""
    trie = Trie(pieces)
    words = sorted(counts)
    table = np.array([counts[w] for w in words], dtype=float).reshape(len(words), len(languages))
    p = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
    for _ in range(rounds):
        uses = np.zeros_like(p)
        for at in range(0, len(words), block):
            uses += Lattice(words[at : at + block], trie).expected(p, table[at : at + block])
        p = _smoothed(uses)
    if not calibrate:
        return Model(languages, pieces, p)
    logs = np.zeros(len(languages))
    for at in range(0, len(words), block):
        logs += (Lattice(words[at : at + block], trie).log_scores(p) * table[at : at + block]).sum(axis=0)
    chars = np.array([_size(w) for w in words], dtype=float) @ table
    # a language whose training texts have no words rules nothing out
    return Model(languages, pieces, p, np.where(chars > 0, logs / np.maximum(chars, 1), -np.inf))


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: text, lang and doc_id not null, crc32(doc_id as text) mod 5 not 0."""
    return docs.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(~held_out())


def held_out():
    """True where crc32 of doc_id as text leaves 0 when divided by 5, and for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts: dict[tuple[str, bytes], int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True):
            for word in words_of(text):
                counts[lang, word] = counts.get((lang, word), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])


def train(docs: DataFrame, sample_docs: int = 400, vocabulary: str | None = None, rounds: int = 4, calibrate: bool = False) -> Model:
    """Fits a model on about sample_docs whole documents a language, chosen by a hash of doc_id.

    sample_docs bounds what reaches the driver. The languages are the distinct lang values.
    """
    rows = training_rows(docs)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    pieces = pieces_of(vocabulary or default_vocabulary())
    if not languages:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (place < min(1.0, sample_docs / n)))
    found = rows.where(chosen).mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    at = {x: i for i, x in enumerate(languages)}
    counts: dict[bytes, np.ndarray] = {}
    for r in found.toLocalIterator():
        counts.setdefault(bytes(r["word"]), np.zeros(len(languages)))[at[r["lang"]]] = r["n"]
    return fit(counts, languages, pieces, rounds, calibrate=calibrate)


class Scorer:
    """Scores texts; keeps the words it has met, up to CACHE_WORDS."""

    def __init__(self, model: Model):
        self.trie = Trie(model.pieces)
        self.languages, self.p, self.typical = model.languages, model.p, model.typical
        self.at: dict[bytes, int] = {}
        self.logs = np.zeros((1024, len(self.languages) + 1))  # the last column holds characters

    def _scored(self, words: list[bytes], block: int = 2048) -> np.ndarray:
        """Logs of some words and, in the last column, their characters."""
        out = np.zeros((len(words), len(self.languages) + 1))
        for i in range(0, len(words), block):
            out[i : i + block, :-1] = Lattice(words[i : i + block], self.trie).log_scores(self.p)
        out[:, -1] = [_size(w) for w in words]
        return out

    def _learn(self, words: list[bytes]) -> None:
        n = len(self.at)
        while len(self.logs) < n + len(words):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        self.logs[n : n + len(words)] = self._scored(words)
        self.at.update(zip(words, range(n, n + len(words)), strict=True))

    def logs_of(self, text: bytes) -> tuple[np.ndarray, int]:
        """Log-probability of the text in each language, and its words."""
        totals, n = self._totals([text])
        return totals[0, :-1], int(n[0])

    def _totals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's log-probabilities with its characters at the end, and its words."""
        split = [words_of(text) for text in texts]
        if len(self.at) > CACHE_WORDS:  # the oldest third stays: frequent words come early
            self.at = dict(itertools.islice(self.at.items(), CACHE_WORDS // 3))
        new = set().union(*split).difference(self.at)
        long = [w for w in new if len(w) > 4 * SHORT]  # four bytes a character at most; these hardly come again
        self._learn(list(new.difference(long)))
        self._learn(long)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        rows = np.fromiter(map(self.at.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(counts.sum()))
        for word in long:
            del self.at[word]
        out = np.zeros((len(texts), self.logs.shape[1]))
        some = np.flatnonzero(counts)
        if len(some):
            starts = (np.cumsum(counts) - counts)[some]
            out[some] = np.add.reduceat(self.logs[rows], starts, axis=0)
        return out, counts

    def predict(self, text: bytes | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        said: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.languages:
            return said
        which = [i for i, x in enumerate(texts) if x is not None and has_letter(x.decode("utf-8", "replace"))]
        totals, _ = self._totals([texts[i] for i in which])
        for i, (*logs, chars) in zip(which, totals.tolist(), strict=True):
            top = max(logs)
            best = logs.index(top)
            if self.typical is not None and top < chars * (self.typical[best] - FAR - SLACK / math.sqrt(max(chars, 1.0))):
                continue
            said[i] = self.languages[best], 1.0 / sum(math.exp(x - top) for x in logs)
        return said


def _predictor(spark: SparkSession, model: Model, keep: list[str], names: tuple[str, str]):
    """A mapInArrow function: the columns in keep, then the language and score of the column text."""
    shared = spark.sparkContext.broadcast(model)  # vocabulary x languages
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = resident(("scorer", key), lambda: Scorer(shared.value))
        for batch in text_slices(batches):
            said = scorer.predict_all(as_bytes(batch.column("text")))
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], names=[*keep, *names])

    return run


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns in keep, then lang_pred and score (under ``names``) of every row of docs.

    lang_pred is a learned language, or ``und`` with score 0 if text is null or has no letter
    (or nothing could be learned), or if a calibrated model finds it too unlikely in every language. score is the language's posterior under equal priors.
    Every row is scored by itself: repeated rows, ties and null ids change nothing; on a tie
    the first language in code-point order is returned. A text of any length is read whole.
    """
    fields = [*docs.select(*map(quoted, keep)).schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    rows = docs.select(*map(quoted, dict.fromkeys([*keep, "text"])))
    return rows.mapInArrow(_predictor(docs.sparkSession, model, list(keep), names), T.StructType(fields))
