"""Token ids of whole texts by a tokenizers file, with the ids of each word kept in the worker.

The ids of a word do not depend on its neighbours when the tokenizer cuts the text at that
place whatever surrounds it. Two kinds of tokenizer file are known to do so: byte-level ones
without a normalizer, which cut before a single space and around a single line break between
other characters; and those whose normalizer turns white space into a space that the
pre-tokenizer then drops. For these, words are cut into units whose ids do not depend on each
other either (a line break, the word, marks behind a run of letters); each distinct unit is encoded once by
the library, runs of letters by its model alone, and the ids are joined a batch of texts at a time. Any other file,
and any text with white space that is not as plain as that, goes through the library whole. Both ways give the same ids.
"""

from __future__ import annotations

import itertools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidewheel.llm.common import resident

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units whose ids a Python worker keeps unless more are asked for: some 200 bytes each.
CACHE = 600_000
#: Rows and bytes of texts that are best encoded at a time: each distinct unit is looked up once.
BATCH = (1024, 1 << 21)
#: Marks that never join the letters before them: ASCII punctuation but the apostrophe of contractions.
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Letters below U+0250, which stay letters in composed and in lower case (U+0130 does not).
_RUN = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: The same with what stands before a word in _units.
_RUN_UNIT = r"\A[ \n]?" + _RUN.pattern + r"\z"
#: Bytes as byte-level models write them.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)).difference(_SHOWN)))}
#: White space other than the space and the line break; it goes through the library with its text.
_ODD_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _plain(text: str) -> bool:
    """Whether all white space is single spaces and line breaks between other characters."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    odd = _ODD_SPACES if text.isascii() else _ODD_SPACES + _WIDE_SPACES
    return not any(map(text.__contains__, odd))


def _joined(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of ids with these starts and sizes, one after the other."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """The process's encoder for a file: a Python worker keeps its units from task to task."""
    return resident(("encoder", path, cache), lambda: Encoder(path, cache))


class Encoder:
    """encode(text) gives little-endian unsigned 32-bit ids; special tokens' strings are ordinary text."""

    def __init__(self, path: str, cache: int = CACHE):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        state = json.loads(self.tokenizer.to_str())
        self.kind = _kind(state)
        self.model = self.tokenizer.model if _byte_level(state) else None
        self.most = cache
        #: Units by number; unit i has the ids from bounds[i] to bounds[i + 1].
        self.units: dict[str, int] = {}
        self.ids, self.bounds = array("I"), array("q", [0])

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _trim(self) -> None:
        """If there are too many units, the oldest third stays: frequent ones come early."""
        if len(self.units) > self.most:
            n = self.most // 3
            self.units = dict(itertools.islice(self.units.items(), n))
            self.bounds = self.bounds[: n + 1]
            self.ids = self.ids[: self.bounds[-1]]

    def _learn(self, units: list[str]) -> None:
        """Adds units that are not there yet. A run of letters is one unit of the pre-tokenizer, so the model alone has its ids."""
        found: list[list[int] | None] = [None] * len(units)
        others = []
        for i, unit in enumerate(units):
            run = unit[1:] if unit[:1] == " " else unit
            if self.model is None or not (run.isascii() and run.isalpha() or _RUN.fullmatch(run)):
                others.append(i)
                continue
            unit = unit.lower() if self.kind == "dropped" else unit
            text = unit.replace(" ", _BYTES[32]) if unit.isascii() else unit.encode().decode("latin-1").translate(_BYTES)
            found[i] = [token.id for token in self.model.tokenize(text)]
        for i, x in zip(others, self.tokenizer.encode_batch_fast([units[i] for i in others], add_special_tokens=False), strict=True):
            found[i] = x.ids
        first, end = len(self.units), self.bounds[-1]
        self.units.update(zip(units, range(first, first + len(units)), strict=True))
        self.ids.extend(itertools.chain.from_iterable(found))
        self.bounds.extend(itertools.islice(itertools.accumulate(map(len, found), initial=end), 1, None))

    def _units(self, words: pa.LargeStringArray) -> tuple[np.ndarray, list[str]]:
        """The three units of each word (its line break, itself, marks behind a run of letters), and the distinct units."""
        bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        starts, sizes = bounds[:-1], np.diff(bounds)
        bare = pc.ascii_rtrim(words, characters=_MARKS)
        run = pc.match_substring_regex(bare, _RUN_UNIT).to_numpy(zero_copy_only=False)
        head = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        body = np.where(run, pc.binary_length(bare).to_numpy(), sizes)
        cuts = np.append(np.stack([starts, starts + head, starts + body], axis=1).ravel(), bounds[-1])
        units = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), words.buffers()[2]).dictionary_encode()
        return units.indices.to_numpy().reshape(-1, 3), units.dictionary.to_numpy(zero_copy_only=False).tolist()

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        if self.kind == "dropped":
            known = [(text.lower() if text.isascii() else text).replace("\n", " ") if text else "" for text in texts]
            split = pc.split_pattern(pa.array(known, pa.large_string()), " ")
        elif self.kind == "leading":
            # words keep the space or the line break before them
            known = [text.replace(" ", "\x1f ").replace("\n", "\x1f\n") if text and _plain(text) else "" for text in texts]
            split = pc.split_pattern(pa.array(known, pa.large_string()), "\x1f")
        else:
            return [self._whole(text) if text else b"" for text in texts]
        if not texts:
            return []
        self._trim()
        words = split.flatten().dictionary_encode()
        places, units = self._units(words.dictionary)
        numbers = np.fromiter(map(self.units.get, units, itertools.repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(numbers < 0)
        numbers[new] = np.arange(len(self.units), len(self.units) + len(new))
        self._learn([units[i] for i in new.tolist()])
        numbers = numbers[places]
        bounds = np.frombuffer(self.bounds, np.int64)
        sizes = bounds[numbers + 1] - bounds[numbers]
        ids = _joined(np.frombuffer(self.ids, np.uint32), bounds[numbers].ravel(), sizes.ravel())
        sizes = sizes.sum(axis=1)
        starts = np.cumsum(sizes) - sizes
        order = words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[order])])
        cuts = (ends[split.offsets.to_numpy()] * 4).tolist()
        body = _joined(ids, starts[order], sizes[order]).tobytes()
        return [body[a:b] if plain or not text else self._whole(text) for text, plain, a, b in zip(texts, known, cuts[:-1], cuts[1:], strict=True)]


def _byte_level(state: dict) -> bool:
    """Whether a run of letters reaches the model as its bytes and nothing else."""
    pre = state.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers") or [pre]
    return steps[-1].get("type") == "ByteLevel" and not steps[-1].get("add_prefix_space") and len(steps) <= 2


def _kind(state: dict) -> str:
    before, pre = state.get("normalizer"), state.get("pre_tokenizer") or {}
    if before is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "leading"
    steps = (before or {}).get("normalizers", [])
    spaces = any(x.get("type") == "Replace" and x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " " for x in steps)
    cut = (pre.get("pretokenizers") or [{}])[0]
    drops = cut.get("type") == "Split" and cut.get("behavior") == "Removed" and cut.get("invert") and _no_space(str((cut.get("pattern") or {}).get("Regex")))
    plain = {x.get("type") for x in steps} <= {"NFC", "Replace", "Lowercase"}
    return "dropped" if spaces and drops and plain else "whole"


def _no_space(pattern: str) -> bool:
    """Whether no match of a pre-tokenizer's pattern can hold a space: alternatives of letters, numbers and non-space classes."""
    return bool(re.fullmatch(r"(?:'[a-z]+\||\[\\p\{[LN]\}\]\+?\|)*\[\^\\s\\p\{L\}\\p\{N\}\]\+", pattern))
