"""Token ids of whole texts by ``word_bpe_49k.json``, with one library call per distinct word.

That tokenizer cuts at white space before anything else, and between letters or digits and symbols, so
the ids of a text are the ids of its parts in turn. Each batch is cut to parts and its distinct parts are
found by Arrow. Plain Latin parts go straight to the library's model; all others pass through the whole
library pipeline. Each worker keeps the ids of the parts it has met, up to ``limit`` of them, and starts
again beyond that; the ids do not depend on it.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: str.split() cuts at these four, the tokenizer does not; such a text is encoded in one piece.
_ODD = "[\x1c-\x1f]"
#: A capital whose mark may compose with the small letter only, and the one capital whose small form ends
#: in a mark: where they occur, only white space cuts.
_MARKED = r"[A-Z]\p{M}|\x{0130}"
#: A place where the tokenizer always cuts; marks may still compose with what stands before them.
_EDGE = r"([\p{L}\p{N}])([^\s\p{L}\p{N}\p{M}])"
#: Words of printable ASCII and accented Latin letters in composed form: only lower case and the
#: tokenizer's own cut to pieces are left to do before its model sees them.
_ACCENTED = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = re.compile(f"[\x21-\x7e{_ACCENTED}]+")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_ACCENTED}]+|[0-9]|[^a-z0-9{_ACCENTED}]+")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others follow from 256 on in ascending order.
    """
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(seen)]
    return [chr(b) if b in set(seen) else chr(256 + other.index(b)) for b in range(256)]


_LETTERS = byte_letters()
_HELD: dict[tuple[str, int], WordEncoder] = {}


class WordEncoder:
    def __init__(self, path: str, limit: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.limit = limit
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.first = np.empty(1 << 14, np.int64)
        self.size = np.empty(1 << 14, np.int64)
        self.words = self.used = 0

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None:
            spelt = piece if piece.isascii() else "".join([_LETTERS[b] for b in piece.encode()])
            ids = self.pieces[piece] = tuple([t.id for t in self.model.tokenize(spelt)])
        return ids

    def _ids(self, words: list[str]) -> list[tuple[int, ...]]:
        out, odd, piece, model = [], [], self._piece, self.model.tokenize
        for n, word in enumerate(words):
            if word.isascii() and word.isalpha():
                out.append([t.id for t in model(word.lower())])
            elif _PLAIN.fullmatch(word):
                parts = _PIECES.findall(word.lower())
                out.append(piece(parts[0]) if len(parts) == 1 else [i for x in parts for i in piece(x)])
            else:
                out.append(())
                odd.append(n)
        for n, e in zip(odd, self.tokenizer.encode_batch_fast([words[n] for n in odd], add_special_tokens=False), strict=True):
            out[n] = e.ids
        return out

    def _learn(self, new: list[str]) -> None:
        self.numbers.update(zip(new, range(self.words, self.words + len(new)), strict=True))
        for low in range(0, len(new), 5000):
            part = self._ids(new[low : low + 5000])
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            total = int(sizes.sum())
            while self.words + len(part) > len(self.first):
                self.first, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.first, self.size))
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            self.flat[self.used : self.used + total] = np.fromiter((i for ids in part for i in ids), np.uint32, total)
            at = slice(self.words, self.words + len(part))
            self.size[at] = sizes
            self.first[at] = self.used + np.cumsum(sizes) - sizes
            self.words += len(part)
            self.used += total

    def word_numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The parts of all texts as numbers into ``first`` and ``size``, and how many each text has."""
        if pc.any(pc.match_substring_regex(texts, _ODD)).as_py():
            odd = pc.match_substring_regex(texts, _ODD).to_pylist()
            split = pa.array([[t] if o else t.split() for t, o in zip(texts.to_pylist(), odd, strict=True)], pa.list_(pa.string()))
        else:
            if not pc.any(pc.match_substring_regex(texts, _MARKED)).as_py():
                texts = pc.ascii_lower(pc.replace_substring_regex(texts, _EDGE, r"\1 \2"))
            split = pc.utf8_split_whitespace(texts)
        parts = split.flatten().dictionary_encode()
        return self.part_numbers(parts), np.diff(split.offsets.to_numpy()).astype(np.int64)

    def part_numbers(self, parts: pa.DictionaryArray) -> np.ndarray:
        """Parts as numbers into ``first`` and ``size``. Parts are texts between places where the tokenizer cuts;
        white space at an end of a text leaves an empty part there, which has no ids."""
        if self.words > self.limit or self.used > 16 * self.limit:
            self.clear()
        if len(self.pieces) > self.limit:
            self.pieces = {}
        words = parts.dictionary.to_pylist()
        self._learn([w for w in words if w not in self.numbers])
        number = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        return number[parts.indices.to_numpy()]

    def spell(self, found: np.ndarray) -> np.ndarray:
        """The ids of numbered words in turn."""
        size = self.size[found]
        shift = np.repeat(self.first[found] - (np.cumsum(size) - size), size)
        return self.flat[shift + np.arange(len(shift))]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, ``end`` after each text, and the number of ids of each text with it."""
        return self.joined(*self.word_numbers(texts), end)

    def joined(self, found: np.ndarray, words: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of texts of so many numbered parts, ``end`` after each."""
        ids = self.spell(found)
        upto = np.concatenate([[0], np.cumsum(self.size[found])])[np.cumsum(words)]
        sizes = np.diff(upto, prepend=0)
        return np.insert(ids, upto, end), sizes + 1


def encoder(path: str, limit: int = 250_000) -> WordEncoder:
    """The encoder of this worker for a tokenizer file."""
    if (path, limit) not in _HELD:
        _HELD[path, limit] = WordEncoder(path, limit)
    return _HELD[path, limit]


def forget() -> None:
    """Give back what this worker's encoders hold, for tasks that need no more of them."""
    _HELD.clear()


def portions(texts: pa.Array, size: int = 8_000_000):
    """Ranges of rows with about ``size`` bytes of text each (one row at least)."""
    held = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(texts):
        high = int(np.searchsorted(held, (held[low - 1] if low else 0) + size, "right"))
        high = max(high, low + 1)
        yield low, high
        low = high


def filled(texts: pa.Array) -> pa.Array:
    """Texts with nulls as empty ones."""
    return pc.fill_null(texts, "")
