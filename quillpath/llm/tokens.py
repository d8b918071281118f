"""Token ids of whole texts by public tokenizers, with a memory of the pieces met before.

A tokenizer that never joins text across a cut gives the same ids for a text as for its pieces one
after another. Cuts lie before runs of white space, and between an ASCII letter and an ASCII sign
(no apostrophe, which begins contractions). Equal pieces of a slice of rows are found by hashes with array
operations and compared byte by byte; each is looked up once by its bytes, and only pieces not met
before go to the tokenizer. A text with the string of a special token is one piece.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillpath.llm.common import ASCII_SPACE, distinct_ranges, row_slices, utf8

_SPACE = ~ASCII_SPACE
_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
_SIGN = np.array([33 <= b < 127 and not chr(b).isalnum() and b != 39 for b in range(256)])
#: White space outside ASCII, as Unicode has it, by its bytes as a number.
_WIDE_SPACE = np.array([int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
#: A word of Latin letters, perhaps after a space: the tokenizers here do not cut it further.
_PLAIN = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)")
#: Pieces that a worker remembers (about 250 bytes each), and the longest of them in bytes.
_REMEMBERED, _LONGEST = 400_000, 48
#: Bytes of text that are looked up at once.
_SLICE = 1 << 20


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """ids of texts as little-endian integers of 16 bits, or of 32 for a vocabulary over 65,536."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # of the file's parts only the small ones are read again: a vocabulary as Python objects would double a worker's memory
        part = lambda x: json.loads(x.__getstate__()) if x is not None else {}
        byte_level = part(self.tokenizer.pre_tokenizer) == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.lower = any(x.get("type") == "Replace" for x in part(self.tokenizer.normalizer).get("normalizers", []))
        if not byte_level and not self.lower:
            raise ValueError(f"{path}: neither keeps spaces before words nor drops white space")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = "H" if self.tokenizer.get_vocab_size() <= 65536 else "I"
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.letters = _byte_letters()
        self.words = self.tokenizer.model
        self.memory: dict[bytes, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learned(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece. Plain words go to the tokenizer's model at once, all else to the tokenizer."""
        match, tokenize, code, lower, letters = _PLAIN.fullmatch, self.words.tokenize, self.code, self.lower, self.letters
        out: list[bytes] = []
        other: list[int] = []
        for p in pieces:
            m = match(p)
            if not m:
                other.append(len(out))
                out.append(b"")
                continue
            space, word = m.groups()
            if lower:
                word = word.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(letters)
            if space and not lower:
                word = letters[32] + word
            out.append(array(code, [t.id for t in tokenize(word)]).tobytes())
        for k, ids in zip(other, self._encoded([pieces[k] for k in other]), strict=True):
            out[k] = ids
        return out

    def _bounds(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start and end. Rows of whole are not cut."""
        space = _SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        runs = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        wide = runs[data[runs - 1] >= 128]
        if len(wide):  # a run that goes on from wider white space is no start
            one, two, three = (data[np.maximum(wide - k, 0)].astype(np.int64) for k in (1, 2, 3))
            pair = two << 8 | one
            runs = np.setdiff1d(runs, wide[np.isin(pair, _WIDE_SPACE) | np.isin(three << 16 | pair, _WIDE_SPACE)], assume_unique=True)
        cut[runs] = True
        cut[1:-1] |= _SIGN[data[1:]] & _LETTER[data[:-1]]
        for r in np.flatnonzero(whole):
            cut[offsets[r] : offsets[r + 1]] = False
        cut[offsets] = True
        cut[-1] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        if self.lower:  # white space has no ids
            inner = np.flatnonzero(~space)
            at = np.searchsorted(inner, starts)
            starts = np.minimum(np.append(inner, len(data))[at], ends)
            keep = starts < ends
            starts, ends = starts[keep], ends[keep]
        return starts, ends

    def _slice(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        starts, ends = self._bounds(data, offsets, whole)
        codes, first = distinct_ranges(data, starts, ends)
        memory, text = self.memory, data.tobytes()
        if len(memory) > _REMEMBERED:
            memory.clear()
        pieces = [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        new = [p for p in pieces if p not in memory]
        memory.update(zip(new, self._learned([p.decode() for p in new]), strict=True))
        found = [memory[p] for p in pieces]
        for p in new:
            if len(p) > _LONGEST:
                del memory[p]
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(found), self.dtype)
        each = size[codes]
        before = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat((np.cumsum(size) - size)[codes] - before[:-1], each) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts, offsets)]

    def rows(self, column: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For slices of the rows (a null text is empty): the first row, the ids of all rows end to end,
        and the rows' offsets in them. With end_id, it follows the ids of each row."""
        whole = np.zeros(len(column), bool)
        for s in self.special:
            whole |= pc.match_substring(column, s).fill_null(False).to_numpy(zero_copy_only=False)
        data, offsets = utf8(column)
        for a, b in row_slices(offsets, _SLICE):
            ids, bounds = self._slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], whole[a:b])
            if end_id is not None:
                inner = np.ones(len(ids) + b - a, bool)
                bounds = bounds + np.arange(b - a + 1)
                inner[bounds[1:] - 1] = False
                out = np.full(len(inner), end_id, self.dtype)
                out[inner] = ids
                ids = out
            yield a, ids, bounds

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        return [ids[x:y].tobytes() for _, ids, at in self.rows(pa.array(texts, pa.string())) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each task process."""
    return Encoder(path)


def crc32s(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of the ids from each offset of at to the next, as little-endian unsigned integers of 32 bits."""
    data = memoryview(ids.astype("<u4").view(np.uint8))
    at = (4 * at).tolist()
    return np.array([zlib.crc32(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)
