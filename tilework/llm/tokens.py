"""Token ids of whole texts by a public tokenizer, a distinct piece of text at a time.

A text is cut before each single space, tab or line feed that stands between two characters which
are neither white space nor control characters. The supported tokenizers' pre-tokens never go
across such a cut, and what they do beside it doesn't depend on the other side, so the ids of the
pieces are the ids of the text. The same holds between an ASCII letter and a mark other than the
apostrophe, on either side. Most pieces occur again and again; each distinct one of a slice is
encoded once, and short ones are kept for a task's life in a bounded cache of two generations, in
which those that come again stay. A piece that is one word of letters is one pre-token, so it goes to the
tokenizer's model at once; all others take the whole way.

Strings of the tokenizer's added tokens (`<|endoftext|>`) are found first, in the unchanged text;
each is its one id, and what lies between two of them is encoded like a text of its own, as the
library does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tilework.llm.textkit import LOWER, release, text_slices

#: Bytes of text whose distinct pieces are encoded together.
SLICE_BYTES = 4 << 20

#: Pieces of a generation that a worker keeps, and the longest that it keeps.
CACHE_PIECES, CACHE_BYTES = 200_000, 24

#: Pieces that can be encoded with others in one text: an optional space, then no white space.
_TOGETHER = re.compile(rb" ?[\x21-\x7e\x80-\xc1\xc3-\xe0\xe4-\xff]+").fullmatch
#: Bits of a byte. A cut's space; ASCII that is surely no white space; ASCII letters, and marks that can be
#: cut off them (an apostrophe can't); first bytes of characters of two and three bytes that aren't white
#: space nor may combine: U+00C0 to U+02FF and U+0400 to U+057F, and from U+4000 to U+9FFF.
_CUT, _PLAIN, _LETTER, _MARK, _TWO, _THREE = 1, 2, 4, 8, 16, 32
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09, 0x0A]] = _CUT
_KIND[0x21:0x7F] = _PLAIN | _MARK
_KIND[[ord("'"), *range(48, 58)]] = _PLAIN
_KIND[[*range(65, 91), *range(97, 123)]] = _PLAIN | _LETTER
_KIND[[*range(0xC3, 0xCC), *range(0xD0, 0xD6)]] = _TWO
_KIND[0xE4:0xEA] = _THREE


#: Bytes of words: ASCII letters, and the characters U+00C0 to U+00FF and U+0400 to U+047F.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xD0, 0xD1]] = True


def _one_word(data: np.ndarray, offsets: np.ndarray, spaces: tuple[int, ...]) -> np.ndarray:
    """Which pieces, none of them empty, are letters, after one of these spaces or none."""
    other = ~_IN_WORD[data]
    other[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs of multiplication and division
    first = offsets[:-1]
    spaced = np.isin(data[first], spaces)
    other[first[spaced]] = False
    return (np.add.reduceat(other, first, dtype=np.int32) == 0) & (np.diff(offsets) > spaced)


def _byte_letters() -> dict[int, str]:
    """Byte-level tokenizers write a byte as the character of its number where that is visible, else as one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """ids of texts, with the tokenizer at `path` (a tokenizers JSON file)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # the pieces hold none of their strings
        with open(path, encoding="utf-8") as file:
            added = json.load(file).get("added_tokens") or []
        if any(not x["special"] or x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError(f"{path}: added tokens that take more than their own string aren't supported")
        self.added = {x["content"].encode(): x["id"] for x in added}
        self.find_added = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))).search
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.model = self.tokenizer.model
        normal = str(self.tokenizer.normalizer)
        self.lower = "Lowercase" in normal  # then pieces that differ in ASCII case only have the same ids
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        #: Text that stands between pieces encoded together, and its one id.
        self.between, self.between_id = next((x, ids(x)[0]) for x in ("\n", " \0 ") if len(ids(x)) == 1 and ids(f"a{x}b,{x} c{x}.") == [i for y in ("a", x, "b,", x, " c", x, ".") for i in ids(y)])

        # one word of letters: whether it's one pre-token, and whether a space before it belongs to that
        self.letters = _byte_letters() | {0: " "}
        split = lambda x: [y for y, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(x)]
        shape = lambda x: ["".join(self.letters[b] for b in x.encode())]
        self.space = split(" w\u00e9\u0436") == shape(" w\u00e9\u0436")
        self.direct = self.space or split(" w\u00e9\u0436") == shape("w\u00e9\u0436")

    def forget(self) -> None:
        """Empty the cache."""
        self.cache, self.older = {}, {}

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of pieces that are one word, by the model alone."""
        text = b"\0".join(words)
        if self.lower:
            text = text.decode().lower().encode()
        if not self.space:
            text = text.translate(None, b" \n")
        shown, flat, counts = text.decode("latin-1").translate(self.letters).split(" "), [], []
        for first in range(0, len(shown), 256):
            tokens = list(map(self.model.tokenize, shown[first : first + 256]))
            counts += map(len, tokens)
            flat.append(np.fromiter(map(attrgetter("id"), chain.from_iterable(tokens)), "<u4"))
        raw, ends = np.concatenate(flat).tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _encode(self, pieces: list[bytes], word: list[bool]) -> list[bytes]:
        """Each piece's ids as 32-bit integers; word: which are one word."""
        older, alone, together, words = self.older, [], [], []
        got = list(map(self.cache.get, pieces))
        new = [i for i, x in enumerate(got) if x is None]
        for i in new:
            if (x := older.get(pieces[i])) is not None:
                got[i] = x
            else:
                (words if self.direct and word[i] else together if _TOGETHER(pieces[i]) else alone).append(i)
        if words:
            for i, x in zip(words, self._words([pieces[i] for i in words]), strict=True):
                got[i] = x
        between = self.between.encode()
        for first in range(0, len(together), 4096):
            own = together[first : first + 4096]
            text = between.join([pieces[i] for i in own]).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(ids == self.between_id)
            if len(at) != len(own) - 1:  # a piece has that id itself
                alone += own
                continue
            begin, end, raw = [0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), 4 * len(ids)], ids.tobytes()
            for i, a, b in zip(own, begin, end, strict=True):
                got[i] = raw[a:b]
        for first in range(0, len(alone), 1024):
            own = alone[first : first + 1024]
            for i, e in zip(own, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in own], add_special_tokens=False), strict=True):
                got[i] = np.array(e.ids, dtype="<u4").tobytes()
        if len(self.cache) + len(new) > CACHE_PIECES:  # what isn't seen until this happens again is forgotten
            self.older, self.cache = self.cache, {}
        short = [i for i in new[:CACHE_PIECES] if len(pieces[i]) <= CACHE_BYTES]
        self.cache.update(zip(map(pieces.__getitem__, short), map(got.__getitem__, short), strict=True))
        return got

    def slice_ids(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a slice, number of each); each text's ids are followed by end_id, if there is one."""
        n, size = len(offsets) - 1, len(data)
        ends = int(end_id is not None)
        if not size:
            return np.full(n * ends, end_id or 0, dtype="<u4"), np.full(n, ends, dtype=np.int64)
        if self.lower:
            data = LOWER[data]
        kind = np.frombuffer(data.tobytes().translate(_KIND.tobytes()), np.uint8)
        before, after = kind & _PLAIN, kind & (_PLAIN | _TWO | _THREE)
        before[1:] |= kind[:-1] & _TWO  # the last byte of a wide character
        before[2:] |= kind[:-2] & _THREE
        cut = np.zeros(size, dtype=bool)
        cut[1:-1] = ((kind[1:-1] & _CUT) > 0) & (before[:-2] > 0) & (after[2:] > 0)
        if self.between == "\n":  # a line feed that stands alone is a pre-token
            cut[1:] |= cut[:-1] & (data[:-1] == 0x0A)
        # neighbours that are a letter and a mark, in either order
        both = (kind & (_LETTER | _MARK)).astype(np.uint8)
        cut[1:] |= (both[:-1] | both[1:]) == (_LETTER | _MARK)
        # a text's first byte starts a piece, and none is cut across two texts
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < size)]
        edge = np.concatenate([inner + 1, inner - 1])
        cut[edge[(edge > 0) & (edge < size)]] = False
        cut[inner] = True
        cut[0] = True
        start = np.flatnonzero(cut)
        del kind, before, after, both, cut
        pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, size)), pa.py_buffer(data)])
        coded = pc.dictionary_encode(pieces)
        code, known = coded.indices.to_numpy(), coded.dictionary
        at = np.frombuffer(known.buffers()[1], dtype=np.int64, count=len(known) + 1)
        letters = np.frombuffer(known.buffers()[2], dtype=np.uint8, count=at[-1])
        word = _one_word(letters, at, (0x20,) if self.space else (0x20, 0x0A))
        ids = self._encode(list(map(letters.tobytes().__getitem__, map(slice, at[:-1].tolist(), at[1:].tolist()))), word.tolist())
        edges = np.searchsorted(start, offsets)  # a text starts where a piece does
        if ends:
            code = np.insert(code, edges[1:], len(ids))
            ids.append(int(end_id).to_bytes(4, "little"))
            edges = edges + np.arange(n + 1)
        laid = pa.array(ids, pa.large_binary()).take(pa.array(code))
        place = np.frombuffer(laid.buffers()[1], dtype=np.int64)[edges] // 4
        return np.frombuffer(laid.buffers()[2], dtype="<u4", count=place[-1]), np.diff(place)

    def _added_in(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(begin, end, id) of the added tokens' strings inside texts, the leftmost and longest first."""
        raw, out, at = data.tobytes(), [], 0
        if not any(x in raw for x in self.added):
            return out
        while found := self.find_added(raw, at):
            begin, at = found.span()
            if offsets[np.searchsorted(offsets, begin, side="right")] < at:  # it goes on in the next text
                # a shorter one may still fit at the same place
                fits = [x for x in self.added if raw.startswith(x, begin) and offsets[np.searchsorted(offsets, begin, side="right")] >= begin + len(x)]
                at = begin + len(max(fits, key=len)) if fits else begin + 1
                if not fits:
                    continue
            out.append((begin, at, self.added[raw[begin:at]]))
        return out

    def slice_ids_added(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As slice_ids, with one id for each string of an added token."""
        found = self._added_in(data, offsets)
        if not found:
            return self.slice_ids(data, offsets, end_id)
        begin, end, added = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
        bounds = np.sort(np.concatenate([offsets, begin, end]))
        ids, length = self.slice_ids(data, bounds)
        own = np.searchsorted(bounds, begin, side="right") - 1  # the segment that starts there and isn't empty
        first = np.cumsum(length)[own] - length[own]
        segment = np.repeat(np.arange(len(length)), length)
        keep = ~np.isin(segment, own)
        keep[first] = True
        ids = ids.copy()
        ids[first] = added
        length[own] = 1
        ids, length = ids[keep], np.diff(np.concatenate([[0], np.cumsum(length)])[np.searchsorted(bounds, offsets)])
        return (ids, length) if end_id is None else (np.insert(ids, np.cumsum(length), end_id), length + 1)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def batches_of_ids(column: pa.Array, path: str, end_id: int, limit: int = SLICE_BYTES, added: bool = False):
    """(first row, end row, ids, lengths) of slices; each text's ids are followed by end_id.

    With `added`, strings of added tokens are those tokens, else ordinary text.
    """
    coder = encoder(path)
    own = coder.slice_ids_added if added else coder.slice_ids
    for first, end, data, offsets in text_slices(column, limit):
        yield first, end, *own(data, offsets, end_id)


def forgetting(batches: Iterator, path: str) -> Iterator:
    """The batches; after the last one, what the worker's encoder keeps is given back, for the tasks of other stages."""
    try:
        yield from batches
    finally:
        encoder(path).forget()
        release()
