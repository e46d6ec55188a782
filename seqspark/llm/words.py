"""Words of many texts at once, in numpy: where they stand, whose they are, and their hashes.

Words are the longest runs of ASCII letters and digits and of bytes beyond ASCII, in lower case for A-Z only.
Texts are folded to bytes in which everything else is a blank; from there on no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from seqspark.llm.token_parquet import pieces

#: Bytes of text that are taken at once; of a word that is taken by itself.
SLICE_BYTES, LONG = 1 << 20, 64

#: Lower case for A-Z; white space for every other ASCII byte that is no letter or digit.
FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
#: Odd multipliers of two 64-bit hashes, and of their last mixing.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LAST = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: The bytes of a little-endian 64-bit number that belong to a word of 0 to 8 bytes.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Words:
    """Words of some texts: buffer (uint8, words with one blank after each), starts and sizes in it, text (the owner's
    number) and new (false for words that only lead over from the part before)."""

    def __init__(self, parts: list[tuple[int, bytes, int]]) -> None:
        """parts: (number of the text, folded bytes, leading words that are not new)."""
        data = np.frombuffer(b"".join(p + b" " for _, p, _ in parts) + bytes(8), np.uint8)[:-8]
        letter = data != 32
        edge = np.diff(letter.view(np.int8), prepend=np.int8(0))
        begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        self.sizes = end - begin
        letter[end] = True  # the blank after a word stays
        self.buffer = data[letter]
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        offsets = np.cumsum([0, *(len(p) + 1 for _, p, _ in parts)])
        part = np.searchsorted(offsets, begin, "right") - 1
        self.text = np.array([i for i, _, _ in parts], np.int64)[part]
        first = np.searchsorted(begin, offsets[:-1])
        self.new = np.arange(len(begin)) - first[part] >= np.array([k for _, _, k in parts], np.int64)[part]

    def __len__(self) -> int:
        return len(self.sizes)

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, their bytes 8k to 8k + 7 as a number) for k = 0, 1, ..., of the words up to LONG bytes that reach so far."""
        padded = np.concatenate([self.buffer, np.zeros(8, np.uint8)])
        numbers = np.ndarray((len(self.buffer),), "<u8", padded, strides=(1,))
        own = np.nonzero(self.sizes <= LONG)[0]
        at = 0
        while len(own):
            left = self.sizes[own] - at
            yield own, numbers[self.starts[own] + at] & _MASKS[np.minimum(left, 8)]
            own, at = own[left > 8], at + 8

    def long(self) -> Iterator[tuple[int, bytes]]:
        """(word, its bytes) of the words beyond LONG bytes."""
        for i in np.nonzero(self.sizes > LONG)[0].tolist():
            yield i, self.buffer[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes()

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each word."""
        out = tuple(self.sizes.astype(np.uint64) * np.uint64(f) for f in _LAST)
        for own, number in self.chunks():
            for h, factor in zip(out, _FACTORS, strict=True):
                x = (h[own] ^ number) * np.uint64(factor)
                h[own] = x ^ (x >> np.uint64(29))
        for h, factor in zip(out, _LAST, strict=True):
            h ^= h >> np.uint64(32)
            h *= np.uint64(factor)
            h ^= h >> np.uint64(29)
        for i, word in self.long():
            for k, h in enumerate(out):
                h[i] = xxhash.xxh3_64_intdigest(word, k)
        return out

    def numbers(self) -> tuple[np.ndarray, int]:
        """A number below the second value for each word, the same for equal words only."""
        _, first, slot = np.unique(self.hashes()[0], return_index=True, return_inverse=True)
        same = self.sizes[first][slot] == self.sizes
        for own, number in self.chunks() if same.all() else ():
            told = np.zeros(len(self), np.uint64)
            told[own] = number
            same[own] &= told[first[slot[own]]] == number
        told = dict(self.long())
        for i, word in told.items():
            same[i] &= told.get(int(first[slot[i]])) == word
        if same.all():
            return slot, len(first)
        words = self.buffer.tobytes().split()  # two words with one hash
        table = dict(zip(dict.fromkeys(words), range(len(words))))
        return np.fromiter(map(table.__getitem__, words), np.int64, len(words)), len(table)


def slices(texts: list[bytes | None], lead: int = 0, size: int | None = None) -> Iterator[Words]:
    """The words of texts, some texts or a part of a long one at a time; a part begins with the last `lead` words
    of the part before."""
    size = size or SLICE_BYTES
    parts: list[tuple[int, bytes, int]] = []
    held = 0
    for i, text in enumerate(texts):
        tail: list[bytes] = []
        for piece in pieces((text or b"").translate(FOLD), size):
            parts.append((i, b" ".join([*tail, piece]), len(tail)))
            held += len(piece)
            if lead and len(piece) >= size:  # the text may go on
                tail = [*tail, *_last(piece, lead)][-lead:]
            if held >= size:
                yield Words(parts)
                parts, held = [], 0
    if parts:
        yield Words(parts)


def _last(piece: bytes, n: int) -> list[bytes]:
    return piece.rsplit(None, n)[-n:] if len(piece.rsplit(None, n)) > n else piece.split()
