"""Text to token ids through bounded caches of space-led pieces and of pre-tokens.

The byte-level pre-tokenisation pattern never lets a match of non-space characters
run over a space, and a space after a non-space character always begins a match.
So a text may be cut before every such space and the pieces encoded on their own;
equal pieces are encoded once. White-space runs stay whole inside their piece.
"""

from __future__ import annotations

import re

_SPACE_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<!\s) ")

_SIMPLE_END = frozenset(".,;:!?")

#: Longest piece that stays in a cache, in characters.
CACHED_CHARS = 48
#: Text whose distinct pieces are looked up together.
TOGETHER_CHARS = 1 << 18


class RecentCache(dict):
    """Values of keys seen lately, made on first use: at most about twice ``limit`` entries, in two generations.

    A full young generation becomes the old one; what is still used moves over. Losing an
    entry costs time but changes no result. Very long keys are not kept.
    """

    def __init__(self, make, limit: int, old: dict | None = None):
        super().__init__()
        self.make = make
        self.limit = limit
        self.old = {} if old is None else old

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_CHARS:
            self[key] = value
        return value

    def turned(self) -> "RecentCache":
        if len(self) <= self.limit:
            return self
        self.old = {}
        return RecentCache(self.make, self.limit, self)


class PieceTable:
    """Ids of pieces by 128-bit hashes of their bytes, in flat arrays: about 40 bytes a piece.

    An open-addressing table of about ``limit`` pieces, looked up for a whole array at once. When it is full its user clears it,
    which costs time and changes no result.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def full(self, more: int) -> bool:
        return self.count + more > self.limit or self.used > 7 * self.limit

    def clear(self) -> None:
        """Start anew, in the same arrays: they are made once at their full size, so that a worker's memory does not creep."""
        import numpy as np
        size = 1 << max(10, (2 * self.limit - 1).bit_length())
        if getattr(self, "h", None) is None or len(self.h) != size:
            self.h, self.g, self.entry = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self.first, self.n, self.ids = np.zeros(size // 2, np.int64), np.zeros(size // 2, np.int32), np.zeros(4 * size, np.uint32)
        self.h[:] = 0
        self.count, self.used = 0, 0

    def find(self, h, g):
        """Entry of every piece, -1 where it is not held."""
        import numpy as np
        mask = len(self.h) - 1
        out = np.full(len(h), -1, np.int64)
        left, slot = np.arange(len(h)), (h & np.uint64(mask)).astype(np.int64)
        while len(left):
            there = self.h[slot]
            hit = (there == h[left]) & (self.g[slot] == g[left])
            out[left[hit]] = self.entry[slot[hit]]
            go = ~hit & (there != 0)
            left, slot = left[go], (slot[go] + 1) & mask
        return out

    def _place(self, h, g, entry) -> None:
        import numpy as np
        mask = len(self.h) - 1
        left, slot = np.arange(len(h)), (h & np.uint64(mask)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.h[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)  # one piece for each free slot
            done = free[one]
            self.h[slot[done]], self.g[slot[done]], self.entry[slot[done]] = h[left[done]], g[left[done]], entry[left[done]]
            rest = np.ones(len(left), bool)
            rest[done] = False
            left, slot = left[rest], (slot[rest] + 1) & mask

    def add(self, h, g, blobs: list[bytes]) -> None:
        """Hold new pieces (hashes that differ and are not held) with their ids."""
        import numpy as np
        n = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        flat = np.frombuffer(b"".join(blobs), np.uint32)
        while 2 * (self.count + len(h)) > len(self.h):
            live = self.h != 0
            old, entry = (self.h[live], self.g[live]), self.entry[live]
            size = 2 * len(self.h)
            self.h, self.g, self.entry = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._place(*old, entry)
        self.first, self.n, self.ids = (_room(x, k) for x, k in ((self.first, self.count + len(h)), (self.n, self.count + len(h)),
                                                                   (self.ids, self.used + len(flat))))
        at = slice(self.count, self.count + len(h))
        self.n[at], self.first[at] = n, self.used + np.cumsum(n) - n
        self.ids[self.used:self.used + len(flat)] = flat
        self._place(h, g, np.arange(self.count, self.count + len(h), dtype=np.int32))
        self.count, self.used = self.count + len(h), self.used + len(flat)


def _room(a, size: int):
    """``a`` with room for ``size`` values."""
    import numpy as np
    if len(a) >= size:
        return a
    out = np.zeros(max(size, len(a) + len(a) // 2), a.dtype)
    out[:len(a)] = a
    return out


class Hasher:
    """A 64-bit hash of every piece of a buffer at once: sums of random values per byte, weighted by its place in the piece."""

    def __init__(self, seed: int):
        self.seed, self.up, self.down = seed, (), ()

    def __call__(self, data, begin, end):
        import numpy as np
        if not len(self.up):
            rng = np.random.default_rng(self.seed)
            self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
            self.base = int(rng.integers(1 << 60, 1 << 62)) * 4 + 3
        if len(self.up) < len(data) + 1:
            n = len(data) + 1
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)])
                                  for b in (self.base % (1 << 64), pow(self.base, -1, 1 << 64)))
        s = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[:len(data)], out=s[1:])
        h = (s[end] - s[begin]) * self.down[begin] + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29)) | np.uint64(1) << np.uint64(63)  # never 0


class TextEncoder:
    """Ids of whole texts from ``encode_word(pre-token) -> uint32 ids as bytes``."""

    def __init__(self, pattern: str, encode_word, max_pieces: int = 1_000_000, max_words: int = 60_000):
        import regex
        self.pattern = regex.compile(pattern)
        self.encode_word = encode_word
        self.words = RecentCache(encode_word, max_words)
        self.pieces = PieceTable(max_pieces)
        self.hashers = Hasher(1), Hasher(2)

    def _piece(self, piece: str, led: str) -> bytes:
        """Plain words, with or without one end mark, need no regex."""
        if piece.isalpha():
            return self.words[led]
        if piece[-1:] in _SIMPLE_END and piece[:-1].isalpha():
            return self.words[led[:-1]] + self.words[piece[-1]]
        return b"".join(map(self.words.__getitem__, self.pattern.findall(led)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0
        self.words = self.words.turned()
        for i, t in enumerate(texts):
            if _SPACE_AFTER_SPACE.search(t) is not None:
                first, *rest = _CUT.split(t)
                out[i].append(self._piece(first, first) + b"".join(self._piece(p, " " + p) for p in rest))
                continue
            for part, is_start in _parts(t):
                if len(part) > 4 * TOGETHER_CHARS:  # no space in it
                    held = self._together(held, out)
                    out[i].append(b"".join(self._piece(p, p if is_start and not k else " " + p) for k, p in enumerate(part.split(" "))))
                    continue
                held.append((i, part, is_start))
                size += len(part)
                if size > TOGETHER_CHARS:
                    held, size = self._together(held, out), 0
        self._together(held, out)
        return [b"".join(x) if len(x) != 1 else x[0] for x in out]

    def _together(self, parts: list[tuple[int, str, bool]], out: list[list[bytes]]) -> list:
        """Add the ids of (text number, part, is it the text's start) to ``out``; pieces not held are encoded once. Returns an empty list."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        if not parts:
            return []
        split = pc.split_pattern(pa.array([p for _, p, _ in parts], pa.large_string()), " ")
        rows, pieces = split.offsets.to_numpy(), split.values
        _, offsets, data = pieces.buffers()
        offsets = np.frombuffer(offsets, np.int64)[pieces.offset:pieces.offset + len(pieces) + 1]
        data = np.frombuffer(data, np.uint8)[:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        h, g = (x(data, offsets[:-1], offsets[1:]) for x in self.hashers)
        head = np.zeros(len(h), bool)
        head[rows[:-1][np.array([x for _, _, x in parts])]] = True
        h[head] ^= np.uint64(0x5851F42D4C957F2C)  # a text's first piece has no space before it
        entry = self.pieces.find(h, g)
        absent = np.flatnonzero(entry < 0)
        if len(absent):
            _, one = np.unique(h[absent], return_index=True)
            if self.pieces.full(len(one)):
                self.pieces.clear()
                absent, one = np.arange(len(h)), np.unique(h, return_index=True)[1]
            new = absent[one]
            self.pieces.add(h[new], g[new], [self._piece(p, p if x else " " + p) for p, x in
                                             zip(pieces.take(pa.array(new)).to_pylist(), head[new].tolist())])
            entry[absent] = self.pieces.find(h[absent], g[absent])
        n = self.pieces.n[entry].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.pieces.ids[np.repeat(self.pieces.first[entry] - (ends - n), n) + np.arange(ends[-1])]
        ends = np.r_[0, ends][rows]
        for k, (i, _, _) in enumerate(parts):
            out[i].append(ids[ends[k]:ends[k + 1]].tobytes())
        return []


def _parts(text: str):
    """(part, is it the start): a long text in parts that end before a space, which the next part leaves out."""
    begin = 0
    while len(text) - begin > TOGETHER_CHARS and (end := text.find(" ", begin + TOGETHER_CHARS)) >= 0:
        yield text[begin:end], begin == 0
        begin = end + 1
    yield text[begin:], begin == 0
