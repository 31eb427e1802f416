"""Word hashing in numpy for whole batches of texts.

A word is a run of bytes other than 0x20 and 0x09-0x0D in the UTF-8 form. All
words of a batch are hashed at once: a polynomial over byte codes, taken as the
difference of two prefix sums modulo 2**64, then mixed.
"""

from __future__ import annotations

import numpy as np

from tipscope.llm.base import ship

ship(__name__)

#: Bytes hashed at a time; longer texts are cut at white space.
SEGMENT = 1 << 19
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BASE = 0x9E3779B97F4A7C15 | 1


def mix(h):
    """Spread 64-bit values (a finaliser of two multiplications)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """Splits and hashes words; keeps the powers it has computed."""

    def __init__(self):
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.code = mix(np.arange(1, 257, dtype=np.uint64))
        self.size = 0

    def _powers(self, n):
        if n > self.size:
            self.size = max(n, 2 * self.size, 1 << 16)
            up = np.full(self.size, BASE, np.uint64)
            down = np.full(self.size, pow(BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down

    def _pieces(self, data):
        """Byte strings of about SEGMENT bytes, cut at white space."""
        at = 0
        while len(data) - at > SEGMENT:
            end = at + SEGMENT
            while end < len(data) and not self.space[data[end]]:
                end += 1
            yield data[at:end]
            at = end
        yield data[at:]

    def _hash(self, data):
        a = np.frombuffer(data, np.uint8)
        gap = self.space[a]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate(([0], edge))
        start, end = edge[0::2], edge[1::2]  # data ends in white space
        up, down = self._powers(len(a))
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(self.code[a] * up[:len(a)], out=total[1:])
        return mix((total[end] - total[start]) * down[start]), start

    def hashes(self, texts, fold=True):
        """(word hashes of all texts in order, number of words of each text);
        NULL counts as empty. ``fold`` lower-cases A-Z first."""
        out, counts = [], np.zeros(len(texts), np.int64)
        group, owners, size = [], [], 0

        def flush():
            nonlocal group, owners, size
            if group:
                begin = np.cumsum([0] + [len(x) + 1 for x in group[:-1]])
                h, start = self._hash(b"\n".join(group) + b"\n")
                out.append(h)
                n = np.diff(np.append(np.searchsorted(start, begin), len(start)))
                np.add.at(counts, np.array(owners), n)
                group, owners, size = [], [], 0

        for i, t in enumerate(texts):
            if t:
                data = t.encode("utf-8", "surrogatepass")
                for piece in self._pieces(data.translate(FOLD) if fold else data):
                    group.append(piece)
                    owners.append(i)
                    size += len(piece)
                    if size >= SEGMENT:
                        flush()
        flush()
        return np.concatenate(out) if out else np.zeros(0, np.uint64), counts


def windows(h, k):
    """Hashes of the ``k``-word windows of one text's word hashes; fewer than
    ``k`` words make one window of them all, none makes none."""
    if len(h) == 0:
        return h
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + h[j:len(h) - k + 1 + j]
    return mix(out)
