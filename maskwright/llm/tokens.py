"""Vectorised words and shingles for the operators that work on word windows.

A word is a maximal run of characters outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``
after lower-casing A-Z: in UTF-8, a run of the bytes 0-9, a-z and >= 0x80.
Words and shingles are identified by 64-bit hashes that depend on the text
alone, never on the process, so they may be shuffled and stored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_WINDOW = 1 << 20
_SEED = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_SEED) + np.uint64(seed))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    is_word = np.zeros(256, bool)
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        is_word[low : high + 1] = True
    value = stream(11, 256)
    value[0x41:0x5B] = value[0x61:0x7B]
    return is_word, value


_IS_WORD, _VALUE = _tables()
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        base = 0xD6E8FEB86659FD93
        for factor in (base, pow(base, -1, 1 << 64)):
            steps = np.full(_WINDOW + 1, factor, np.uint64)
            steps[0] = 1
            _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS[0], _POWERS[1]


def _hash_window(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    power, inverse = _powers()
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IS_WORD[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if len(data) <= _WINDOW:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
        value = (sums[ends] - sums[starts]) * inverse[starts]
    else:  # one run of word bytes longer than the window
        value = np.zeros(len(starts), np.uint64)
        for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
            for at in range(a, b, _WINDOW):
                part = _VALUE[data[at : min(b, at + _WINDOW)]]
                value[i : i + 1] = mix(value[i : i + 1]) + (part * power[: len(part)]).sum(dtype=np.uint64)
    return starts, ends, mix(value + (ends - starts).astype(np.uint64) * np.uint64(_SEED))


class Words:
    """Words of several texts: ``hashes`` of all, ``bounds`` of each text's share.

    ``starts`` and ``ends`` are byte places in ``data``, the texts joined by a
    line feed.  A null or empty text has no words.
    """

    def __init__(self, texts: Sequence[str | None]):
        parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.data = np.frombuffer(b"\n".join(parts), np.uint8)
        sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.places = np.concatenate([[0], np.cumsum(sizes)])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, total = 0, len(self.data)
        with np.errstate(over="ignore"):
            while at < total:
                to = min(total, at + _WINDOW)
                if to < total:
                    gaps = np.flatnonzero(~_IS_WORD[self.data[at:to]])
                    if len(gaps):
                        to = at + int(gaps[-1]) + 1
                    else:
                        while to < total and _IS_WORD[self.data[to]]:
                            to += 1
                s, e, h = _hash_window(self.data[at:to])
                found.append((s + at, e + at, h))
                at = to
        joined = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)]
        self.starts, self.ends, self.hashes = joined
        self.bounds = np.searchsorted(self.starts, self.places)
        self.counts = np.diff(self.bounds)

    def shingles(self, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``size``-word windows and the bounds of each text's share.

        A text of one to ``size - 1`` words has one shingle, of all its words.
        """
        factors = stream(23, size)
        n = len(self.hashes)
        short = (self.counts > 0) & (self.counts < size)
        per_text = np.where(short, 1, np.maximum(self.counts - size + 1, 0))
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(n - size + 1, 0), np.uint64)
            for j in range(size):
                rolled += self.hashes[j : j + len(rolled)] * factors[j]
            # drop the windows that cross into the next text
            text_of = np.repeat(np.arange(len(self.counts)), self.counts)
            keep = np.zeros(n, bool)
            if len(rolled):
                keep[: len(rolled)] = text_of[: len(rolled)] == text_of[size - 1 :]
            out = np.zeros(bounds[-1], np.uint64)
            long_slots = np.repeat(~short, per_text)
            out[long_slots] = mix(rolled[keep[: len(rolled)]])
            for i in np.flatnonzero(short):
                a, b = self.bounds[i], self.bounds[i + 1]
                out[bounds[i]] = mix((self.hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))[0]
        return out, bounds


def groups(sizes: Sequence[int], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters; a longer text stands alone."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)
