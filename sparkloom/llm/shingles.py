"""Word shingles as 64-bit hashes, for whole batches of texts at once in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at once; a longer text is a batch of its own.
CHUNK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _ODD)[_LOWER]
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _powers, _inverses = 0xD1342543DE82EF95, np.ones(1, np.uint64), np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, CHUNK + 4096)
        _powers = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _U(_BASE))]), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _U(pow(_BASE, -1, 1 << 64)))]), dtype=np.uint64)
    return _powers, _inverses


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z in lower case, and where each text's words begin (one more than texts)."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    gap = _GAP[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    powers, inverses = _tables(len(data))
    total = np.cumsum(_BYTE[data] * powers[: len(data)], dtype=np.uint64)
    h = mix((total[ends - 1] - total[starts - 1]) * inverses[starts] + (ends - starts).astype(np.uint64) * _ODD)
    begins = np.cumsum([1] + [len(t) + 1 for t in texts])
    return h, np.searchsorted(starts, begins)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text with fewer words has one shingle, its whole sequence; one
    without words, or null, has none."""
    out: list[np.ndarray] = []
    factors = [mix(np.array([i + 77], np.uint64) * _ODD)[0] | _U(1) for i in range(width)]
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        h, at = word_hashes(held)
        n = len(h) - width + 1
        if n > 0:
            s = np.zeros(n, np.uint64)
            for j, f in enumerate(factors):
                s += h[j : j + n] * f
            s = mix(s)
        for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if z - a >= width:
                one = np.sort(s[a : z - width + 1])
                out.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
            elif z > a:
                short = sum((h[a + j] * factors[j] for j in range(z - a)), _U(z - a) * _ODD)
                out.append(mix(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))

    with np.errstate(over="ignore"):
        for t in texts:
            b = (t or "").encode("utf-8", "surrogatepass")
            if held and size + len(b) > CHUNK:
                flush()
                held, size = [], 0
            held.append(b)
            size += len(b) + 1
        if held:
            flush()
    return out
