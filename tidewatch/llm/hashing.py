"""64-bit hashes of words and word sequences of many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: What separates words, and the upper-case letters that are lowered.
WHITE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.array([b not in WHITE for b in range(256)])
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_P))
#: Bytes hashed in one step; memory beside the text and its hashes follows this, not the longest text.
STEP = 1 << 18
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse, for the places of one step."""
    if not _POWERS:
        for base in (_P, _P_INVERSE):
            run = np.full(STEP, U(base), U)
            run[0] = 1
            _POWERS.append(np.cumprod(run, dtype=U))
    return _POWERS


def chunks(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Whole texts in UTF-8, lower-cased A-Z, about ``most`` bytes at a time, with the index of the first."""
    start, part, size = 0, [], 0
    for i, x in enumerate(texts):
        raw = (x or "").encode().translate(_LOWER)
        part.append(raw)
        size += len(raw)
        if size >= most:
            yield start, part
            start, part, size = i + 1, [], 0
    if part:
        yield start, part


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, in order, and the index of its text. Bytes are read ``STEP`` at a time; a word that a step cuts
    carries its start into the next one, so its hash does not depend on where steps end."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    power, inverse = _powers()
    hashes, starts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    total, was = 0, False  # the sum of all bytes before the step, and whether the last of them is in a word
    value, back, place = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)  # the start that is open, if one is
    for at in range(0, len(raw), STEP):
        part = raw[at : at + STEP]
        inside = _IS_WORD[part]
        edges = np.flatnonzero(np.concatenate([[inside[0] != was], inside[1:] != inside[:-1]]))
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(_BYTE[part] * power[: len(part)], out=sums[1:])
        scale = pow(_P, at, 1 << 64)
        value = np.concatenate([value, sums[edges] * U(scale) + U(total)])
        back = np.concatenate([back, inverse[edges] * U(pow(_P_INVERSE, at, 1 << 64))])
        place = np.concatenate([place, edges + at])
        n = len(place) // 2 * 2
        hashes.append(mix((value[1:n:2] - value[:n:2]) * back[:n:2] + (place[1:n:2] - place[:n:2]).astype(U) * U(0xD6E8FEB86659FD93)))
        starts.append(place[:n:2])
        value, back, place = value[n:], back[n:], place[n:]
        total, was = (total + scale * int(sums[-1])) % (1 << 64), inside[-1]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.searchsorted(bounds, np.concatenate(starts), "right")


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive values; ``len(hashes) - n + 1`` of them."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U)
    out = np.full(count, U(n), U)
    for k in range(n):
        out = mix(out * U(_P) + hashes[k : k + count])
    return out


def shingle_sets(hashes: np.ndarray, owner: np.ndarray, n_texts: int, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of each text; with fewer words, of all its words as one."""
    bounds = np.searchsorted(owner, np.arange(n_texts + 1))
    whole = runs(hashes, n)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        else:
            out.append(runs(hashes[a:b], b - a) if b > a else np.zeros(0, U))
    return out
