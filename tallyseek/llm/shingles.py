"""Word and shingle hashes of many texts at once, in numpy.

A word is a run of non-blank characters, lower-cased.  Hashes depend on the word's bytes only, so every task,
executor and rerun gets the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
# Texts are hashed in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(256, dtype=np.uint64))
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(4095, np.uint64(0xD6E8FEB86659FD93))], dtype=np.uint64)
_PLACES = mix(np.arange(1000, 1000 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def blocks(texts: list[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts as lower-cased UTF-8) in blocks of about `limit` bytes."""
    at, block, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").lower().encode()
        if block and (size + len(raw) > limit or len(block) >= 60_000):
            yield at, block
            at, block, size = i, [], 0
        block.append(raw)
        size += len(raw)
    if block:
        yield at, block


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of its text) over all texts in order."""
    joined = b"\n".join(raws)
    data = np.frombuffer(joined, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_BLANK[data]
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    lengths = np.diff(np.r_[np.searchsorted(at, starts), len(at)])
    place = np.arange(len(at)) - np.repeat(np.searchsorted(at, starts), lengths)
    # Beyond 4096 bytes places repeat; the length is mixed in as well.
    parts = _BYTES[data[at]] * _POWERS[place & 4095]
    hashes = mix(np.add.reduceat(parts, np.searchsorted(at, starts)) + lengths.astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raws])
    return hashes, np.searchsorted(ends, starts, side="right")


def shingle_hashes(words: np.ndarray, owner: np.ndarray, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, first word's place in the array) of each run of SHINGLE words inside one text.

    With `short`, a text of 1 to 4 words has one shingle of all its words; without words there is none.
    """
    n = len(words)
    if n >= SHINGLE:
        total = np.zeros(n - SHINGLE + 1, dtype=np.uint64)
        for j in range(SHINGLE):
            total += words[j : n - SHINGLE + 1 + j] * _PLACES[j]
        at = np.flatnonzero(owner[: n - SHINGLE + 1] == owner[SHINGLE - 1 :])
        hashes = mix(total[at])
    else:
        at, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owners = owner[at]
    if short and n:
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        size = np.diff(np.r_[first, n])
        few = first[size < SHINGLE]
        if len(few):
            extra = np.array(
                [int(mix(np.sum(words[f : f + s] * _PLACES[:s], dtype=np.uint64)[None] + np.uint64(s))[0]) for f, s in zip(few, size[size < SHINGLE])],
                dtype=np.uint64,
            )
            hashes, owners, at = np.r_[hashes, extra], np.r_[owners, owner[few]], np.r_[at, few]
            order = np.argsort(at, kind="stable")
            hashes, owners, at = hashes[order], owners[order], at[order]
    return hashes, owners, at
