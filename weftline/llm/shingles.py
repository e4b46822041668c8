"""Word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
from xxhash import xxh3_64_digest

#: Odd, one for each place of a word in its shingle.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


class Shingler:
    """Sorted distinct hashes of a text's shingles of ``size`` words.

    Words are runs of bytes other than space and tab to carriage return; A-Z are lower-cased. A text with fewer words
    than ``size`` has its whole sequence as its one shingle; one without words has none. Hashes have 64 bits, so two
    different shingles of a pair of documents fall together with a chance of about 5e-20.
    """

    def __init__(self, size: int):
        self.size = size

    def words(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.frombuffer(b"".join(map(xxh3_64_digest, found)), dtype=">u8").astype(np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.words(text)
        if not len(words):
            return words
        size = min(self.size, len(words))
        count = len(words) - size + 1
        # words are 64 random bits each, so a sum of them under different odd multipliers is as good as random
        total = words[:count] * np.uint64(_MULTIPLIERS[0])
        for i in range(1, size):
            total += words[i : count + i] * np.uint64(_MULTIPLIERS[i % 5] + 2 * (i // 5) + 2 * size)
        total.sort()
        fresh = np.empty(count, dtype=bool)
        fresh[0] = True
        np.not_equal(total[1:], total[:-1], out=fresh[1:])
        return total[fresh]


def name_of(hashes: np.ndarray) -> bytes:
    """A name of 128 bits of a set of hashes."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


#: Bits of the parity maps of small and of large sets, and the size from which a set is large.
SMALL_BITS, LARGE_BITS, LARGE_SET = 1024, 8192, 1200


def parity(hashes: np.ndarray) -> bytes:
    """For each of a number of classes of hashes, whether a set has an odd number of them.

    The maps of two sets differ in at most as many bits as the sets have elements apart: a lower bound of that number.
    """
    bits = SMALL_BITS if len(hashes) < LARGE_SET else LARGE_BITS
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def presence(hashes: np.ndarray) -> np.ndarray:
    """For each of 1024 classes of hashes, whether a set has any of them, as 128 bytes."""
    some = np.zeros(1024, dtype=np.uint8)
    some[(hashes & np.uint64(1023)).astype(np.int64)] = 1
    return np.packbits(some)


def fold(maps: np.ndarray, size: int) -> np.ndarray:
    """Maps (one in each row, as bytes) with ``size`` bytes only: classes that fall together add their parities."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, size), axis=1)
