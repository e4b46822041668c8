"""Bloom filters of fixed size, as reducers before a join: they leave few rows besides those wanted, a join removes the rest."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame

from weftline.llm.common import map_batches

#: 8 MB.
BLOOM_BITS = 1 << 26


class Bloom:
    """A Bloom filter of 64-bit names with a fixed size. Names are hashes: numbers in a row would fall together."""

    def __init__(self, words: np.ndarray | None = None):
        self.words = np.zeros(BLOOM_BITS // 8, dtype=np.uint8) if words is None else words

    def slots(self, names: np.ndarray):
        names = names.astype(np.uint64)
        for i in range(4):
            yield ((names * np.uint64(2 * i + 1)) >> np.uint64(7 + 9 * i)) % np.uint64(8 * len(self.words))

    def add(self, names: np.ndarray) -> None:
        for slot in self.slots(names):
            np.bitwise_or.at(self.words, (slot >> np.uint64(3)).astype(np.int64), np.left_shift(1, (slot & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def has(self, names: np.ndarray) -> np.ndarray:
        found = np.ones(len(names), dtype=bool)
        for slot in self.slots(names):
            found &= (self.words[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def bloom_of(names: DataFrame, column: str = "sid"):
    """A broadcast Bloom filter (8 MB) of a column of longs: slices of it are or-ed on the executors."""
    slices, width = 64, BLOOM_BITS // 8 // 64
    spark = names.sparkSession

    def make():
        bloom, any_ = Bloom(np.zeros(slices * width, dtype=np.uint8)), [False]

        def step(columns):
            if columns is not None:
                any_[0] = True
                bloom.add(np.array(columns[column], dtype=np.int64).view(np.uint64))
            elif any_[0]:
                parts = [zlib.compress(bloom.words[i * width : (i + 1) * width].tobytes(), 1) for i in range(slices)]
                yield {"slice": list(range(slices)), "bits": parts}

        return step

    def join():
        totals: dict[int, np.ndarray] = {}

        def step(columns):
            if columns is None:
                if totals:
                    yield {"slice": list(totals), "bits": [x.tobytes() for x in totals.values()]}
                return
            for k, bits in zip(columns["slice"], columns["bits"]):
                part = np.frombuffer(zlib.decompress(bits), dtype=np.uint8)
                totals[k] = totals[k] | part if k in totals else part

        return step

    parts = map_batches(names.select(column), "slice int, bits binary", make)
    whole = map_batches(parts.repartition(slices, "slice"), "slice int, bits binary", join)
    words = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
    for row in whole.toLocalIterator():
        words[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["bits"], dtype=np.uint8)
    return spark.sparkContext.broadcast(words.tobytes())
