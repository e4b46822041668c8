"""A filter of fixed size: most rows that no join will keep go where they are read, before anything is dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of a filter. They are gathered in words of 64, so a broadcast has at most 2^20 rows of two numbers.
BITS = 1 << 26


def _bit(columns: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BITS))


def likely(df: DataFrame, columns: list[str], wanted: DataFrame, keep: bool = True) -> DataFrame:
    """The rows of ``df`` whose ``columns`` equal a row of ``wanted`` (as many columns, in the same order), and by chance
    some others: a join that drops those must follow. With ``keep`` False the rest, of which none is wanted."""
    kinds = dict(df.dtypes)
    bit = _bit([F.col(w).cast(kinds[c]) for w, c in zip(wanted.columns, columns)])
    words = wanted.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_bit & 63 as int)))").alias("_bits"))
    at = _bit([F.col(c) for c in columns])
    known = F.getbit("_bits", at.bitwiseAND(F.lit(63)).cast("int")) == 1
    return df.join(F.broadcast(words), (F.shiftright(at, 6) == F.col("_word")) & known, "left_semi" if keep else "left_anti")
