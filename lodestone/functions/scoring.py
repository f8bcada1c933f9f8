"""BM25."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf / (tf + K1 * (1 - B + B * dl / avgdl))


def weight(boost: Column, qtf: Column, n_docs: Column, df: Column) -> Column:
    """What a term's saturated frequency is multiplied with."""
    return qtf * boost * (K1 + 1) * idf(n_docs, df)


def coded_length(dl: Column) -> Column:
    """A length as one byte can hold it: exact up to 40, then rounded down to four leading bits above 24."""
    over = dl - 24
    shift = F.greatest(F.lit(0), F.length(F.bin(over)) - 4).cast("int")
    return F.when(dl < 24, dl).otherwise(24 + F.call_function("shiftleft", F.call_function("shiftright", over, shift), shift))
