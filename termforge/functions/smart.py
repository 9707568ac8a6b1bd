"""SMART weights as Column builders, keyed by their letter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _log_tf(tf: Column) -> Column:
    return 1 + F.log10(tf)


#: Document weights of (tf, max_tf, ave_tf): natural, logarithmic, augmented, log average.
DOC_WEIGHTS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "n": lambda tf, max_tf, ave_tf: tf.cast("double"),
    "l": lambda tf, max_tf, ave_tf: _log_tf(tf),
    "a": lambda tf, max_tf, ave_tf: 0.5 + 0.5 * tf / max_tf,
    "L": lambda tf, max_tf, ave_tf: _log_tf(tf) / (1 + F.log10(ave_tf)),
}


def idf_t(n: Column, df: Column) -> Column:
    return F.log10(n / df)


def idf_p(n: Column, df: Column) -> Column:
    """Probabilistic idf, not below 0; a term in every document has 0 (the logarithm is null there)."""
    return F.greatest(F.lit(0.0), F.log10((n - df) / df))


IDF = {"t": idf_t, "p": idf_p}


def query_weight(qtf: Column, n: Column, df: Column, idf: str) -> Column:
    return IDF[idf](n, df) * _log_tf(qtf)


def exact_sum(weight: Column, times: Column | None = None) -> Column:
    """A sum that does not depend on the order of its terms, which must be below 10**8 each; ``times`` counts equal ones (a long number below 10**9)."""
    term = weight.cast("decimal(20,12)")
    return F.sum(term if times is None else term * times.cast("decimal(9,0)")).cast("double")
