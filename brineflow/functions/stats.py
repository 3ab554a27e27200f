"""Statistics, hashing and sequence measures, Column -> Column; all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brineflow.functions.text import let

Z95 = 1.959963984540054
#: First 16 hex digits of the cut points 0.15 and 0.30.
TEST_BELOW, VALIDATION_BELOW = "2666666666666666", "4ccccccccccccccc"


def wilson(successes: Column, n: Column, z: float = Z95) -> Column:
    """struct(low, high) of the score interval, within 0..1; null for n of 0."""
    p = successes / n
    middle = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    below = 1 + z * z / n
    return F.when(n > 0, F.struct(F.greatest((middle - half) / below, F.lit(0.0)).alias("low"), F.least((middle + half) / below, F.lit(1.0)).alias("high")))


def precision(tp: Column, fp: Column) -> Column:
    return F.when(tp + fp > 0, tp / (tp + fp))


def recall(tp: Column, fn: Column) -> Column:
    return F.when(tp + fn > 0, tp / (tp + fn))


def f_score(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return F.when((1 + b) * tp + b * fn + fp > 0, (1 + b) * tp / ((1 + b) * tp + b * fn + fp))


def matthews(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    below = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(below > 0, (tp * tn - fp * fn) / below)


def hash_fold(key: Column) -> Column:
    """test, val or train by the hash alone: 15, 15 and 70 percent of keys, on any engine and in any order."""
    position = F.substring(F.sha2(key, 256), 1, 16)
    return F.when(position < TEST_BELOW, "test").when(position < VALIDATION_BELOW, "val").otherwise("train")


def hash_bucket(key: Column, n: int = 100) -> Column:
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def sequence_id(sequence: Column) -> Column:
    return F.substring(F.sha1(sequence), 1, 16)


def share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def count_of(text: Column, letters: str) -> Column:
    """How many characters of `text` are among `letters`."""
    counts = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in letters]
    return sum(counts[1:], counts[0])


RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
#: Hydropathy of the residues.
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}


def residue_counts(text: Column) -> Column:
    """Counts of the standard residues in their order."""
    return F.array(*[count_of(text, c) for c in RESIDUES])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def entropy_of(counts: Column) -> Column:
    """Shannon entropy in bits of counts; null if all are zero."""
    of = lambda n: F.when(n > 0, _sum(F.transform(counts, lambda c: F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0))))
    return let(_sum(counts), of)


def entropy(text: Column) -> Column:
    return let(residue_counts(text), entropy_of)


def _weighted(counts: Column, values: list[float]) -> Column:
    return _sum(F.zip_with(counts, F.array(*map(F.lit, values)), lambda c, v: c * v))


def hydropathy_mean_of(counts: Column) -> Column:
    values = [HYDROPATHY[c] for c in RESIDUES]
    return let(_sum(counts), lambda n: F.when(n > 0, _weighted(counts, values) / n))


def hydropathy_mean(text: Column) -> Column:
    return let(residue_counts(text), hydropathy_mean_of)


def hydropathy_deviation_of(counts: Column) -> Column:
    values = [HYDROPATHY[c] for c in RESIDUES]
    of = lambda n: F.sqrt(F.greatest(_weighted(counts, [v * v for v in values]) / n - F.pow(_weighted(counts, values) / n, F.lit(2.0)), F.lit(0.0)))
    return let(_sum(counts), lambda n: F.when(n > 0, of(n)))


def net_charge(text: Column) -> Column:
    return count_of(text, "KR") - count_of(text, "DE")


def longest_run(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(r"(.)\1*"), F.lit(0))
    return F.when(F.length(text) > 0, F.array_max(F.transform(runs, F.length)))
