"""Vector arithmetic on array columns, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def _d(a: Column | str) -> Column:
    return (F.col(a) if isinstance(a, str) else a).cast(DOUBLES)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_d(a), _d(b), lambda x, y: x + y)


def sub(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_d(a), _d(b), lambda x, y: x - y)


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.transform(sub(a, b), lambda x: x * x)))


def l2_normalize(a: Column | str) -> Column:
    """The unit vector; a zero vector stays as it is."""
    # Bound in lambdas: otherwise the vector and its norm are computed anew for each component.
    by = lambda v, n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)
    unit = lambda v: F.get(F.transform(F.array(l2_norm(v)), lambda n: by(v, n)), F.lit(0))
    return F.get(F.transform(F.array(_d(a)), unit), F.lit(0))


def is_padding(a: Column | str) -> Column:
    """Whether every component is zero: the mark of a padded query token."""
    return ~F.exists(_d(a), lambda x: x != 0)


def bucketize(a: Column | str, cutoffs: Column) -> Column:
    """For each component the number of cutoffs strictly below it; one equal to a cutoff goes low."""
    return F.transform(_d(a), lambda v: F.size(F.filter(cutoffs, lambda c: c < v)))


def weights_of(codes: Column | str, weights: Column) -> Column:
    return F.transform(codes, lambda i: F.get(weights, i))


def pack_hex(codes: Column | str, nbits: int) -> Column:
    """Codes as upper-case hex digits, first dimension in the highest bits."""
    per = 4 // nbits
    codes = F.col(codes) if isinstance(codes, str) else codes
    digit = lambda i: sum((F.get(codes, i * per + j) * 2 ** (nbits * (per - 1 - j)) for j in range(1, per)), F.get(codes, i * per) * 2 ** (nbits * (per - 1)))
    return F.array_join(F.transform(F.sequence(F.lit(0), (F.size(codes) / per).cast("int") - 1), lambda i: F.hex(digit(i).cast("long"))), "")


def pack(codes: Column | str, nbits: int) -> Column:
    return F.unhex(pack_hex(codes, nbits))


def register(spark: SparkSession) -> None:
    """The same functions under SQL names."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(a, 0D, (s, x) -> s + x * x))")
