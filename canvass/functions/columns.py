"""Column builders that every operator shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.DoubleType, T.FloatType)


def finite(c: Column | str) -> Column:
    """The value as double; null where it is NaN or infinite."""
    d = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf")), d)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def code(c: Column, kind: T.DataType) -> Column:
    """The text of a category code: whole numbers without a fraction, strings as they are, non-finite numbers null."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(kind, _FLOATS):
        d = finite(c)
        whole = (d == F.floor(d)) & (F.abs(d) < float(1 << 53))
        return F.when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))
    return c.cast("string")


def mapped(c: Column, table: dict[str, float | int | str]) -> Column:
    """Look a code up in a small table; null where it has none."""
    if not table:
        return F.lit(None)
    pairs = [F.lit(x) for k, v in table.items() for x in (k, v)]
    return F.element_at(F.create_map(*pairs), c)


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval of a proportion."""
    p = ratio(successes, n)
    d = 1 + ratio(F.lit(z * z), n)
    mid = (p + ratio(F.lit(z * z), 2 * n)) / d
    half = z * F.sqrt(ratio(p * (1 - p), n) + ratio(F.lit(z * z), 4 * n * n)) / d
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def signed_noise(key: Column, seed: int, axis: str) -> Column:
    """A number in [-1, 1] that depends on seed, key and axis alone: the jitter of a row's mark.

    32-bit FNV-1a of ``seed|key|axis`` in UTF-8, stirred by one xorshift step.  Null for a null key.
    """
    word = 0xFFFFFFFF
    digits = F.hex(F.encode(F.concat(F.lit(f"{seed}|"), key.cast("string"), F.lit(f"|{axis}")), "UTF-8"))
    octets = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
    h = F.aggregate(octets, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(word))

    def stirred(x: Column) -> Column:
        x = F.when(x == 0, F.lit(1).cast("long")).otherwise(x)
        return x.bitwiseXOR(F.shiftleft(x, 13).bitwiseAND(word))

    # each step is bound to a lambda's variable, so that it is computed once
    once = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)
    x = once(once(h, stirred), lambda x: x.bitwiseXOR(F.shiftright(x, 17)))
    x = once(x, lambda x: x.bitwiseXOR(F.shiftleft(x, 5).bitwiseAND(word)))
    return x / F.lit(float(word)) * 2 - 1
