"""Column expressions: tokenising text and arithmetic on topic vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters of the default vectoriser pattern, in Unicode form.
WORD_PATTERN = r"([\p{L}\p{N}_]{2,})"
# Hyphenated or apostrophised words stay whole, every other mark is its own token.
ACRONYM_TOKEN_PATTERN = r"([\p{L}\p{N}_]+(?:[-'][\p{L}\p{N}_]+)*|[^\s])"


def space_tokens(text: Column) -> Column:
    """Lower-case and split on each single space; empty tokens stay."""
    return F.split(F.lower(text), " ", -1)


def word_tokens(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), 1)


def acronym_tokens(text: Column) -> Column:
    """Lower-case words and single marks, the form acronyms are looked up in."""
    return F.regexp_extract_all(F.lower(text), F.lit(ACRONYM_TOKEN_PATTERN), 1)


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, not once per element of a lambda in the body."""
    return F.transform(F.array(value), body)[0]


def unit(vector: Column) -> Column:
    """Vector scaled to length 1; a zero vector stays zero."""

    def scaled(v: Column) -> Column:
        return let(
            F.sqrt(dot(v, v)), lambda norm: F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)
        )

    return let(vector, scaled)


def rounded(x: Column, digits: int) -> Column:
    """``F.round`` of doubles, with its decimal arithmetic only for values next to a half or beyond 10^6."""
    scale = F.lit(10.0**digits)
    lifted = F.abs(x) * scale
    off_half = F.abs(lifted - F.floor(lifted) - 0.5) > 1e-3
    near = F.signum(x) * (F.floor(lifted + 0.5) / scale) + F.lit(0.0)  # no negative zero
    return F.when((F.abs(x) < 1e6) & off_half, near).otherwise(F.round(x, digits))


def zeros(k: int) -> Column:
    return F.array_repeat(F.lit(0.0), k)


def minmax_percent(vector: Column) -> Column:
    """(x - min) / (max - min), then to percent of the sum, two decimals; null if constant."""

    def percent(lifted: Column) -> Column:
        return let(
            total(lifted),
            lambda share: F.when(
                share > 0, F.transform(lifted, lambda x: F.bround(x / share * 100, 2))
            ),
        )

    lifted = let(F.array_min(vector), lambda low: F.transform(vector, lambda x: x - low))
    return let(lifted, percent)


def percent_or_first(vector: Column) -> Column:
    """Percent of the sum; a vector without a positive entry counts fully for topic 0."""
    first = F.transform(vector, lambda x, i: F.when(i == 0, 100.0).otherwise(0.0))
    return F.when(F.exists(vector, lambda x: x > 0), row_percent(vector)).otherwise(first)


def row_percent(vector: Column) -> Column:
    """Percent of the sum; a vector that sums to zero stays as it is."""
    return let(
        total(vector),
        lambda share: F.when(
            share != 0, F.transform(vector, lambda x: x / share * 100)
        ).otherwise(vector),
    )


def dominant(vector: Column) -> Column:
    """Position of the largest entry, the first one on ties."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")
