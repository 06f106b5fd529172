"""Vector arithmetic as columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors and those of norm zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) > 0) & (n > 0), dot(a, b) / n).otherwise(0.0)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(_double(a), lambda x: x / n)).otherwise(_double(a))


def unit_if_needed(a: Column, slack: float = 1e-3) -> Column:
    return F.when(F.abs(norm(a) - 1) > slack, unit(a)).otherwise(_double(a))


def distance_score(distance: Column) -> Column:
    return 1 / (1 + distance)


def root_mean_square(samples: Column) -> Column:
    """0 for no samples."""
    return F.when(F.size(samples) > 0, F.sqrt(F.aggregate(_double(samples), F.lit(0.0), lambda s, x: s + x * x) / F.size(samples))).otherwise(0.0)


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(_double(samples), F.abs)), F.lit(0.0))


def resampled(samples: Column, rate_in: Column, rate_out: Column) -> Column:
    """Linear interpolation at positions i x rate_in / rate_out; samples as they are where the rates agree or there are none."""
    ratio = rate_in / rate_out
    n = F.floor(F.size(samples) / ratio).cast("int")
    last = F.size(samples) - 1

    def at(i: Column) -> Column:
        where = i * ratio
        low = F.least(F.floor(where).cast("int"), last)
        high = F.least(low + 1, last)
        share = where - low
        return F.get(samples, low) * (1 - share) + F.get(samples, high) * share

    return F.when((F.size(samples) == 0) | (rate_in == rate_out), _double(samples)).when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>"))


def pcm16(samples: Column) -> Column:
    """Samples clamped to -1..1 and scaled to 16 bits, toward zero."""
    return F.transform(_double(samples), lambda x: F.when(x < 0, F.greatest(x, F.lit(-1.0)) * 32768).otherwise(F.least(x, F.lit(1.0)) * 32767).cast("int"))


def interleaved(left: Column, right: Column) -> Column:
    """Left and right samples in turn, as far as the shorter goes."""
    n = F.least(F.size(left), F.size(right))
    return F.flatten(F.zip_with(F.slice(left, 1, n), F.slice(right, 1, n), lambda x, y: F.array(x, y)))


def deinterleaved(samples: Column, channel: int) -> Column:
    """One channel of a two-channel frame array; a last sample without partner is dropped."""
    even = F.slice(samples, 1, F.size(samples) - F.size(samples) % 2)
    return F.filter(even, lambda _, i: i % 2 == channel)
