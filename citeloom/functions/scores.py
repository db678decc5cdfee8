"""Scores, decay, bins and quotas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the model.
GAMMA = 3.0
FITNESS_DECAY = 3
FITNESS_POWER = -3.0
MAX_CITATIONS = 1500


def power_score(x: Column, gamma: float = GAMMA) -> Column:
    return F.greatest(F.pow(x.cast("double"), F.lit(gamma)), F.lit(1.0)) + 1.0


def tanh_score(x: Column, peak: float, delay: float) -> Column:
    return F.lit(peak) * F.tanh(F.pow(x.cast("double"), F.lit(GAMMA)) / delay * (1.0 / peak))


def decayed_fitness(value: Column, year: Column, lag: Column, duration: Column, now: Column | int, decay: int = FITNESS_DECAY) -> Column:
    """1 before the lag has passed, the peak value while it lasts, then value / age^decay, truncated."""
    t = F.lit(now) if isinstance(now, int) else now
    past = t - year - lag - duration + 1
    faded = F.floor(value / F.pow(F.greatest(past, F.lit(1)).cast("double"), F.lit(float(decay)))).cast("int")
    return F.when(year + lag > t, F.lit(1)).when(year + lag + duration >= t, value.cast("int")).otherwise(faded)


def peak_fitness(draw: Column, low: int, high: int, power: float = FITNESS_POWER) -> Column:
    """A power-law draw between low and high."""
    p = power + 1
    spread = F.lit(float(high) ** p - float(low) ** p) * draw + F.lit(float(low) ** p)
    return F.floor(F.pow(spread, F.lit(1 / p))).cast("int")


def bin_index(age: Column, bounds: list[int]) -> Column:
    """Half-open bins [b, next b); ages under the first bound or past the last one go to the last bin."""
    last = len(bounds) - 1
    found = F.lit(last)
    for i in range(last - 1, -1, -1):
        found = F.when((age >= bounds[i]) & (age < bounds[i + 1]), F.lit(i)).otherwise(found)
    return found


def weighted_key(draw: Column, score: Column) -> Column:
    """The key of weighted sampling without replacement: the k largest are a weighted sample."""
    return F.log(draw) / score


def hop_split(total: Column, alpha: Column, near: Column, far: Column) -> tuple[Column, Column]:
    """Citations for hops 1 and 2 out of total, clamped to the hops' sizes."""
    t = F.least(near + far, total)
    first = F.least(F.floor(t * alpha).cast("int"), near)
    return first.cast("int"), F.least(t - first, far).cast("int")


def int_list(column: Column) -> Column:
    return F.array_join(column.cast("array<string>"), ";")


def parse_int_list(column: Column) -> Column:
    return F.when(F.length(column) > 0, F.split(column, ";").cast("array<int>")).otherwise(F.array().cast("array<int>"))


def elapsed(seconds: int) -> str:
    """d-h:m:s"""
    days, rest = divmod(int(seconds), 86400)
    hours, rest = divmod(rest, 3600)
    return f"{days}-{hours}:{rest // 60}:{rest % 60}"
