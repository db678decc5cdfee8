"""Uniform draws that are functions of their names, so that every run and every retry agrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = (1 << 32) + 1


def u(purpose: str, *parts: Column | str | int, seed: int = 0) -> Column:
    """A draw in (0, 1) named by seed, purpose and parts: the first 32 bits of an md5."""
    named = [F.lit(str(seed)), F.lit(purpose), *(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") if isinstance(p, str) else F.lit(str(p)) for p in parts)]
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *named)), 1, 8), 16, 10).cast("long")
    return (bits + 1) / F.lit(float(SPAN))


def u_fast(purpose: str, *parts: Column | str | int, seed: int = 0) -> Column:
    """The same contract with xxhash64, for large simulations; no other engine repeats it."""
    named = [F.lit(seed), F.lit(purpose), *(F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(p) for p in parts)]
    return (F.shiftrightunsigned(F.xxhash64(*named), 32) + 1) / F.lit(float(SPAN))


def u_sql(purpose: str, *parts: str | int, seed: int = 0) -> str:
    """DuckDB text of u()."""
    named = ", ".join([f"'{seed}'", f"'{purpose}'", *map(str, parts)])
    return f"((('0x' || substr(md5(concat_ws(':', {named})), 1, 8))::bigint + 1) / {SPAN}::double)"


def pick(draw: Column, n: Column | int) -> Column:
    """An index 0 .. n-1 from a draw."""
    return F.floor(draw * n).cast("long")


#: A line of numbers is named by two seeds under SEEDS and costs no digest a number: squares modulo a prime.
PRIME, STRIDE, SEEDS = (1 << 31) - 1, 1_103_515_245, 1 << 28


def line_seeds(draw, purpose: str, *parts: Column | str | int) -> Column:
    """The seeds (a, b) of a line, from two draws."""
    return F.struct(pick(draw(f"{purpose}_a", *parts), SEEDS).alias("a"), pick(draw(f"{purpose}_b", *parts), SEEDS).alias("b"))


def line_number(seeds: Column, n: Column) -> Column:
    """The n-th number, 0 .. PRIME - 1, of a line."""
    x = (seeds["a"] + n * STRIDE) % PRIME
    y = x * x % PRIME + seeds["b"]
    return y * y % PRIME


def line_sql(a: str, b: str, n: str) -> str:
    """DuckDB text of line_number()."""
    x = f"(({a} + {n} * {STRIDE}::bigint) % {PRIME})"
    y = f"({x} * {x} % {PRIME} + {b})"
    return f"({y} * {y} % {PRIME})"
