"""Reproducible integer draws in plain bigint arithmetic, the same in any SQL engine.

Resampling needs millions of draws per table; a sha-256 per draw would dominate the job. The mixing
below stays under 2**62, so it neither overflows nor leaves whole-stage code generation.
"""

from __future__ import annotations

P = 2147483647


def mix_sql(a: str, b: str, seed: int = 0) -> str:
    """SQL expression of a well-mixed number in [0, P) for the pair of bigint expressions (a, b)."""
    x1 = f"((({a})*1000003 + ({b})*7919 + {seed * 31 + 1}) % {P})"
    x2 = f"(({x1}*48271 + 11) % {P})"
    x3 = f"(({x2}*{x2} + 12345) % {P})"
    x4 = f"(({x3}*69621 + {x1}) % {P})"
    return f"(({x4}*{x4} + 54321) % {P})"


def draw_sql(a: str, b: str, n: str, seed: int = 0) -> str:
    """A draw in [0, n)."""
    return f"({mix_sql(a, b, seed)} % ({n}))"
