"""Transformers of feature columns: native projections with names of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the smallest normal double.
LEAST = 2.2250738585072014e-308


def clipped_lg(x: Column, floor: float | None = None) -> Column:
    low = F.log10(F.lit(LEAST)) if floor is None else F.lit(floor)
    return F.when(x < LEAST, low).otherwise(F.log10(x))


_SIMPLE = {"identity": lambda x: x, "arcsinh": F.asinh, "ln1p": F.log1p, "lg": F.log10, "sqrt": F.sqrt, "clipped_lg": clipped_lg}


def apply(kind: str, columns: list[str]) -> list[Column]:
    """One of identity, arcsinh, ln1p, lg, sqrt, clipped_lg, of each column."""
    return [_SIMPLE[kind](F.col(c)).alias(c if kind == "identity" else f"{kind}_{c}") for c in columns]


def composed(parts: list[tuple[str, list[str]]]) -> list[Column]:
    """Transformers side by side, each with its columns."""
    return [c for kind, columns in parts for c in apply(kind, columns)]


def fit_magnitudes(model: str, zero_point: float = 8.9) -> list[Column]:
    """Magnitude and ratio columns from those of a curve fit: bazin, linexp or villar."""
    col = lambda c: F.col(f"{model}_fit_{c}")
    magnitude = F.lit(zero_point) - 2.5 * F.log10(2 * col("amplitude"))
    share = F.try_divide(col("baseline"), col("amplitude"))
    chi2 = F.log1p(col("reduced_chi2")).alias(f"ln1p_{model}_fit_reduced_chi2")
    if model == "linexp":
        return [magnitude.alias("linexp_fit_amplitude"), col("fall_time"), share.alias("linexp_fit_baseline"), chi2]
    more = [col("plateau_rel_amplitude"), col("plateau_duration")] if model == "villar" else []
    return [magnitude.alias(f"{model}_fit_mag_full_amplitude"), share.alias(f"{model}_fit_baseline_amplitude_ratio"), col("rise_time"), col("fall_time"), *more, chi2]
