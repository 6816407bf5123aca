"""Corrosion-defect failure pressure: six published equations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ("b31g", "mb31g", "ng18", "rstreng", "lpc1", "shell92")
PSI_PER_KPA, SOP_FACTOR, CUTOFF = 0.14503774, 0.8, 0.8


def positive(**values: float | None) -> None:
    """Scalar inputs must be positive; a missing optional one passes."""
    wrong = {k: v for k, v in values.items() if v is not None and not v > 0}
    if wrong:
        raise ValueError(f"must be positive: {wrong}")


def not_positive(**columns: Column) -> Column:
    """For inputs of each row: the names of those given ones that aren't positive, in order; empty where all is well."""
    return F.filter(F.array(*(F.when(c.isNotNull() & (F.isnan(c.cast("double")) | (c <= 0)), F.lit(k)) for k, c in columns.items())), lambda x: x.isNotNull())


def folias_factor(diameter: Column, wall: Column, length: Column, method: str = "mb31g") -> Column:
    z = length * length / (diameter * wall)
    inner = F.lit(1.0) + z * 0.6275 - z * z * 0.003375
    root = F.when(inner >= 0, F.sqrt(inner))
    if method == "b31g":
        return F.when(z <= 20, F.sqrt(F.lit(1.0) + z * 0.8))
    if method == "ng18":
        return root
    if method in ("mb31g", "rstreng"):
        return F.when(z <= 50, root).otherwise(z * 0.032 + 3.3)
    if method == "lpc1":
        return F.sqrt(F.lit(1.0) + z * 0.31)
    if method == "shell92":
        return F.sqrt(F.lit(1.0) + z * 0.8)
    raise ValueError(f"unknown method {method!r}; one of {METHODS}")


def flow_stress(yield_strength: Column, method: str | None = None, flow: Column | None = None) -> tuple[str, Column]:
    """The default is mb31g with yield + 69 MPa; a method needs a flow stress, and a flow stress a method."""
    if method is None and flow is None:
        return "mb31g", yield_strength + 69.0
    if method is None or flow is None:
        raise ValueError("give method and flow stress together, or neither")
    return method, flow


def remaining_strength(depth: Column, length: Column, diameter: Column, wall: Column, method: str, area_ratio: Column | None = None, folias: Column | None = None) -> Column:
    """``folias``: the factor, where the caller has it already."""
    m, r = folias if folias is not None else folias_factor(diameter, wall, length, method), depth / wall
    if method == "rstreng":
        if area_ratio is None:
            raise ValueError("rstreng needs the area ratio")
        r = area_ratio
    share = {"b31g": 2.0 / 3.0, "mb31g": 0.85}.get(method, 1.0)
    loss = r * share
    rs = F.try_divide(F.lit(1.0) - loss, F.lit(1.0) - loss / m)
    return F.when(m.isNull(), F.lit(1.0) - r).otherwise(rs) if method == "b31g" else rs


def failure_pressure(depth: Column, length: Column, diameter: Column, wall: Column, yield_strength: Column, method: str | None = None, flow: Column | None = None, area_ratio: Column | None = None, folias: Column | None = None) -> Column:
    """kPa."""
    method, flow = flow_stress(yield_strength, method, flow)
    rs = remaining_strength(depth, length, diameter, wall, method, area_ratio, folias)
    return flow * 2.0 / (diameter / wall) * rs * 1000.0


def failure_stress(depth: Column, length: Column, diameter: Column, wall: Column, yield_strength: Column, method: str | None = None, flow: Column | None = None, area_ratio: Column | None = None) -> Column:
    """kPa."""
    method, flow = flow_stress(yield_strength, method, flow)
    return flow * remaining_strength(depth, length, diameter, wall, method, area_ratio) * 1000.0


def with_tolerance(depth_pct: Column, length: Column, wall: Column, depth_tolerance: float, length_tolerance: float) -> tuple[Column, Column]:
    """Depth in mm and length in mm."""
    return (depth_pct + depth_tolerance) * 0.01 * wall, length + length_tolerance


def banded_rate(depth_pct: Column, rate: float, low: float | None = None, mid: float | None = None, high: float | None = None) -> Column:
    of = {k: float(rate if v is None else v) for k, v in (("low", low), ("mid", mid), ("high", high))}
    return F.when(depth_pct < 20, of["low"]).when(depth_pct <= 40, of["mid"]).otherwise(of["high"])


def years_to_defect(depth: Column, wall: Column, rate: Column) -> Column:
    """Null where the rate isn't positive: never."""
    return F.when(rate > 0, F.greatest(F.try_divide(wall * CUTOFF - depth, rate), F.lit(0.0)))


def date_of_defect(reference: Column, years: Column) -> Column:
    """Null beyond what a timestamp holds."""
    seconds = F.when(years < 7000, years) * 365.25 * 86400.0
    return F.timestamp_micros(F.unix_micros(reference.cast("timestamp")) + (seconds * 1e6).cast("long"))
