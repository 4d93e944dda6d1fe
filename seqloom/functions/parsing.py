"""Parameters written as text, parsed when a plan is built."""

from __future__ import annotations

import re


def gc_parameters(text: str) -> dict:
    """35%, 35%/20bp, 5-55% and 5-55%/400bp, as mini, maxi, target and window."""
    m = re.fullmatch(r"\s*([\d.]+)\s*(?:-\s*([\d.]+))?\s*%\s*(?:/\s*(\d+)\s*(?:bp)?)?\s*", text)
    if not m:
        raise ValueError(f"no GC content: {text!r}")
    low, high, window = m[1], m[2], int(m[3]) if m[3] else None
    if high is None:
        return {"mini": None, "maxi": None, "target": float(low) / 100, "window": window}
    return {"mini": float(low) / 100, "maxi": float(high) / 100, "target": None, "window": window}


def temperature_range(text: str) -> tuple[float, float]:
    """50-70C as (50, 70)."""
    m = re.fullmatch(r"\s*([\d.]+)\s*-\s*([\d.]+)\s*°?\s*C?\s*", text)
    if not m:
        raise ValueError(f"no temperature range: {text!r}")
    return float(m[1]), float(m[2])


def percentage(text: str) -> float:
    """40% as 40.0."""
    if not (m := re.fullmatch(r"\s*([\d.]+)\s*%\s*", text)):
        raise ValueError(f"no percentage: {text!r}")
    return float(m[1])


def number(text: str) -> int | float | str:
    """A whole number, a number, or the text itself."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def location(text: str) -> tuple[int, int, int]:
    """5-10(+) as (5, 10, 1); without a sign the strand is +1."""
    m = re.fullmatch(r"(-?\d+)-(\d+)(?:\(([+-])\))?", text.strip())
    if not m:
        raise ValueError(f"no location: {text!r}")
    return int(m[1]), int(m[2]), -1 if m[3] == "-" else 1


def pretty(values: dict, digits: int = 2) -> str:
    """The entries of a dict as text, numbers rounded, also inside of dicts."""
    def shown(v):
        if isinstance(v, float):
            return f"{round(v, digits):g}"
        return pretty(v, digits) if isinstance(v, dict) else str(v)

    return ", ".join(f"{k}: {shown(v)}" for k, v in values.items())


def rounded(values, digits: int = 2):
    """values with every float rounded, at any depth of dicts and lists."""
    if isinstance(values, dict):
        return {k: rounded(v, digits) for k, v in values.items()}
    if isinstance(values, (list, tuple)):
        return type(values)(rounded(v, digits) for v in values)
    return round(values, digits) if isinstance(values, float) else values
