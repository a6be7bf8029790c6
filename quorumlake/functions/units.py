"""A subset of UCUM: unit atoms with their dimension and factor."""

from __future__ import annotations

from fractions import Fraction

from quorumlake.model import Refusal

#: Dimension and exact factor to its base of each unit.
UNITS = {
    "1": ("number", "1"), "%": ("number", "0.01"),
    "s": ("time", "1"), "min": ("time", "60"), "h": ("time", "3600"), "d": ("time", "86400"), "wk": ("time", "604800"), "mo": ("time", "2629800"), "a": ("time", "31557600"),
    "g": ("mass", "1"), "kg": ("mass", "1000"), "mg": ("mass", "1e-3"), "ug": ("mass", "1e-6"),
    "m": ("length", "1"), "cm": ("length", "0.01"), "mm": ("length", "1e-3"), "km": ("length", "1000"),
    "L": ("volume", "1"), "mL": ("volume", "1e-3"), "dL": ("volume", "0.1"),
    "K": ("temperature", "1"),
}


def factor(given: str, wanted: str) -> float:
    """What a number in ``given`` is multiplied by to be in ``wanted``: the exact ratio, rounded once."""
    if given == wanted:
        return 1.0
    if given not in UNITS or wanted not in UNITS or UNITS[given][0] != UNITS[wanted][0]:
        raise Refusal("UNITS_INCOMPATIBLE", f"{given} to {wanted}")
    return float(Fraction(UNITS[given][1]) / Fraction(UNITS[wanted][1]))
