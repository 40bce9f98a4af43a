"""Quantities with units, and tables of the elements. Internal units: nm, ps, degrees, nm^2, Da."""

from __future__ import annotations

import math
import re

QUANTITY = re.compile(r"\s*([+-]?[0-9]+(?:\.[0-9]+)?)\s*([A-Za-z][A-Za-z0-9]*)\s*")

#: The size of each unit in the internal one.
DISTANCE = {"nm": 1.0, "a": 0.1, "angstrom": 0.1}
DURATION = {"fs": 0.001, "ps": 1.0, "ns": 1000.0, "us": 1000000.0}
ANGLE = {"deg": None, "degree": None, "degrees": None, "rad": 180.0, "radian": 180.0, "radians": 180.0}
AREA = {"nm2": 1.0, "a2": 0.01, "angstrom2": 0.01}

#: Abridged standard atomic weights in Da; elements without one are unknown.
ATOMIC_MASS = {
    "H": 1.0080, "HE": 4.0026, "LI": 6.94, "BE": 9.0122, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "NE": 20.180,
    "NA": 22.990, "MG": 24.305, "AL": 26.982, "SI": 28.085, "P": 30.974, "S": 32.06, "CL": 35.45, "AR": 39.95, "K": 39.098, "CA": 40.078,
    "SC": 44.956, "TI": 47.867, "V": 50.942, "CR": 51.996, "MN": 54.938, "FE": 55.845, "CO": 58.933, "NI": 58.693, "CU": 63.546, "ZN": 65.38,
    "GA": 69.723, "GE": 72.630, "AS": 74.922, "SE": 78.971, "BR": 79.904, "KR": 83.798, "RB": 85.468, "SR": 87.62, "Y": 88.906, "ZR": 91.222,
    "NB": 92.906, "MO": 95.95, "RU": 101.07, "RH": 102.91, "PD": 106.42, "AG": 107.87, "CD": 112.41, "IN": 114.82, "SN": 118.71, "SB": 121.76,
    "TE": 127.60, "I": 126.90, "XE": 131.29, "CS": 132.91, "BA": 137.33, "LA": 138.91, "CE": 140.12, "PR": 140.91, "ND": 144.24, "SM": 150.36,
    "EU": 151.96, "GD": 157.25, "TB": 158.93, "DY": 162.50, "HO": 164.93, "ER": 167.26, "TM": 168.93, "YB": 173.05, "LU": 174.97, "HF": 178.49,
    "TA": 180.95, "W": 183.84, "RE": 186.21, "OS": 190.23, "IR": 192.22, "PT": 195.08, "AU": 196.97, "HG": 200.59, "TL": 204.38, "PB": 207.2,
    "BI": 208.98, "TH": 232.04, "PA": 231.04, "U": 238.03,
}
#: Van der Waals radii in nm.
VDW_RADIUS = {"H": 0.120, "C": 0.170, "N": 0.155, "O": 0.152, "F": 0.147, "SI": 0.210, "P": 0.180, "S": 0.180, "CL": 0.175, "BR": 0.185, "I": 0.198}


def split(text: str) -> tuple[float, str]:
    m = QUANTITY.fullmatch(text)
    if not m:
        raise ValueError(f"Expected a number with an explicit unit, received '{text}'")
    return float(m[1]), m[2]


def _scaled(text: str, units: dict, kind: str, others: dict | None = None, other_kind: str = "") -> float:
    value, unit = split(text)
    name = unit.lower()
    if name in units:
        return value * units[name] if units[name] != 1.0 else value
    if others and name in others:
        raise ValueError(f"{kind} expected, received {other_kind} unit '{unit}'")
    raise ValueError(f"Unknown {kind.lower()} unit '{unit}'")


def parse_distance(text: str) -> float:
    return _scaled(text, DISTANCE, "Distance", DURATION, "time")


def parse_duration(text: str) -> float:
    return _scaled(text, DURATION, "Time", DISTANCE, "distance")


def parse_angle(text: str) -> float:
    value, unit = split(text)
    if unit.lower() not in ANGLE:
        raise ValueError(f"Unknown angle unit '{unit}'")
    half_turn = ANGLE[unit.lower()]
    return value if half_turn is None else value * half_turn / math.pi


def parse_area(text: str) -> float:
    return _scaled(text, AREA, "Area")


def standard_atomic_mass_da(element: str) -> float:
    """The mass of an element, 0.0 if it has none."""
    return ATOMIC_MASS.get(element.strip().upper(), 0.0)


def short(value: float) -> str:
    """A number in six significant digits."""
    return f"{value:g}"


def parse_duration_ps(text: str) -> float:
    return parse_duration(text)
