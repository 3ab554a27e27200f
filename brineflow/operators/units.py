"""Quantities recorded in different units, converted to the common unit of their kind.

A small grammar reads unit expressions (prefixes, spelled and abbreviated bases, powers, products, quotients, scale
factors, percentages with a stated basis). A unit is a scale, an offset and two exponent vectors over (amount, mass,
volume, temperature), one for the numerator and one for the denominator, so a volume per volume differs from a pure
number. The vectors decide the kind and so the common unit.

Parsing runs in Arrow batches over the distinct strings of each batch; the arithmetic is native.

Defined results: no unit is stated by null, blank, unitless or a percentage without a basis, nor by an expression the
grammar cannot read or whose kind has no common unit; such rows, and those with a null or NaN quantity, are left out.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache, wraps

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineflow.runtime.session import ship_code, spread

Vector = tuple[int, int, int, int]


@dataclass(frozen=True)
class Unit:
    """value in base units = scale * number + offset; base units are mole, gram, litre and kelvin."""

    scale: float
    up: Vector
    down: Vector
    offset: float = 0.0


#: SI prefixes as powers of ten, spelled and abbreviated.
PREFIXES = {
    "kilo": 3, "k": 3, "deci": -1, "d": -1, "centi": -2, "c": -2, "milli": -3, "m": -3,
    "micro": -6, "u": -6, "μ": -6, "mc": -6, "nano": -9, "n": -9, "pico": -12, "p": -12,
}
_ONE: Vector = (0, 0, 0, 0)
_AMOUNT: Vector = (1, 0, 0, 0)
_MASS: Vector = (0, 1, 0, 0)
_VOLUME: Vector = (0, 0, 1, 0)
_HEAT: Vector = (0, 0, 0, 1)
_MOLAR = Unit(1.0, _AMOUNT, _VOLUME)
#: Base units by their spellings; a letter case that matters is kept.
BASES = {
    "mol": Unit(1.0, _AMOUNT, _ONE), "mole": Unit(1.0, _AMOUNT, _ONE), "moles": Unit(1.0, _AMOUNT, _ONE),
    "M": _MOLAR, "molar": _MOLAR,
    "g": Unit(1.0, _MASS, _ONE), "gram": Unit(1.0, _MASS, _ONE), "grams": Unit(1.0, _MASS, _ONE), "gr": Unit(1.0, _MASS, _ONE),
    "l": Unit(1.0, _VOLUME, _ONE), "L": Unit(1.0, _VOLUME, _ONE),
    "litre": Unit(1.0, _VOLUME, _ONE), "liter": Unit(1.0, _VOLUME, _ONE), "litres": Unit(1.0, _VOLUME, _ONE), "liters": Unit(1.0, _VOLUME, _ONE),
    "K": Unit(1.0, _HEAT, _ONE), "kelvin": Unit(1.0, _HEAT, _ONE),
    "°C": Unit(1.0, _HEAT, _ONE, 273.15), "celsius": Unit(1.0, _HEAT, _ONE, 273.15),
    "°F": Unit(5 / 9, _HEAT, _ONE, 459.67 * 5 / 9), "fahrenheit": Unit(5 / 9, _HEAT, _ONE, 459.67 * 5 / 9),
}
#: Lengths whose cube is a volume, in litres.
CUBED = {"dm": 1.0, "cm": 1e-3, "m": 1e3}
#: Bases of a percentage.
PERCENT_BASES = {"w/v": Unit(10.0, _MASS, _VOLUME), "v/v": Unit(0.01, _VOLUME, _VOLUME), "w/w": Unit(0.01, _MASS, _MASS)}
#: Common unit and factor from base units, by kind.
COMMON = {
    (_AMOUNT, _VOLUME): ("nanomolar", 1e9),
    (_MASS, _VOLUME): ("ug_ml", 1e3),
    (_VOLUME, _VOLUME): ("ppm_v_v", 1e6),
    (_HEAT, _ONE): ("kelvin", 1.0),
}

_PERCENT = {
    "%w/v": "w/v", "w/v%": "w/v", "%wt/vol": "w/v", "wt/vol%": "w/v", "%m/v": "w/v", "m/v%": "w/v", "%wv": "w/v", "percentwv": "w/v", "%wt/v": "w/v",
    "%v/v": "v/v", "v/v%": "v/v", "%vol/vol": "v/v", "vol/vol%": "v/v", "vol%": "v/v", "%vol": "v/v", "%vv": "v/v", "percentvv": "v/v", "volpercent": "v/v",
    "%w/w": "w/w", "w/w%": "w/w", "%wt/wt": "w/w", "wt%": "w/w", "%wt": "w/w", "percentww": "w/w",
}
_TOKEN = re.compile(r"\s*(?:(?P<factor>10\s*\^\s*[-+]?\d+|\d+(?:\.\d+)?)|(?P<over>/|per\b)|(?P<times>[·*×])|(?P<name>°?[^\W\d_]+)\.?(?:\s*\^?\s*(?P<power>[-+]?\d+))?)")
_NAMED = {"mg_ml": "mg/ml", "g_l": "g/l", "ug_ml": "ug/ml", "mg_l": "mg/l", "ng_ml": "ng/ml"}


def _times(a: Unit, b: Unit, power: int) -> Unit:
    up, down = (b.up, b.down) if power > 0 else (b.down, b.up)
    n = abs(power)
    return Unit(a.scale * b.scale**power, tuple(x + n * y for x, y in zip(a.up, up)), tuple(x + n * y for x, y in zip(a.down, down)), b.offset)


def _base(name: str) -> Unit | None:
    for known in (name, name.lower() if len(name) > 2 else name):
        if known in BASES:
            return BASES[known]
    for prefix, power in sorted(PREFIXES.items(), key=lambda x: -len(x[0])):
        rest = name[len(prefix) :]
        if name[: len(prefix)].lower() == prefix and (len(prefix) > 2 or name.startswith(prefix)):
            base = BASES.get(rest) or (BASES.get(rest.lower()) if len(rest) > 1 else None)
            if base and not base.offset:
                return Unit(base.scale * 10.0**power, base.up, base.down)
    return None


def _kept(longest: int):
    """Keeps the results of texts up to a length; longer ones are rare and read each time."""

    def wrap(read):
        kept = lru_cache(maxsize=100_000)(read)
        return wraps(read)(lambda text: kept(text) if text is None or len(text) <= longest else read(text))

    return wrap


@_kept(64)
def parse_unit(text: str | None) -> Unit | None:
    """The unit a text of any length states; None for none, and for numbers that no scale can hold."""
    if not text:
        return None
    try:
        return _parsed(text)
    except (ArithmeticError, ValueError):  # 10^999, division by 0, thousands of digits
        return None


def _parsed(text: str) -> Unit | None:
    text = unicodedata.normalize("NFKC", text).replace("−", "-").replace("µ", "μ").strip()
    text = _NAMED.get(text, text)
    if kind := _PERCENT.get(re.sub(r"[\s()\[\].,_-]", "", text.lower())):
        return PERCENT_BASES[kind]
    text = re.sub(r"(?i)\b(kilo|deci|centi|milli|micro|nano|pico)[\s_-]+(?=mol|gram|lit)", r"\1", text)
    unit, sign, place, named = Unit(1.0, _ONE, _ONE), 1, 0, 0
    while place < len(text):
        m = _TOKEN.match(text, place)
        if not m or m.end() == place:
            return None
        place = m.end()
        if m["over"]:
            sign = -1
        elif m["factor"]:
            f = re.sub(r"\s", "", m["factor"])
            unit = Unit(unit.scale * (10.0 ** int(f[3:]) if "^" in f else float(f)) ** sign, unit.up, unit.down, unit.offset)
        elif m["name"]:
            power = int(m["power"] or 1)
            if abs(power) == 3 and m["name"] in CUBED:
                base, power = Unit(CUBED[m["name"]], _VOLUME, _ONE), power // 3
            else:
                base = _base(m["name"])
            if base is None or not -3 <= power <= 3 or power == 0:
                return None
            unit, named = _times(unit, base, sign * power), named + 1
    return unit if named else None


def common(unit: Unit | None) -> tuple[str, float, float] | None:
    """(common unit, scale, offset) with common = scale * number + offset."""
    if unit is None or (unit.up, unit.down) not in COMMON:
        return None
    name, factor = COMMON[unit.up, unit.down]
    return name, unit.scale * factor, unit.offset * factor


_TRAILING = re.compile(r"(?:\(([^()]*(?:\([^()]*\)[^()]*)?)\)|\[([^\[\]]*)\]|,\s*in\s+(\S.*))\s*$")
_NUMBER = re.compile(r"\s*\d+(?:[.,]\d+)?(?![\w^.,])\s*")


@_kept(400)
def unit_in_name(name: str | None) -> Unit | None:
    """A concentration unit standing before a name of any length (after a number or alone) or behind it (in brackets or after ', in')."""
    if not name:
        return None
    if m := _TRAILING.search(name):
        unit = parse_unit(next(g for g in m.groups() if g is not None))
        if common(unit) and m.start() > 0:
            return unit
    rest = name[m.end() :] if (m := _NUMBER.match(name)) else name.lstrip()
    words = rest.split(None, 5)
    for n in range(min(4, len(words) - 1), 0, -1):
        unit = parse_unit(" ".join(words[:n]))
        if common(unit) and unit.up != _HEAT:
            return unit
    return None


def convert(df: DataFrame, key: str, amount: str, unit: str, inferred: str, name: str) -> DataFrame:
    """(key, common_unit, amount) of every row with a quantity and a stated unit.

    If `unit` is null or inferred, a unit in `name` counts first; otherwise `unit` counts.
    """
    ship_code(df.sparkSession)

    @F.pandas_udf("common_unit string, scale double, shift double")
    def resolve(units: pd.Series, guessed: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = []
        for u, g, n in zip(units, guessed, names):
            found = None
            if u is None or g:
                found = common(unit_in_name(n))
            rows.append(found or common(parse_unit(u)) or (None, None, None))
        return pd.DataFrame(rows, columns=["common_unit", "scale", "shift"])

    narrow = spread(df.select(F.col(key).alias("_key"), F.col(amount).alias("_n"), F.col(unit).alias("_u"), F.col(inferred).alias("_g"), F.col(name).alias("_name"))
                    .where(F.col("_n").isNotNull() & ~F.isnan("_n")))
    found = narrow.select("_key", "_n", resolve(F.col("_u"), F.coalesce("_g", F.lit(False)), F.col("_name")).alias("_r"))
    return found.where(F.col("_r.common_unit").isNotNull()).select(
        F.col("_key").alias(key),
        F.col("_r.common_unit").alias("common_unit"),
        F.round(F.col("_n") * F.col("_r.scale") + F.col("_r.shift")).cast("bigint").alias("amount"),
    )
