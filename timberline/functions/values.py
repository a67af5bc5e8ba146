"""Values that queries interpret: durations, exact decimals, timestamps and steps.

The functions here parse literals on the driver; `duration_ns` and `decimal_compare`
do the same for columns, as expressions that stay in the JVM.
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal, InvalidOperation, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F

I64 = (-(1 << 63), (1 << 63) - 1)

#: Duration units in nanoseconds, in the order in which they are tried.
UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 604800 * 10**9}
_COMPONENT = r"([0-9]+\.?[0-9]*|\.[0-9]+)(ns|us|µs|ms|s|m|h|d|w)"
_COMPONENTS = re.compile(_COMPONENT)
_DURATION = re.compile(f"(?:{_COMPONENT})+")
_NUMBER = re.compile(r"([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]+))?")
#: Largest scale and coefficients of a decimal.
MAX_SCALE, MAX_COEFFICIENT = 1024, (1 << 127) - 1


class ValueProblem(ValueError):
    """A literal that has no meaning."""


def duration(text: str) -> int:
    """Nanoseconds of a compound duration such as 1h30m; fractions below a nanosecond are cut off."""
    text = text.strip()
    if not _DURATION.fullmatch(text):
        raise ValueProblem(f"invalid duration {text!r}")
    total = 0
    for number, unit in _COMPONENTS.findall(text):
        whole, _, fraction = number.partition(".")
        total += int(f"{whole}{fraction}") * UNITS[unit] // 10 ** len(fraction)
    if total > I64[1]:
        raise ValueProblem(f"duration {text!r} is out of range")
    return total


def decimal(text: str) -> Decimal:
    """An exact number; no NaN, no infinity."""
    text = text.strip()
    m = _NUMBER.fullmatch(text)
    if not m or not (m[2] or m[3]):
        raise ValueProblem(f"invalid number {text!r}")
    digits = f"{m[2]}{m[3] or ''}".lstrip("0")
    scale = len(m[3] or "") - int(m[4] or 0)
    if digits and (int(digits) > MAX_COEFFICIENT or abs(scale) > MAX_SCALE):
        raise ValueProblem(f"number {text!r} is out of range")
    with localcontext(prec=60, Emax=10**6, Emin=-(10**6)):
        try:
            return Decimal(f"{m[1]}{digits or 0}E{-scale}") if digits else Decimal(0)
        except InvalidOperation as e:
            raise ValueProblem(f"invalid number {text!r}") from e


def canonical(text: str) -> tuple[int, int, str]:
    """(sign, magnitude, digits) of 0.digits * 10**magnitude, by which numbers are compared."""
    sign, digits, exponent = decimal(text).as_tuple()
    run = "".join(map(str, digits)).lstrip("0")
    if not run:
        return 0, 0, ""
    return (-1 if sign else 1), len(run) + int(exponent), run.rstrip("0")


def seconds(text: str) -> int:
    """Nanoseconds of exact decimal seconds; fractions below a nanosecond are refused."""
    with localcontext(prec=2200, Emax=10**6, Emin=-(10**6)):
        ns = decimal(text) * 10**9
        if ns != ns.to_integral_value() or not I64[0] <= ns <= I64[1]:
            raise ValueProblem(f"{text!r} is not a whole number of nanoseconds")
        return int(ns)


_RFC3339 = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(?:\.(\d+))?([Zz]|[+-]\d\d:\d\d)")


def timestamp(text: str) -> int:
    """Nanoseconds since the epoch; for integers the number of digits tells the unit."""
    text = text.strip()
    if re.fullmatch(r"[+-]?[0-9]+", text):
        digits = len(text.lstrip("+-"))
        unit = {13: 10**6, 16: 10**3, 19: 1}.get(digits, 10**9 if digits <= 10 else None)
        if unit is None or not I64[0] <= int(text) * unit <= I64[1]:
            raise ValueProblem(f"invalid timestamp {text!r}")
        return int(text) * unit
    if m := _RFC3339.fullmatch(text):
        fraction = m[7] or ""
        try:
            day = dt.datetime(*(int(m[i]) for i in range(1, 7)), tzinfo=dt.UTC)
        except ValueError as e:
            raise ValueProblem(f"invalid timestamp {text!r}") from e
        offset = 0 if m[8] in "Zz" else (1 if m[8][0] == "+" else -1) * (int(m[8][1:3]) * 3600 + int(m[8][4:6]) * 60)
        whole = (day - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(seconds=1) - offset
        return whole * 10**9 + int(f"{fraction:0<9}"[:9])
    try:
        return seconds(text)
    except ValueProblem as e:
        raise ValueProblem(f"invalid timestamp {text!r}") from e


def step(text: str | None) -> int:
    """Nanoseconds of a grid's step: plain numbers are seconds; the default is one second."""
    if text is None:
        return 10**9
    try:
        ns = round(float(text) * 1e9)
    except (ValueError, OverflowError):
        ns = duration(text)
    if ns <= 0 or ns > I64[1]:
        raise ValueProblem("the step is to be positive")
    return ns


def trace_duration(text: str) -> int:
    """Nanoseconds: a plain number is seconds, at least 0."""
    try:
        ns = seconds(text)
    except ValueProblem:
        return duration(text)
    if ns < 0:
        raise ValueProblem(f"negative duration {text!r}")
    return ns


# --------------------------------------------------------------- for columns


def duration_ns(value: Column) -> Column:
    """Nanoseconds of a duration in a string column; null where it is none."""
    v = F.trim(value)
    parts = F.regexp_extract_all(v, F.lit(_COMPONENT), F.lit(0))

    def one(part: Column) -> Column:
        unit = F.regexp_extract(part, _COMPONENT, 2)
        number = F.regexp_extract(part, _COMPONENT, 1).try_cast("decimal(38,18)")
        scale = F.lit(None).cast("decimal(15,0)")
        for name, ns in UNITS.items():
            scale = F.when(unit == name, F.lit(ns).cast("decimal(15,0)")).otherwise(scale)
        return F.floor(F.try_multiply(number, scale)).try_cast("long")

    total = F.aggregate(F.transform(parts, one), F.lit(0).cast("long"), lambda a, b: F.try_add(a, b))
    return F.when(v.rlike(f"^(?:{_COMPONENT})+\\z"), total)


def decimal_compare(value: Column, literal: str) -> Column:
    """-1, 0 or 1 as the exact number in a string column is below, at or above the literal; null where it is none."""
    sign, magnitude, digits = canonical(literal)
    v = F.trim(value)
    part = lambda i: F.regexp_extract(v, r"^([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]+))?\z", i)
    run = F.regexp_replace(F.concat(part(2), part(3)), "^0+", "")
    exponent = F.when(part(4) == "", F.lit(0)).otherwise(part(4).try_cast("int"))
    scale = F.length(part(3)) - exponent
    limit = str(MAX_COEFFICIENT)
    valid = v.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z") & exponent.isNotNull() & (
        (run == "") | ((F.abs(scale) <= MAX_SCALE) & ((F.length(run) < len(limit)) | ((F.length(run) == len(limit)) & (run <= limit))))
    )
    own_sign = F.when(run == "", 0).when(part(1) == "-", -1).otherwise(1)
    own_magnitude, own_digits = F.length(run) - scale, F.regexp_replace(run, "0+$", "")
    by_size = F.when(own_magnitude < magnitude, -1).when(own_magnitude > magnitude, 1).when(own_digits < digits, -1).when(own_digits > digits, 1).otherwise(0)
    order = F.when(own_sign < sign, -1).when(own_sign > sign, 1).when(F.lit(sign == 0), 0).otherwise(by_size * sign)
    return F.when(valid, order)


def finite_double(value: Column) -> Column:
    """A string column as a finite number; null where it is none."""
    v = F.trim(value)
    number = F.when(v.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), v.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


# ------------------------------------------------------------ output formats


def sample_text(value: float) -> str:
    """A sample as text: no exponent, no trailing .0, zero without a sign."""
    if value != value:
        return "NaN"
    if value in (float("inf"), float("-inf")):
        return "inf" if value > 0 else "-inf"
    if value == 0:
        return "0"
    text = format(Decimal(repr(value)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def seconds_text(ns: int) -> str:
    """Nanoseconds as decimal seconds, exactly, without trailing zeros."""
    sign, ns = ("-", -ns) if ns < 0 else ("", ns)
    whole, fraction = divmod(ns, 10**9)
    return f"{sign}{whole}" + (f".{fraction:09d}".rstrip("0") if fraction else "")
