"""Constants, and numbers and bins as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING, NOT_MISSING, EPSILON = "__MISSING__", "__NOT_MISSING__", 1e-6
#: Suffix of the column that holds a label's place: 0 for missing, then 1 and up.
ORD = "__ord"


def accuracy(number: float) -> int:
    """Significant decimals of a number as Python prints it."""
    _, _, decimals = str(number).partition(".")
    return len(decimals.rstrip("0"))


def round_number(value: float, digits: int) -> float | int:
    """Rounded half to even; whole numbers as int when no digits stay."""
    value = round(value, digits)
    return value if digits else int(value)


def number_text(number: float) -> str:
    """A number with underscores between thousands; the sign stays in front."""
    whole, dot, decimals = str(abs(number)).partition(".")
    grouped = f"{int(whole):_}" if whole.isdigit() else whole
    return ("-" if number < 0 else "") + grouped + dot + decimals


def bin_labels(cutoffs: Sequence[float], legacy: bool = False) -> list[str]:
    """Labels of right-closed bins between ascending inner cutoffs; none: one label for all that is not missing."""
    if not cutoffs:
        return ["Not Missing" if legacy else NOT_MISSING]
    c = [number_text(x) for x in cutoffs]
    first, last = (f"[<={c[0]}]", f"(>{c[-1]}]") if legacy else (f"<= {c[0]}", f"> {c[-1]}")
    middle = [f"({a}, {b}]" if legacy else f"({a}; {b}]" for a, b in zip(c, c[1:], strict=False)]
    return [first, *middle, last]


def bin_place(c: Column, cutoffs: Sequence[float]) -> Column:
    """0 for null, else the 1-based bin."""
    out = F.lit(len(cutoffs) + 1)
    for i in range(len(cutoffs), 0, -1):
        out = F.when(c <= F.lit(cutoffs[i - 1]), F.lit(i)).otherwise(out)
    return F.when(c.isNull(), F.lit(0)).otherwise(out)


def place_label(place: Column, labels: Sequence[str], missing: str = MISSING) -> Column:
    return F.element_at(F.array(F.lit(missing), *[F.lit(x) for x in labels]), place + 1)
