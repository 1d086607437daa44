"""What a strategy puts in a span's place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sablework.functions.random_values import random_value
from sablework.plans.policy import DEFAULT_FORMAT, Strategy

# Layouts of dates with month names, in the order in which they are tried, and separators of numeric ones.
NAMED_LAYOUTS = ("MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy")
SEPARATORS = ("/", ".", "-")


def shift_date(token: Column, days: int | Column, months: int | Column, years: int | Column) -> Column:
    """A date moved by years and months (days beyond the month's end run over into the next one), then days, in its
    own layout; other text stays as it is."""
    def moved(d: Column) -> Column:
        first = F.add_months(F.trunc(d, "MM"), years * 12 + months)
        return F.date_add(first, F.dayofmonth(d) - 1 + days)

    def attempt(source: Column, layout: str, shape: str) -> Column:
        date = F.when(F.rlike(source, F.lit(shape)), F.try_to_date(source, layout))
        return F.date_format(moved(date), layout)

    # Month names in title case, runs of spaces as one.
    named = F.regexp_replace(F.initcap(F.lower(token)), " +", " ")
    day, name, year = "[0-9]{1,2}", "(?:May|[A-Z][a-z]{2,8})", "[0-9]{4}"
    tries = []
    for layout in NAMED_LAYOUTS:
        shape = layout.replace("MMMM", name).replace("MMM", "[A-Z][a-z]{2}").replace("yyyy", year)
        tries.append(attempt(named, layout, "^" + shape.replace(" d", f" {day}").replace("d ", f"{day} ") + r"\z"))
    tries.append(attempt(token, "yyyy-MM-dd", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"))
    for sep in SEPARATORS:
        tries.append(attempt(token, f"MM{sep}dd{sep}yyyy", rf"^[0-9]{{2}}[{sep}][0-9]{{2}}[{sep}][0-9]{{4}}\z"))
    return F.coalesce(*tries, token)


@dataclass(frozen=True)
class Replacing:
    """How a span is replaced: by a text ("text"), by a text with the token in the place of %v ("value"), by a look-alike
    ("random"), by a text for each byte ("mask"), or by a moved date ("shift")."""

    mode: str
    text: str = ""
    days: int = 0
    months: int = 0
    years: int = 0


def resolve(strategy: Strategy | None, filter_type: str, kinds: tuple[str, ...] = ()) -> Replacing:
    """What a strategy amounts to. ``kinds``: the strategies that the detector knows, empty for all; others redact by the
    format without the value."""
    default = Replacing("text", DEFAULT_FORMAT.replace("%t", filter_type))
    if strategy is None:
        return default
    kind = strategy.kind or "REDACT"
    named = (strategy.format or DEFAULT_FORMAT).replace("%t", filter_type)
    if kinds and kind not in kinds:
        return default
    if kind == "REDACT":
        return Replacing("value" if "%v" in named else "text", named)
    if kind == "RANDOM_REPLACE":
        return Replacing("random")
    if kind == "STATIC_REPLACE":
        return Replacing("text", strategy.static)
    if kind == "MASK":
        return Replacing("mask", strategy.mask or "*")
    if kind == "SHIFT_DATE" and filter_type == "date":
        return Replacing("shift", "", strategy.days, strategy.months, strategy.years)
    return Replacing("text", named)


def replacement(strategy: Strategy | None, filter_type: str, token: Column, context: Column, kinds: tuple[str, ...] = ()) -> Column:
    """The replacement of one span."""
    how = resolve(strategy, filter_type, kinds)
    if how.mode == "value":
        return F.replace(F.lit(how.text), F.lit("%v"), token)
    if how.mode == "random":
        return random_value(filter_type, token, context)
    if how.mode == "mask":
        return F.repeat(F.lit(how.text), F.octet_length(token))
    if how.mode == "shift":
        return shift_date(token, how.days, how.months, how.years) if how.days or how.months or how.years else token
    return F.lit(how.text)


def replacement_by_row(how: Column, filter_type: str, token: Column, context: Column, modes: set[str]) -> Column:
    """The replacement of one span where the row says how: mode (one of ``modes``), replacement (the text), days, months, years."""
    text, still = how["replacement"], (how["days"] == 0) & (how["months"] == 0) & (how["years"] == 0)
    made = {
        "value": lambda: F.replace(text, F.lit("%v"), token),
        "random": lambda: random_value(filter_type, token, context),
        "mask": lambda: F.repeat(text, F.octet_length(token)),
        "shift": lambda: F.when(still, token).otherwise(shift_date(token, how["days"], how["months"], how["years"])),
    }
    out = text
    for mode in sorted(modes & set(made)):
        out = F.when(how["mode"] == mode, made[mode]()).otherwise(out)
    return out
