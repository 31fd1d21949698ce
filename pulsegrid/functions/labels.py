"""Category labels from text columns (FN-5..FN-8, FN-13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .time import col

# Room classes in priority order, places counted as elsewhere,
# and unit-name parts that mark intensive care.
ROOM_CLASSES = ("pat", "lounge", "ns", "med", "lab", "receiving")
ELSEWHERE = ("other_floor", "unknown", "floor2")
INTENSIVE_CARE = ("4 South", "5 North", "5 South ICU", "5 West", "7 West", "7 East", "7 South", "8 West", "ICU")
LABORATORY = ("lab", "Lab", "pool", "tomist")


def unit_of(path) -> Column:
    """All but the last part of a colon path (FN-5)."""
    parts = F.split(col(path), ":")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), ":")


def room_class(path, primary) -> Column:
    """Room class of a receiver: own unit by part, ``floor2``, else ``other_floor`` (FN-6).

    A receiver of the own unit that matches no class has none.
    """
    p = col(path)
    own = p.contains(F.concat(col(primary), F.lit(":")))
    room = F.when(p.contains(ROOM_CLASSES[0]), ROOM_CLASSES[0])
    for name in ROOM_CLASSES[1:]:
        room = room.when(p.contains(name), name)
    return F.when(own, room).when(p.contains("floor2"), F.lit("floor2")).otherwise(F.lit("other_floor"))


def coarse_location(location, rare: Sequence[str] = ELSEWHERE) -> Column:
    """Rare places become ``other`` (FN-7)."""
    return F.when(col(location).isin(list(rare)), F.lit("other")).otherwise(col(location))


def _contains_any(c: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | c.contains(part)
    return out


def cohort_labels(position, unit, shift, supervise, language) -> dict[str, Column]:
    """Role, shift, supervision, language and unit-type labels (FN-8)."""
    pos, place = col(position), col(unit)
    lab = _contains_any(place, LABORATORY) | (pos == 3)
    return {
        "job": F.when(pos == 1, "nurse").when(lab, "lab").otherwise("non_nurse"),
        "shift": F.when(col(shift) == "Day shift", "day").otherwise("night"),
        "supervise": F.when(col(supervise) == 1, "Supervise").otherwise("Non-Supervise"),
        "language": F.when(col(language) == 1, "English").otherwise("Non-English"),
        "icu": F.when(_contains_any(place, INTENSIVE_CARE), "icu").otherwise("non_icu"),
    }


def state_word(states: Sequence) -> Column:
    """A tuple of small state numbers as a word of letters (FN-13)."""
    return F.concat(*[F.char(F.lit(97) + col(s)) for s in states])
