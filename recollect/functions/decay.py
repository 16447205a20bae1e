"""Activation over time as column expressions: decay models, boosts, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 0.01
MODELS = ("exponential", "linear", "power_law")


def decayed(a: Column, rate: Column, seconds: Column, model: str = "exponential") -> Column:
    """a after so many seconds by one of the models, without the floor. Power law counts hours, the others seconds."""
    if model == "linear":
        return F.greatest(F.lit(0.0), a - rate * seconds)
    if model == "exponential":
        return a * F.exp(-rate * seconds)
    if model == "power_law":
        return a * F.pow(1 + seconds / 3600.0, -rate)
    raise ValueError(f"no such decay model: {model}")


def apply_decay(a: Column, rate: Column, seconds: Column, model: str = "exponential", floor: float = FLOOR) -> Column:
    """a as it stands where no time has passed, else decayed but not below the floor."""
    return F.when(seconds <= 0, a).otherwise(F.greatest(F.lit(floor), decayed(a, rate, seconds, model)))


def decay_amount(a: Column, rate: Column, seconds: Column, model: str = "exponential") -> Column:
    """What is lost, floor aside; 0 where no time has passed."""
    return F.when(seconds <= 0, 0.0).otherwise(a - decayed(a, rate, seconds, model))


def boosted(a: Column, boost: Column | float, times: Column | int = 1) -> Column:
    """a after a number of equal boosts, each closing the given part of the gap to 1."""
    b = F.lit(boost) if isinstance(boost, float) else boost
    return F.least(F.lit(1.0), 1 - (1 - a) * F.pow(1 - b, F.lit(times) if isinstance(times, int) else times))


def forget_seconds(a: Column, rate: Column, model: str = "exponential", floor: float = FLOOR) -> Column:
    """Seconds until a falls to the floor; 0 where it is there already, null without decay."""
    if model == "linear":
        t = (a - floor) / rate
    elif model == "exponential":
        t = F.log(a / floor) / rate
    elif model == "power_law":
        t = (F.pow(a / floor, 1 / rate) - 1) * 3600.0
    else:
        raise ValueError(f"no such decay model: {model}")
    return F.when(a <= floor, 0.0).when(rate > 0, t)


def compounded(a: Column, rate: Column, ages: Column) -> Column:
    """a after one pass of decay for each age of an array, every pass counting from creation."""
    return a * F.exp(-rate * F.aggregate(ages, F.lit(0.0), lambda x, y: x + y))


def freshness_level(a: Column) -> Column:
    """0 above 0.8, 1 above 0.6, 2 above 0.4, 3 above 0.2, else 4."""
    return F.when(a > 0.8, 0).when(a > 0.6, 1).when(a > 0.4, 2).when(a > 0.2, 3).otherwise(4)


def freshness_band(a: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in ("fresh", "active", "aging", "old", "fading")]), freshness_level(a) + 1)


def marker_size(a: Column) -> Column:
    level = freshness_level(a)
    return F.when(level == 0, 8 + a * 12).when(level == 1, 6 + a * 10).when(level == 2, 4 + a * 8).when(level == 3, 3 + a * 6).otherwise(2 + a * 4)


def marker_opacity(a: Column) -> Column:
    return 0.3 + a * 0.7


#: Viewing: how fast each kind of memory fades in a day; any other fades by 0.5.
FADING = {"episodic": 0.8, "semantic": 0.3, "procedural": 0.1, "working": 0.95}


def faded(kind: Column, hours: Column) -> Column:
    rate = F.coalesce(F.create_map(*[F.lit(x) for kv in FADING.items() for x in kv])[kind], F.lit(0.5))
    return F.least(F.lit(1.0), F.exp(-rate * hours / 24.0))


#: Generated memories: base decay and first activation by kind; then factor and bonus by age, which goes by position.
BASE_DECAY = {"working": 0.15, "episodic": 0.08, "semantic": 0.02, "procedural": 0.01, "concept": 0.03, "fact": 0.025, "opinion": 0.06, "reference": 0.02, "note": 0.05, "experience": 0.07}
BASE_ACTIVATION = {"working": 0.95, "episodic": 0.8, "semantic": 0.7, "procedural": 0.85, "concept": 0.75, "fact": 0.7, "opinion": 0.6, "reference": 0.65, "note": 0.55, "experience": 0.8}
AGES = ((1000, "very_recent", 0.5, 0.15), (3000, "recent", 0.7, 0.1), (6000, "moderate", 1.0, 0.0), (8000, "old", 1.3, -0.05), (None, "very_old", 1.6, -0.1))


def _by_age(index: Column, field: int) -> Column:
    out = F.lit(AGES[-1][field])
    for age in AGES[-2::-1]:
        out = F.when(index < age[0], age[field]).otherwise(out)
    return out


def age_level(index: Column) -> Column:
    return _by_age(index, 1)


def generated_decay(kind: Column, index: Column) -> Column:
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in BASE_DECAY.items() for x in kv])[kind], F.lit(0.04))
    return F.greatest(F.lit(0.005), F.least(F.lit(0.25), base * _by_age(index, 2)))


def generated_activation(kind: Column, index: Column) -> Column:
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in BASE_ACTIVATION.items() for x in kv])[kind], F.lit(0.7))
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), base + _by_age(index, 3)))
