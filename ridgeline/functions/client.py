"""Scores of imported routes, from signals of 0 to 100 rather than from edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions.geo import clamp, half_up, num
from ridgeline.functions.scores import SCORES, by_activity

# Weights by activity in the order of SCORES, and signals where none are known.
WEIGHTS = {
    "running": (0.23, 0.16, 0.17, 0.13, 0.19, 0.06, 0.06),
    "hiking": (0.12, 0.18, 0.15, 0.12, 0.16, 0.1, 0.17),
    "cycling": (0.19, 0.15, 0.09, 0.08, 0.25, 0.07, 0.07),
}
SIGNALS = {"park_access": 55, "shade_cover": 45, "road_exposure": 35, "safety": 72, "novelty": 45, "scenery": 58, "surface_quality": 72, "intersection_complexity": 32}
STRENGTHS = (("park_score", 65, "park access"), ("shade_score", 60, "shade"), ("safety_score", 75, "lower-stress streets"), ("exploration_score", 65, "new corridors"), ("scenery_score", 70, "scenic segments"))


def sun_penalty(departure: Column) -> Column:
    """Any hour written with 2: or 3: counts as afternoon, 12: and 22: included."""
    said = F.lower(F.coalesce(departure, F.lit("")))
    return F.when(said.rlike("afternoon|2:|3:"), num(12)).when(said.contains("evening"), num(4)).otherwise(num(0))


def imported_scores(km: Column, target: Column, gain_m: Column, activity: Column, departure: Column, signals: dict[str, Column]) -> dict[str, Column]:
    """The seven scores; a missing signal takes its default, a missing target gives 88."""
    s = {k: F.coalesce(signals[k], num(v)) if k in signals else num(v) for k, v in SIGNALS.items()}
    full = lambda x: clamp(x, 0, 100)
    climb = gain_m / F.greatest(km, num(0.1))
    aim = F.when(target != 0, target)
    return {
        "distance_score": F.coalesce(full(num(100) - F.abs(km - aim) / aim * num(150)), num(88)),
        "elevation_score": full(F.when(activity == "hiking", num(92) - F.abs(climb - num(35)) * num(0.9)).when(activity == "cycling", num(96) - climb * num(0.85)).otherwise(num(100) - climb * num(1.15))),
        "park_score": full(s["park_access"]),
        "shade_score": full(s["shade_cover"] + s["park_access"] * num(0.18) - s["road_exposure"] * num(0.2) - sun_penalty(departure)),
        "safety_score": full(s["safety"] + s["surface_quality"] * num(0.14) - s["intersection_complexity"] * num(0.22)),
        "exploration_score": full(s["novelty"]),
        "scenery_score": full(s["scenery"]),
    }


def imported_total(scores: dict[str, Column], activity: Column) -> Column:
    total = num(0)
    for i, name in enumerate(SCORES):
        total = total + scores[f"{name}_score"] * by_activity(activity, *(WEIGHTS[a][i] for a in ("running", "hiking", "cycling")))
    return half_up(total)


def imported_difficulty(km: Column, gain_m: Column, activity: Column) -> Column:
    effort = km * by_activity(activity, 1, 1, 0.35) + gain_m / F.greatest(km, num(0.1)) * num(0.18)
    return F.when(effort > by_activity(activity, 13, 18, 13), F.lit("Hard")).when(effort > by_activity(activity, 7, 7, 8), F.lit("Moderate")).otherwise(F.lit("Easy"))


def imported_explanation(scores: dict[str, Column], difficulty: Column, activity: Column) -> Column:
    found = F.slice(F.array_compact(F.array(*[F.when(scores[k] >= least, F.lit(words)) for k, least, words in STRENGTHS])), 1, 2)
    best = F.when(F.size(found) > 0, F.array_join(found, " and ")).otherwise(F.lit("a balanced outing"))
    return F.concat(difficulty, F.lit(" "), activity, F.lit(" route tuned for "), best, F.lit("."))
