"""The preference-weighted cost of an edge, as one column expression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions.geo import is_afternoon, is_night, normalize_preference, num

# Cost per metre by road and surface.
ROAD = {"highway": 1.9, "arterial": 0.75, "collector": 0.28, "residential": -0.03, "greenway": -0.22, "park_path": -0.18, "trail": -0.14, "bike_path": -0.24}
SURFACE = {"gravel": 0.08, "dirt": 0.04, "rough_trail": 0.16, "sidewalk": -0.04, "paved": -0.03}


def lookup(key: Column, table: dict[str, float], other: float = 0.0) -> Column:
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), num(v))])
    return F.coalesce(F.element_at(pairs, key), num(other))


def _only(test: Column, amount: Column) -> Column:
    return F.when(test, amount).otherwise(num(0))


def edge_cost(e: dict[str, Column], p: dict[str, Column]) -> Column:
    """Cost of edge columns ``e`` under preference columns ``p``; infinite where access is closed.

    Never below a fifth of the distance, which keeps straight-line search bounds admissible.
    """
    d, gain, slope = e["distance_m"], F.coalesce(e["elevation_gain_m"], num(0)), F.abs(F.coalesce(e["slope"], num(0)))
    climb_pref, safe_pref, shade_pref = (normalize_preference(p[f"{k}_preference"]) for k in ("elevation", "safety", "shade"))
    park_pref, explore_pref = (normalize_preference(p[f"{k}_preference"]) for k in ("park", "exploration"))
    novelty = F.coalesce(e["novelty_score"], e["scenery_score"])
    style, activity = F.coalesce(p["route_style"], F.lit("")), p["activity"]
    unsafe, sunny = num(1) - e["safety_score"], num(1) - e["shade_score"]
    cycling, hiking = activity == "cycling", activity == "hiking"

    climbing = style == "climbing"
    terrain = F.when(climbing, -F.least(d * num(0.24), climb_pref * gain * num(1.6)) + _only(slope > 0.12, d * slope * num(2.2))).otherwise(
        climb_pref * gain * num(4.5) + climb_pref * slope * d * num(1.8)
    )
    styled = (
        F.when(style == "easy_flat", gain * num(3.5) + slope * d * num(2.5))
        .when(style == "park_heavy", -(e["park_score"] * d * num(0.28)))
        .when(style == "shaded", -(e["shade_score"] * d * num(0.35)))
        .when(style == "scenic", -(e["scenery_score"] * d * num(0.28)))
        .when(style == "exploration", -(novelty * d * num(0.28)))
        .otherwise(num(0))
    )
    wishes = (
        safe_pref * unsafe * d * num(1.15)
        + shade_pref * sunny * d * num(0.42)
        - park_pref * e["park_score"] * d * num(0.32)
        - explore_pref * novelty * d * num(0.24)
        - e["scenery_score"] * d * num(0.08)
    )
    hours = _only(is_afternoon(p["departure_time"]), shade_pref * sunny * d * num(0.28)) + _only(
        is_night(p["departure_time"]), unsafe * d * num(0.35) + F.coalesce(e["traffic_exposure"], num(0.25)) * d * num(0.18)
    )
    means = F.when(cycling, (num(1) - e["bike_score"]) * d * num(0.48) - e["bike_score"] * d * num(0.32) + _only(slope > 0.08, d * slope * num(3.8))).otherwise(
        (num(1) - e["walk_score"]) * d * num(0.32) - e["walk_score"] * d * num(0.24)
    )
    hike = _only(hiking & e["road_type"].isin("trail", "park_path"), d * num(-0.28)) + _only(hiking & (e["road_type"] == "arterial"), d * num(0.28))
    ground = (lookup(e["road_type"], ROAD) + lookup(e["surface_type"], SURFACE)) * d + F.coalesce(e["traffic_exposure"], num(0)) * safe_pref * d * num(0.38)
    cost = F.greatest(d + terrain + styled + wishes + hours + means + hike + ground, d * num(0.2))
    return F.when(e["access_allowed"], cost).otherwise(num(float("inf")))


def node_quality(e: dict[str, Column], p: dict[str, Column]) -> Column:
    """What an edge adds to the quality of the node it leaves; closed edges count against it."""
    novelty = F.coalesce(e["novelty_score"], e["scenery_score"])
    worth = (
        e["park_score"] * normalize_preference(p["park_preference"])
        + e["shade_score"] * normalize_preference(p["shade_preference"])
        + e["safety_score"] * normalize_preference(p["safety_preference"])
        + novelty * normalize_preference(p["exploration_preference"])
        + e["scenery_score"] * num(0.4)
        + F.when(p["activity"] == "cycling", e["bike_score"]).otherwise(e["walk_score"])
    )
    return F.when(e["access_allowed"], worth).otherwise(num(-3))


def normal_preference(v: float) -> float:
    return min(max(v if v <= 1 else (v - 1) / 2, 0.0), 1.0)


def _wishes(p: dict) -> dict[str, float]:
    return {k: normal_preference(float(p[f"{k}_preference"])) for k in ("park", "shade", "elevation", "safety", "exploration")}


#: What the cost of a metre depends on, but for its slope.
METRE_COLUMNS = ("park_score", "shade_score", "safety_score", "scenery_score", "bike_score", "walk_score", "novelty_score", "traffic_exposure", "road_weight", "surface_weight", "hike_weight")


def _metre(e: dict[str, np.ndarray], p: dict, wish: dict[str, float]) -> np.ndarray:
    """Cost of a level metre of each edge."""
    said, style, activity = (p["departure_time"] or "").lower(), p["route_style"] or "", p["activity"]
    late, dark = any(w in said for w in ("afternoon", "12:", "13:", "14:", "15:")), any(w in said for w in ("night", "late", "22:", "23:"))
    novelty = np.where(np.isnan(e["novelty_score"]), e["scenery_score"], e["novelty_score"])
    unsafe, sunny, traffic = 1 - e["safety_score"], 1 - e["shade_score"], e["traffic_exposure"]
    lone = {"park_heavy": ("park_score", 0.28), "shaded": ("shade_score", 0.35), "scenic": ("scenery_score", 0.28)}
    metre = 1 + wish["safety"] * unsafe * 1.15 + wish["shade"] * sunny * (0.42 + 0.28 * late) - wish["park"] * e["park_score"] * 0.32
    metre = metre - wish["exploration"] * novelty * 0.24 - e["scenery_score"] * 0.08
    metre = metre + e["road_weight"] + e["surface_weight"] + np.nan_to_num(traffic) * wish["safety"] * 0.38
    if style in lone:
        metre = metre - e[lone[style][0]] * lone[style][1]
    elif style == "exploration":
        metre = metre - novelty * 0.28
    if dark:
        metre = metre + unsafe * 0.35 + np.where(np.isnan(traffic), 0.25, traffic) * 0.18
    if activity == "cycling":
        metre = metre + (1 - e["bike_score"]) * 0.48 - e["bike_score"] * 0.32
    else:
        metre = metre + (1 - e["walk_score"]) * 0.32 - e["walk_score"] * 0.24
    return metre + e["hike_weight"] if activity == "hiking" else metre


class EdgeCosts:
    """``edge_cost`` of the same edges for many requests, inside a search task.

    Missing numbers are NaN. What a level metre costs is worked out once for each kind of edge, that is for edges
    that are equal in ``METRE_COLUMNS``; slopes and climbs are added edge by edge.
    """

    def __init__(self, e: dict[str, np.ndarray]):
        kinds = pd.DataFrame({c: e[c] for c in METRE_COLUMNS}).groupby(list(METRE_COLUMNS), dropna=False, sort=False).ngroup().to_numpy()
        first = np.unique(kinds, return_index=True)[1]
        self._kind, self._of_kind = kinds, {c: e[c][first] for c in METRE_COLUMNS}
        self._d, self._gain, self._slope = e["distance_m"], np.nan_to_num(e["elevation_gain_m"]), np.abs(np.nan_to_num(e["slope"]))
        self._least, self._up = self._d * 0.2, self._gain * 4.5 + self._slope * self._d * 1.8
        self._steep = np.where(self._slope > 0.08, self._slope * 3.8, 0)
        self._shut = ~e["access_allowed"].astype(bool)

    def cost(self, p: dict) -> np.ndarray:
        wish, style = _wishes(p), p["route_style"] or ""
        cost = _metre(self._of_kind, p, wish)[self._kind]
        if p["activity"] == "cycling":
            cost += self._steep
        cost *= self._d
        if style == "climbing":
            cost += np.where(self._slope > 0.12, self._d * self._slope * 2.2, 0) - np.minimum(self._d * 0.24, wish["elevation"] * self._gain * 1.6)
        else:
            cost += wish["elevation"] * self._up
        if style == "easy_flat":
            cost += self._gain * 3.5 + self._slope * self._d * 2.5
        np.maximum(cost, self._least, out=cost)
        cost[self._shut] = np.inf
        return cost


def edge_worth_arrays(e: dict[str, np.ndarray], p: dict) -> np.ndarray:
    """``node_quality`` of many edges for one request."""
    wish = _wishes(p)
    novelty = np.where(np.isnan(e["novelty_score"]), e["scenery_score"], e["novelty_score"])
    worth = e["park_score"] * wish["park"] + e["shade_score"] * wish["shade"] + e["safety_score"] * wish["safety"] + novelty * wish["exploration"]
    worth = worth + e["scenery_score"] * 0.4 + e["bike_score" if p["activity"] == "cycling" else "walk_score"]
    return np.where(e["access_allowed"].astype(bool), worth, -3.0)


def edge_cost_arrays(e: dict[str, np.ndarray], p: dict) -> tuple[np.ndarray, np.ndarray]:
    """(cost, worth) of many edges for one request."""
    return EdgeCosts(e).cost(p), edge_worth_arrays(e, p)


def with_ground_weights(edges):
    """Adds the table lookups that ``edge_cost_arrays`` needs as numbers."""
    hike = F.when(F.col("road_type").isin("trail", "park_path"), num(-0.28)).when(F.col("road_type") == "arterial", num(0.28)).otherwise(num(0))
    return edges.withColumns({"road_weight": lookup(F.col("road_type"), ROAD), "surface_weight": lookup(F.col("surface_type"), SURFACE), "hike_weight": hike})
