"""Heights from horizons, scales and reference markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import clamp, ratio

LOWEST, HIGHEST = 40.0, 230.0


def horizon(base: Column, top: Column, camera_cm: Column, reference_cm: Column) -> Column:
    """The horizon's row from a vertical reference; null for references without height."""
    return F.when(reference_cm > 0, base - camera_cm * (base - top) / reference_cm)


def height(camera_cm: Column, feet: Column, head: Column, horizon_y: Column, variant: str) -> Column:
    """Height from a horizon. Variant a: null for a denominator of almost nothing. b: also for a body without extent.
    c: also for a negative denominator or camera height."""
    body, below = feet - head, feet - horizon_y
    value = camera_cm * ratio(body, below, 1e-6)
    if variant == "a":
        return value
    return F.when(body > 0, value) if variant == "b" else F.when((body > 0) & (below > 0) & (camera_cm > 0), value)


def plausible(h: Column) -> Column:
    return (h > LOWEST) & (h < HIGHEST)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def verticality(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """1 for an upright edge, 0 for a level one."""
    angle = F.abs(F.degrees(F.atan2(y2 - y1, x2 - x1))) % 180
    return 1 - F.abs(angle - 90) / 90


def upright_edge(corners: Column, least_px: float = 10.0) -> Column:
    """(base_y, top_y) of the most upright side of a marker's four corners, structs of x and y; of equals (to nine digits, as opposite sides are) the first; null if all are shorter than least_px."""

    def side(i: int) -> Column:
        a, b = corners[i], corners[(i + 1) % 4]
        found = F.struct(F.round(verticality(a["x"], a["y"], b["x"], b["y"]), 9).alias("upright"), F.lit(-i).alias("order"), F.greatest(a["y"], b["y"]).alias("base_y"), F.least(a["y"], b["y"]).alias("top_y"))
        return F.when(distance(a["x"], a["y"], b["x"], b["y"]) >= least_px, found)

    best = F.array_max(F.array(*map(side, range(4))))
    return F.when(best.isNotNull(), F.struct(best["base_y"].alias("base_y"), best["top_y"].alias("top_y")))


def crown(eye: Column, face: Column, factor: Column, mask_top: Column) -> Column:
    """The crown above the eyes: not above the mask, at least a pixel above the eyes."""
    return clamp(eye - factor * face, mask_top, eye - 1)


def ponderal(weight_kg: Column, height_cm: Column) -> Column:
    return ratio(weight_kg, F.pow(height_cm / 100, 3))


def square(corners: Column, side_cm: float = 10.0) -> dict[str, Column]:
    """Mean side, squareness (shortest over longest side) and scale in cm a pixel of a marker's four corners, structs of x and y."""
    sides = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: distance(corners[i]["x"], corners[i]["y"], corners[(i + 1) % 4]["x"], corners[(i + 1) % 4]["y"]))
    side = F.aggregate(sides, F.lit(0.0), lambda a, x: a + x) / 4
    return {"side": side, "squareness": ratio(F.array_min(sides), F.array_max(sides)), "scale": ratio(F.lit(side_cm), side)}


def circle_scale(diameter_px: Column, diameter_cm: float = 1.4) -> Column:
    """Scale in cm a pixel of a round marker."""
    return F.when(diameter_px > 0, diameter_cm / diameter_px)


def corrected_head(view: Column, pose: Column, mask: Column, feet: Column, share: float = 0.12, rise_px: float | None = 30.0) -> dict[str, Column]:
    """Row, source and move of the head: the trimmed mask's if it moves at most a share of the body; in lateral views it rises rise_px at most (without one: as far as it does)."""
    near = F.abs(mask - pose) <= share * (feet - pose)
    lateral = view.isin("left", "right")
    target = mask if rise_px is None else F.when(lateral, F.greatest(mask, pose - rise_px)).otherwise(mask)
    taken = F.coalesce(near, F.lit(False))
    source = F.when(~taken, "pose").when(F.lit(rise_px is not None) & lateral, "mask_trim_hair_capped").otherwise("mask_trim_hair")
    return {"head_y": F.when(taken, target).otherwise(pose), "head_source": source, "head_move_px": F.when(taken, pose - target).otherwise(0.0)}
