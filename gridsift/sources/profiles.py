"""Parameter records: aircraft, mission and doctrine, their checks, files and what-if variants."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ProfileError(ValueError):
    """A profile that does not hold together."""


# Fixed values of the profile format: the fields of the three kinds of profiles and their defaults.
@dataclass(frozen=True)
class Aircraft:
    name: str = "small"
    tdp_diameter_m: float = 6.0
    cleared_ring_m: float = 3.0
    max_landing_slope_deg: float = 6.0
    max_upslope_landing_deg: float = 10.0
    max_roughness_m: float = 0.3
    tdp_obstacle_height_m: float = 0.3
    ring_obstacle_height_m: float = 1.0
    approach_range_m: float = 30.0
    corridor_half_width_deg: float = 15.0
    suitable_angle_deg: float = 3.0
    unsuitable_angle_deg: float = 7.0
    clearance_height_m: float = 2.0
    hover_ceiling_ige_ft: float | None = None
    hover_ceiling_oge_ft: float | None = None

    @property
    def tdp_radius_m(self) -> float:
        return self.tdp_diameter_m / 2

    @property
    def analysis_radius_m(self) -> float:
        return self.tdp_radius_m + self.cleared_ring_m


@dataclass(frozen=True)
class Mission:
    name: str = "screening"
    slope_weight: float = 25.0
    roughness_weight: float = 20.0
    approach_weight: float = 30.0
    obstacle_weight: float = 15.0
    data_quality_weight: float = 10.0
    azimuth_step_deg: float = 10.0
    ray_step_deg: float = 5.0
    max_candidates: int = 1000
    max_candidates_per_tile: int = 100
    minimum_candidate_separation_factor: float = 1.0
    tile_max_cells: int = 16_000_000
    minimum_valid_fraction: float = 0.95
    minimum_ring_coverage_fraction: float = 0.90
    minimum_approach_coverage_fraction: float = 0.80
    upslope_alignment_tolerance_deg: float = 30.0

    @property
    def weight_total(self) -> float:
        return self.slope_weight + self.roughness_weight + self.approach_weight + self.obstacle_weight + self.data_quality_weight


@dataclass(frozen=True)
class Doctrine:
    name: str = "planning"
    highly_suitable_score: float = 80.0
    suitable_score: float = 60.0
    marginal_score: float = 40.0
    approval_status: str = "planning_only"

    @property
    def approved(self) -> bool:
        return self.approval_status == "approved"


#: Rule -> SQL condition that holds for a sound aircraft. Unknown values (null) break a rule unless it says otherwise.
AIRCRAFT_RULES = {
    "touchdown diameter must be positive": "tdp_diameter_m > 0",
    "cleared ring must not be negative": "cleared_ring_m >= 0",
    "landing slope must be positive": "max_landing_slope_deg > 0",
    "upslope limit must be at least the landing slope": "max_upslope_landing_deg >= max_landing_slope_deg",
    "upslope limit must be below 45": "max_upslope_landing_deg < 45",
    "roughness limit must be positive": "max_roughness_m > 0",
    "pad obstacle limit must not be negative": "tdp_obstacle_height_m >= 0",
    "ring obstacle limit must be at least the pad's": "ring_obstacle_height_m >= tdp_obstacle_height_m",
    "approach range must pass the cleared area": "approach_range_m > tdp_diameter_m / 2 + cleared_ring_m",
    "corridor half width must be positive and below 90": "corridor_half_width_deg > 0 and corridor_half_width_deg < 90",
    "unsuitable angle must be above the suitable one": "unsuitable_angle_deg > suitable_angle_deg",
    "unsuitable angle must be below 45": "unsuitable_angle_deg < 45",
    "clearance height must not be negative": "clearance_height_m >= 0",
}
MISSION_RULES = {
    "weights must not be negative": "least(slope_weight, roughness_weight, approach_weight, obstacle_weight, data_quality_weight) >= 0",
    "a weight must be positive": "slope_weight + roughness_weight + approach_weight + obstacle_weight + data_quality_weight > 0",
    "azimuth step must divide the circle": "azimuth_step_deg > 0 and abs(360 / azimuth_step_deg - round(360 / azimuth_step_deg)) < 1e-9",
    "ray step must divide the circle": "ray_step_deg > 0 and abs(360 / ray_step_deg - round(360 / ray_step_deg)) < 1e-9",
    "fractions must be within 0 and 1": "least(minimum_valid_fraction, minimum_ring_coverage_fraction, minimum_approach_coverage_fraction) > 0 and greatest(minimum_valid_fraction, minimum_ring_coverage_fraction, minimum_approach_coverage_fraction) <= 1",
    "counts must be positive": "least(max_candidates, max_candidates_per_tile) >= 1",
    "separation factor must be positive": "minimum_candidate_separation_factor > 0",
}
DOCTRINE_RULES = {"scores must descend within 0 and 100": "100 >= highly_suitable_score and highly_suitable_score > suitable_score and suitable_score > marginal_score and marginal_score >= 0"}

#: What-if limits of the touchdown diameter and the cleared ring.
DIAMETER_RANGE, RING_RANGE = (5.0, 200.0), (0.0, 200.0)
#: Upper limits of take-off mass in kg of the light and medium classes.
WEIGHT_CLASSES = (("light", 4500.0), ("medium", 14000.0))


def problems(rules: dict[str, str]) -> Column:
    """Array of the rules that a row breaks, in the rules' order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(F.expr(condition), F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(name)) for name, condition in rules.items())))


def validate(profiles: DataFrame, rules: dict[str, str]) -> DataFrame:
    """profiles with problems (array<string>) and valid."""
    return profiles.withColumn("problems", problems(rules)).withColumn("valid", F.size("problems") == 0)


def what_if(profiles: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every profile with every size variant(diameter, ring) whose given values are in range; null keeps a value."""
    within = lambda c, span: F.col(c).isNull() | F.col(c).between(*span)
    return (
        profiles.crossJoin(F.broadcast(sizes.filter(within("diameter", DIAMETER_RANGE) & within("ring", RING_RANGE))))
        .withColumn("tdp_diameter_m", F.coalesce("diameter", "tdp_diameter_m"))
        .withColumn("cleared_ring_m", F.coalesce("ring", "cleared_ring_m"))
        .drop("diameter", "ring")
    )


def weight_class(mass: Column) -> Column:
    """light, medium or heavy by take-off mass; null where the mass is unknown or not positive."""
    out = F.when(mass > 0, F.lit("heavy"))
    for name, limit in reversed(WEIGHT_CLASSES):
        out = F.when((mass > 0) & (mass <= limit), F.lit(name)).otherwise(out)
    return out


def from_catalog(catalog: DataFrame, classes: DataFrame) -> DataFrame:
    """Profiles of catalog(name, mtow_kg, rotor_m, diameter): the class's defaults unless the row overrides them.

    footprint_ok says whether the touchdown diameter is at least 1.5 times the rotor's.
    """
    out = catalog.withColumn("weight_class", weight_class(F.col("mtow_kg"))).join(F.broadcast(classes), "weight_class", "left")
    out = out.withColumn("tdp_diameter_m", F.coalesce("diameter", "class_diameter"))
    return out.withColumn("footprint_ok", F.col("tdp_diameter_m") >= 1.5 * F.col("rotor_m")).select("name", "weight_class", "tdp_diameter_m", "footprint_ok")


def resize(aircraft: Aircraft, diameter: float | None = None, ring: float | None = None) -> Aircraft:
    """The aircraft with another touchdown diameter or cleared ring."""
    for value, (low, high), name in ((diameter, DIAMETER_RANGE, "diameter"), (ring, RING_RANGE, "ring")):
        if value is not None and not low <= value <= high:
            raise ProfileError(f"{name} {value} is not within {low} and {high}")
    return check(replace(aircraft, **{k: v for k, v in (("tdp_diameter_m", diameter), ("cleared_ring_m", ring)) if v is not None}))


def check(profile):
    """The profile itself, or a ProfileError with all broken rules."""
    rules = {Aircraft: AIRCRAFT_RULES, Mission: MISSION_RULES, Doctrine: DOCTRINE_RULES}[type(profile)]
    values = asdict(profile)

    def holds(condition: str) -> bool:
        """The conditions use no more than what SQL and Python write alike."""
        try:
            return bool(eval(condition, {"__builtins__": {}, "least": min, "greatest": max, "abs": abs, "round": round}, values))  # noqa: S307
        except TypeError:  # an unknown value
            return False

    broken = [name for name, condition in rules.items() if not holds(condition)]
    if broken:
        raise ProfileError("; ".join(broken))
    return profile


def compatible(aircraft: Aircraft, mission: Mission) -> bool:
    """A sector must be at least as wide as the gap between rays."""
    return aircraft.corridor_half_width_deg >= mission.ray_step_deg


def load(path: str | Path, kind: type):
    """A profile from a JSON file; keys that start with _ are comments, unknown keys are errors."""
    raw = {k: v for k, v in json.loads(Path(path).read_text(encoding="utf-8-sig")).items() if not k.startswith("_")}
    known = {f.name for f in fields(kind)}
    if extra := sorted(raw.keys() - known):
        raise ProfileError(f"{path}: unknown keys {extra}")
    return check(kind(**raw))


def listing(folder: str | Path) -> list[tuple[str, str]]:
    """(group, path) of the profiles below folder, own files before those of subfolders, by name."""
    root = Path(folder)
    found = [(str(p.parent.relative_to(root)) if p.parent != root else "", str(p)) for p in root.rglob("*.json") if not any(x.startswith("_") for x in p.relative_to(root).parts)]
    return sorted(found)


def as_table(spark: SparkSession, *profiles) -> DataFrame:
    """One row per profile of one kind."""
    kind = {"str": "string", "int": "long", "float": "double", "float | None": "double"}
    schema = ", ".join(f"{f.name} {kind[f.type]}" for f in fields(profiles[0]))
    rows = [tuple(float(v) if kind[f.type] == "double" and v is not None else v for f, v in ((f, getattr(p, f.name)) for f in fields(p))) for p in profiles]
    return spark.createDataFrame(rows, schema)
