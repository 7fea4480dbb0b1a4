"""Loads, stresses, deflections, costs and codes of beams, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.functions.scalars import round_up_half

#: Yield strength, elastic modulus (Pa), density (kg/m3); cost of a kg, machining and waste factors.
MATERIALS = {
    "steel": (250e6, 200e9, 7850.0, 0.80, 1.0, 0.08),
    "aluminum": (276e6, 68.9e9, 2700.0, 2.50, 0.85, 0.10),
    "titanium": (880e6, 113.8e9, 4430.0, 25.00, 2.5, 0.15),
    "concrete": (30e6, 33e9, 2400.0, 0.10, 0.3, 0.05),
    "copper": (70e6, 117e9, 8960.0, 8.50, 1.1, 0.07),
    "carbon-fiber": (600e6, 150e9, 1600.0, 30.00, 3.0, 0.20),
    "inconel": (1034e6, 205e9, 8190.0, 40.00, 3.5, 0.18),
}
#: Each code's least safety factor, least span ratio and largest share of the yield strength.
CODES = {"AISC-360": (1.67, 360.0, 0.9), "Eurocode-3": (1.5, 250.0, 1.0), "AS-4100": (1.5, 300.0, 0.9)}


def property_of(material: Column, place: int) -> Column:
    """A material's property; an unknown material counts as steel."""
    table = F.create_map(*(F.lit(v) for name, m in MATERIALS.items() for v in (name, m[place])))
    return F.coalesce(F.try_element_at(table, material), F.lit(MATERIALS["steel"][place]))


def load(volume: Column, surface: Column, density: Column, force: Column) -> Column:
    """The given force if it is positive, else 1.5 times weight and wind on the surface."""
    return round_up_half(F.when(F.coalesce(force, F.lit(0.0)) > 0, force).otherwise((density * volume * 9.81 + 180 * surface) * 1.5), 2)


def von_mises(force: Column, section: Column, volume: Column, surface: Column) -> Column:
    """From an axial stress, a cross stress that follows surface by volume, and shear: in plane stress sx^2 - sx sy + sy^2 + 3 t^2."""
    area = F.greatest(section, F.lit(1e-6))
    sx, shear = force / area, force / (2 * area)
    shape = F.least(surface / F.greatest(volume, F.lit(1e-9)), F.lit(100.0))
    sy = sx * 0.3 * (shape / (shape + 10))
    return round_up_half(F.sqrt(sx * sx - sx * sy + sy * sy + 3 * shear * shear), 2)


def beam(df: DataFrame) -> DataFrame:
    """df (volume, surface_area, material, csa, moi, length, force) with load, von_mises, safety_factor, deflection_mm and span_ratio; each is rounded before the next is made from it."""
    c = F.col
    own = df.withColumn("load", load(c("volume"), c("surface_area"), property_of(c("material"), 2), c("force")))
    own = own.withColumn("von_mises", von_mises(c("load"), c("csa"), c("volume"), c("surface_area")))
    own = own.withColumn("safety_factor", F.when(c("von_mises") > 0, round_up_half(property_of(c("material"), 0) / c("von_mises"), 3)).otherwise(float("inf")))
    bend = c("load") * c("length") * c("length") * c("length") / (48 * F.greatest(property_of(c("material"), 1) * c("moi"), F.lit(1e-12)))
    return own.withColumn("deflection_mm", round_up_half(bend * 1000, 2)).withColumn("span_ratio", F.when(bend > 0, F.floor(c("length") / bend + 0.5).cast("double")).otherwise(float("inf")))


def safety_buffer(df: DataFrame) -> DataFrame:
    """df with the limits that a beam breaks and its status: rejected if one is broken badly, review-required if any is, else pass."""
    use, sf, span, sag = F.col("von_mises") / property_of(F.col("material"), 0), F.col("safety_factor"), F.col("span_ratio"), F.col("deflection_mm")
    rules = {"safety_factor": (sf < 1.67, sf < 1.0), "stress_use": (use > 0.85, use > 0.95), "span_ratio": ((span < 360) & (span < float("inf")), span < 200), "deflection_mm": (sag > 25, sag > 50)}
    broken = F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, (hit, _) in rules.items())))
    bad = F.lit(False)
    for hit, worse in rules.values():
        bad |= hit & worse
    return df.withColumn("broken", broken).withColumn("status", F.when(bad, "rejected").when(F.size("broken") > 0, "review-required").otherwise("pass"))


def compliance(df: DataFrame, row_id: str) -> DataFrame:
    """(row_id, code, check, status) of three checks under three codes: pass, warning within 5, 10 or 15 % of the limit, else fail."""
    codes = F.explode(F.array(*(F.struct(F.lit(n).alias("code"), F.lit(a).alias("sf"), F.lit(b).alias("span"), F.lit(u).alias("use")) for n, (a, b, u) in CODES.items())))
    use = F.col("von_mises") / property_of(F.col("material"), 0)
    own = df.select("*", codes.alias("k"))
    graded = lambda ok, near: F.when(ok, "pass").when(near, "warning").otherwise("fail")
    span = F.col("length") / F.greatest(F.col("deflection_mm") / 1000, F.lit(1e-9))
    checks = F.array(
        F.struct(F.lit("stress").alias("check"), graded(use <= F.col("k.use"), use <= F.col("k.use") * 1.05).alias("status")),
        F.struct(F.lit("safety").alias("check"), graded(F.col("safety_factor") >= F.col("k.sf"), F.col("safety_factor") >= F.col("k.sf") * 0.9).alias("status")),
        F.struct(F.lit("deflection").alias("check"), graded(span >= F.col("k.span"), span >= F.col("k.span") * 0.85).alias("status")),
    )
    return own.select(row_id, "k.code", F.explode(checks).alias("c")).select(row_id, "code", "c.check", "c.status")


def cost(df: DataFrame, complexity: float = 1.2) -> DataFrame:
    """df with mass_kg and total_cost: material, machining, waste, a surcharge for the shape and a premium for safety beyond 1.5."""
    m = lambda place: property_of(F.col("material"), place)
    mass = F.col("volume") * m(2)
    raw, machining = mass * m(3), F.col("surface_area") * 50 * m(4)
    spare = F.when(F.col("safety_factor") > 1.5, F.pow((F.col("safety_factor") - 1.5) / 2, F.lit(1.3)) * 0.15).otherwise(0.0)
    total = raw + machining + raw * m(5) + (raw + machining) * ((complexity - 1.0) * 0.3 + spare)
    return df.withColumn("mass_kg", round_up_half(mass, 2)).withColumn("total_cost", round_up_half(total, 2))


def recommendations(df: DataFrame) -> DataFrame:
    """df (beam's columns) with advice: what to change, in a fixed order; that the design looks good if nothing is."""
    sf, use, span = F.col("safety_factor"), F.col("von_mises") / property_of(F.col("material"), 0), F.col("span_ratio")
    rules = (
        ("Increase cross-section thickness", sf < 1), ("Marginal safety factor", (sf >= 1) & (sf < 1.5)), ("Reduce thickness to save weight", sf > 3),
        ("High stress concentration", (use > 0.9) & (sf >= 1)), ("Simplify geometry", (use < 0.3) & (sf > 2)), ("Increase moment of inertia", span < 250), ("Reduce section depth", (span > 1000) & (sf > 2)),
    )
    found = F.array_compact(F.array(*(F.when(hit, F.lit(title)) for title, hit in rules)))
    return df.withColumn("advice", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Design looks good"))))


#: Factors on the cross-section that a search tries.
SCALES = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0)


def grid_search(bases: DataFrame, row_id: str, least_safety: float = 1.5, most_sag: float = 10.0, least_span: float = 250.0) -> DataFrame:
    """(row_id, material, scale, meets, score, rank) of every material and scaled section for each base (csa, length, force): those that meet the limits first, then by cost, raised for what a limit is missed by."""
    c = F.col
    each = bases.withColumn("material", F.explode(F.array(*map(F.lit, MATERIALS)))).withColumn("scale", F.explode(F.array(*map(F.lit, SCALES))))
    own = each.withColumn("csa", c("csa") * c("scale"))
    own = own.withColumns({"volume": c("csa") * c("length"), "surface_area": F.sqrt("csa") * 4 * c("length"), "moi": c("csa") * c("csa") / (4 * F.pi())})
    own = cost(beam(own))
    safe, flat, stiff = c("safety_factor") >= least_safety, c("deflection_mm") <= most_sag, c("span_ratio") >= least_span
    missed = F.when(safe, 0.0).otherwise(10000 * (least_safety - c("safety_factor"))) + F.when(flat, 0.0).otherwise(5000 * (c("deflection_mm") - most_sag)) + F.when(stiff, 0.0).otherwise(3000 * (least_span - c("span_ratio")) / least_span)
    own = own.withColumn("meets", safe & flat & stiff).withColumn("score", round_up_half(c("total_cost") + missed, 2))
    w = Window.partitionBy(row_id).orderBy(F.desc("meets"), "score", "material", "scale")
    return own.withColumn("rank", F.row_number().over(w)).select(row_id, "material", "scale", "meets", "score", "rank")
