"""Feature vectors, tokens, densities and refinement plans, as columns and small aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.functions.scalars import clamp, fnv1a32, unit


def log_axes(columns: list[str]) -> Column:
    """log10 of each column, of 1e-6 at least."""
    return F.array(*(F.log10(F.greatest(F.lit(1e-6), F.col(c).cast("double"))) for c in columns))


def topology_tokens(kind: Column, attributes: Column, label: Column) -> Column:
    """kind, key:size class or key:value of each attribute, and tok: of the label's parts. A number's class: xs under 0.5, s under 2, m under 10, l under 100, else xl."""
    n = lambda v: v.try_cast("double")
    size = lambda v: F.when(n(v) < 0.5, "xs").when(n(v) < 2, "s").when(n(v) < 10, "m").when(n(v) < 100, "l").otherwise("xl")
    pairs = F.transform(F.map_entries(attributes), lambda e: F.concat(e["key"], F.lit(":"), F.when(n(e["value"]).isNotNull(), size(e["value"])).otherwise(F.lower(e["value"]))))
    words = F.transform(F.filter(F.split(F.lower(label), r"[-_\s/]+"), lambda w: w != ""), lambda w: F.concat(F.lit("tok:"), w))
    return F.array_distinct(F.concat(F.array(kind), pairs, words))


def packed_frame(stations: Column, names: list[str], channels: list[str], ambient: Column, extra: list[str]) -> Column:
    """Stations by channels, row by row, and ambient values; what is missing is 0. stations: map of maps."""
    cells = [F.coalesce(F.try_element_at(F.try_element_at(stations, F.lit(s)), F.lit(c)), F.lit(0.0)) for s in names for c in channels]
    return F.array(*cells, *(F.coalesce(F.try_element_at(ambient, F.lit(e)), F.lit(0.0)) for e in extra))


def type_counts_embedding(df: DataFrame, key: str, kind: str, dims: int = 32) -> DataFrame:
    """(key, vector): log1p of each type's count, hashed with a sign into a few dimensions and scaled to unit length."""
    n = df.groupBy(key, kind).agg(F.log1p(F.count(F.lit(1))).alias("x"))
    h = fnv1a32(F.col(kind))
    placed = n.select(key, (h % dims).alias("d"), F.when(F.shiftright(h, 31) % 2 == 0, F.col("x")).otherwise(-F.col("x")).alias("x")).groupBy(key, "d").agg(F.sum("x").alias("x"))
    full = placed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("m"))
    return full.select(key, unit(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(0.0)))).alias("vector"))


def seed_density(point: list[Column], seeds: list[tuple[str, tuple[float, ...], float, float]]) -> tuple[Column, Column]:
    """(density, tag) of a point among seeds (tag, place, weight, reach): weights falling off with the squared distance, added up to 1 at most; the tag of the largest part, of equals the first. Seeds are a short list."""
    parts = []
    for tag, place, weight, reach in seeds:
        d2 = sum(((p - v) * (p - v) for p, v in zip(point, place)), F.lit(0.0))
        parts.append((tag, weight * F.exp(-d2 / (reach * reach))))
    best = F.greatest(*(v for _, v in parts)) if len(parts) > 1 else parts[0][1]
    tag = F.coalesce(*(F.when(v == best, F.lit(t)) for t, v in parts))
    return F.least(F.lit(1.0), sum((v for _, v in parts), F.lit(0.0))), tag


def smooth_union(distances: list[Column], k: float) -> Column:
    """The signed distance of a union whose joints are rounded over a width of k."""
    out = distances[0]
    for d in distances[1:]:
        if k <= 0:
            out = F.least(out, d)
        else:
            h = clamp(0.5 + 0.5 * (d - out) / k)
            out = d * (1 - h) + out * h - k * h * (1 - h)
    return out


def sphere(point: list[Column], centre: tuple, radius: float) -> Column:
    return F.sqrt(sum(((p - c) * (p - c) for p, c in zip(point, centre)), F.lit(0.0))) - radius


def box(point: list[Column], centre: tuple, half: tuple) -> Column:
    q = [F.abs(p - c) - h for p, c, h in zip(point, centre, half)]
    out = F.sqrt(sum((F.greatest(x, F.lit(0.0)) * F.greatest(x, F.lit(0.0)) for x in q), F.lit(0.0)))
    return out + F.least(F.greatest(*q), F.lit(0.0))


def combined_error(df: DataFrame, fields: dict[str, float]) -> DataFrame:
    """df with error and dominant: fields relative to their largest value over all rows, their weighted mean and half their maximum, 1 at most; the largest field, of equals the first. One row of maxima is joined."""
    top = df.agg(*(F.max(f).alias(f"_{f}") for f in fields))
    own = df.crossJoin(F.broadcast(top))  # one row
    part = {f: F.when(F.col(f"_{f}") > 0, F.col(f) / F.col(f"_{f}")).otherwise(0.0) for f in fields}
    total, most = sum(fields.values()), F.greatest(*part.values())
    mean = sum((part[f] * w for f, w in fields.items()), F.lit(0.0)) / total
    name = F.coalesce(*(F.when(part[f] == most, F.lit(f)) for f in fields))
    return own.withColumn("error", F.least(F.lit(1.0), mean + 0.5 * most)).withColumn("dominant", name).select(*df.columns, "error", "dominant")


def refinement_plan(df: DataFrame, row_id: str, split: float, merge: float, most: int) -> DataFrame:
    """(row_id, action): split for the `most` largest errors from the threshold on, merge up to the lower one."""
    hot = df.filter(F.col("error") >= split).orderBy(F.desc("error"), row_id).limit(most).select(row_id, F.lit("split").alias("action"))
    return hot.unionByName(df.filter(F.col("error") <= merge).select(row_id, F.lit("merge").alias("action")))


def priors(df: DataFrame, key: list[str], error: str, seen: str) -> DataFrame:
    """(key, mean_error, visits, last_seen, heat) of each cell; heat: mean error times the logarithm of visits."""
    out = df.groupBy(*key).agg(F.avg(error).alias("mean_error"), F.count(F.lit(1)).alias("visits"), F.max(seen).alias("last_seen"))
    return out.withColumn("heat", F.col("mean_error") * F.log1p("visits"))


def mirror_balance(df: DataFrame, axes: list[str], weight: Column) -> DataFrame:
    """(axis, balance): 1 for as much weight on either side of each axis' middle, 0 for all on one."""
    mid = df.agg(*(((F.min(a) + F.max(a)) / 2).alias(f"_{a}") for a in axes))
    sides = df.withColumn("_w", weight).crossJoin(F.broadcast(mid)).select("_w", F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), (F.col(a) < F.col(f"_{a}")).alias("low")) for a in axes))).alias("s"))
    sums = sides.groupBy("s.axis").agg(F.sum(F.when(F.col("s.low"), F.col("_w")).otherwise(0.0)).alias("a"), F.sum(F.when(~F.col("s.low"), F.col("_w")).otherwise(0.0)).alias("b"))
    return sums.select("axis", F.when(F.greatest("a", "b") > 0, F.least("a", "b") / F.greatest("a", "b")).otherwise(1.0).alias("balance"))


def surface_profile(triangles: DataFrame) -> DataFrame:
    """(vertices, edges, faces, euler) of triangles (v0, v1, v2), in one row."""
    v = F.array("v0", "v1", "v2")
    points = triangles.select(F.explode(v).alias("v")).distinct().agg(F.count(F.lit(1)).alias("vertices"))
    ends = F.array(*(F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v0", "v2"))))
    edges = triangles.select(F.explode(ends).alias("e")).distinct().agg(F.count(F.lit(1)).alias("edges"))
    one = points.crossJoin(edges).crossJoin(triangles.agg(F.count(F.lit(1)).alias("faces")))  # one row each
    return one.withColumn("euler", F.col("vertices") - F.col("edges") + F.col("faces"))


def fab_problems(thickness: Column, hole: Column, width: Column, length: Column, fillet: Column, stress: Column, strength: Column, least_wall: float = 0.8, least_hole: float = 0.5, most_aspect: float = 20.0, most_use: float = 0.8) -> Column:
    """What can't be made: thin walls, small or wide holes, slender parts, large fillets, stress beyond its share of the strength."""
    rules = {"wall": thickness < least_wall, "hole": hole < least_hole, "aspect": length > most_aspect * width, "fillet": fillet > 0.9 * thickness, "hole-width": hole > 0.35 * width, "stress": stress > most_use * strength}
    return F.array_compact(F.array(*(F.when(bad, F.lit(n)) for n, bad in rules.items())))


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


#: The numbers of a run and what each is multiplied with.
RUN_SCALES = {
    "gravity": 1 / 200, "damping": 1 / 2, "attractor": 1 / 5, "particleCount": 1 / 2000, "springK": 1 / 400, "restLength": 1 / 200, "edgesPerNode": 1 / 8, "pairwiseStrength": 1 / 1000,
    "pairwiseRadius": 1 / 200, "constraintIters": 1 / 16, "fieldStrength": 1 / 3, "subSteps": 1 / 16, "workers": 1 / 16, "objectiveLR": 1 / 0.5, "noiseSigma": 1 / 60, "ensembleK": 1 / 64,
}


def run_features(params: Column) -> Column:
    """18 numbers of a run's parameters (a map of texts): scaled numbers, 0 for what is missing or no number, and two codes of 1, a half or 0."""
    number = lambda k: F.coalesce(F.try_element_at(params, F.lit(k)).try_cast("double"), F.lit(0.0))
    code = lambda k, one, half: F.when(F.try_element_at(params, F.lit(k)) == one, 1.0).when(F.try_element_at(params, F.lit(k)) == half, 0.5).otherwise(0.0)
    return F.array(*(number(k) * s for k, s in RUN_SCALES.items()), code("integrator", "verlet", "semi-euler"), code("boundary", "periodic", "wrap"))


DOMAINS = ("fem", "cfd", "thermal", "structural", "fluid")


def descriptor(d: dict[str, Column], fingerprint: Column) -> Column:
    """24 numbers of a simulation: logarithms of sizes, shares kept within 0..1, one of five domains, and six places of a fingerprint, 0 where it is shorter."""
    log = lambda c: F.log10(F.greatest(F.lit(1.0), c.cast("double")))
    plain = lambda c: c.cast("double")
    mesh = (log(d["elements"]), log(d["nodes"]), *(plain(d[k]) for k in ("aspect_max", "aspect_mean", "min_angle", "max_angle", "jacobian_min")), clamp(plain(d["skewness"])))
    return F.array(
        log(d["unknowns"]), clamp(plain(d["density"])), plain(d["log_kappa"]), F.when(d["spd"], 1.0).otherwise(0.0), clamp(plain(d["nonlinearity"])), *mesh,
        *(F.when(d["domain"] == x, 1.0).otherwise(0.0) for x in DOMAINS), *(F.coalesce(F.get(fingerprint, i).cast("double"), F.lit(0.0)) for i in range(6)),
    )


def learning_vector(low: list[Column], high: list[Column], risk: dict[str, Column], curved: dict[str, Column], holes: Column) -> Column:
    """12 numbers between 0 and 1 of a part: shape and size of its box (1 x 1 x 1 without one), risks, shares of curved faces, and holes."""
    dims = [F.coalesce(b - a, F.lit(1.0)) for a, b in zip(low, high)]
    small, large = F.greatest(F.lit(1e-6), F.least(*dims)), F.greatest(F.lit(1e-6), F.greatest(*dims))
    area = 2 * (dims[0] * dims[1] + dims[1] * dims[2] + dims[0] * dims[2])
    parts = (
        small / large, large / small / 10, 1 - risk["stress"], F.coalesce(holes, F.lit(0.0)), curved["toroidal"], dims[0] * dims[1] * dims[2] / 1000,
        area / 1300, risk["thermal"], risk["stress"], risk["fabrication"], curved["spline"], 1 - curved["planar"],
    )
    return F.array(*map(clamp, parts))


def band_profile(samples: DataFrame, row_id: str, distance: str, band: str, bins: int = 16) -> DataFrame:
    """(row_id, inside, thickness, shares): the share of samples inside (a negative distance), the mean size of their distance, and how all sizes lie between 0 and the band, in equal bins, what is beyond in the last."""
    d = F.abs(F.col(distance))
    place = F.least(F.lit(bins - 1), F.floor(d / F.col(band) * bins)).cast("int")
    inside = F.col(distance) < 0
    own = samples.groupBy(row_id).agg(F.count(F.lit(1)).alias("_n"), F.avg(inside.cast("double")).alias("inside"), F.coalesce(F.avg(F.when(inside, d)), F.lit(0.0)).alias("thickness"), *(F.count_if(place == i).alias(f"_{i}") for i in range(bins)))
    return own.select(row_id, "inside", "thickness", F.array(*(F.col(f"_{i}") / F.col("_n") for i in range(bins))).alias("shares"))


def inner_centre(samples: DataFrame, row_id: str, distance: str, axes: list[str]) -> DataFrame:
    """(row_id, axes): the mean place of the samples inside, else the middle of all."""
    inside = F.col(distance) < 0
    return samples.groupBy(row_id).agg(*(F.coalesce(F.avg(F.when(inside, F.col(a))), (F.min(a) + F.max(a)) / 2).alias(a) for a in axes))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
