"""Materials: rows mapped to a corpus, neighbours and substitutes, gates, and energy laws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.functions.scalars import ratio
from strataform.operators.similarity import apart, best_between

#: What a row that doesn't say has, by column; a share of the yield strength where named so.
DEFAULTS = {"thermal_conductivity": 30.0, "thermal_expansion": 12.0, "max_service_temp": 300.0, "cost": 5.0, "co2": 4.0, "corrosion": 0.6, "weather": 0.6}


def corpus_of(rows: DataFrame) -> DataFrame:
    """Rows of a catalogue (id, name, density_kg_m3, youngs_modulus_gpa, yield_strength_mpa, ultimate_strength_mpa, metadata JSON) as materials.

    Rows without a yield strength or modulus (null or 0) go. Ultimate strength is 1.2 and the fatigue limit 0.4 of the
    yield strength where not given; what metadata lacks has its default.
    """
    c = F.col
    full = rows.filter((F.coalesce(c("yield_strength_mpa"), F.lit(0)) != 0) & (F.coalesce(c("youngs_modulus_gpa"), F.lit(0)) != 0))
    told = lambda name: F.get_json_object("metadata", f"$.{name}").try_cast("double")
    y = c("yield_strength_mpa").cast("double")
    return full.select(
        "id", "name", (F.coalesce(c("density_kg_m3"), F.lit(7800)) / 1000).alias("density"), c("youngs_modulus_gpa").cast("double").alias("modulus"), y.alias("yield"),
        F.coalesce(c("ultimate_strength_mpa").cast("double"), y * 1.2).alias("ultimate"), F.coalesce(told("fatigue_limit"), y * 0.4).alias("fatigue_limit"),
        *(F.coalesce(told(name), F.lit(value)).alias(name) for name, value in DEFAULTS.items()),
    )


def union_of(*corpora: DataFrame) -> DataFrame:
    """One corpus after another, doubles kept."""
    out = corpora[0]
    for c in corpora[1:]:
        out = out.unionByName(c)
    return out


def substitutes(corpus: DataFrame, queries: DataFrame, row_id: str, axes: list[str], k: int = 5) -> DataFrame:
    """(query_id, row_id, feasible, similarity, rank) of the k best stand-ins for each query: feasible ones first, then by seven tenths similarity and three tenths score.

    corpus: row_id (whole numbers), axes scaled to 0..1, feasible, score; queries: rows of the same kind. similarity:
    1 / (1 + distance). Blocks of queries meet blocks of the corpus; no row is made for each pair.
    """
    n = len(axes)
    vector = F.array(*(F.col(a).cast("double") for a in axes), F.col("feasible").cast("double"), F.col("score").cast("double"))
    sides = [df.select(row_id, vector.alias("_v")) for df in (queries, corpus)]

    def keys(q, x):
        like = 1 / (1 + apart(q[:, :n], x[:, :n]))
        return [np.broadcast_to(-x[:, -2], like.shape), -(0.7 * like + 0.3 * x[:, -1][None, :]), like]

    found = best_between(*sides, k, None, row_id, "_v", keys, 2, others=True)
    return found.select("query_id", F.col("row_id").alias(row_id), (F.col("k0") < 0).alias("feasible"), F.col("k2").alias("similarity"), "rank")


def gate(ranked: DataFrame, scenario: str, rank: str = "rank", k: int = 5, least: int = 8) -> DataFrame:
    """One row over all scenarios: how many, the mean score of the k best (an infeasible one counts three tenths) and the share of feasible ones, and whether both pass: above 0.85 and 0.95, from `least` scenarios on."""
    top = ranked.filter(F.col(rank) <= k).groupBy(scenario).agg(F.avg(F.col("score") * F.when(F.col("feasible"), 1.0).otherwise(0.3)).alias("relevance"), F.avg(F.col("feasible").cast("double")).alias("satisfied"))
    one = top.agg(F.count(F.lit(1)).alias("scenarios"), F.coalesce(F.avg("relevance"), F.lit(0.0)).alias("relevance"), F.coalesce(F.avg("satisfied"), F.lit(0.0)).alias("satisfied"))
    return one.withColumn("ready", F.col("scenarios") >= least).withColumn("passed", F.col("ready") & (F.col("relevance") > 0.85) & (F.col("satisfied") > 0.95))


def strain_energy(kind: Column, eps: Column, p: dict[str, Column]) -> Column:
    """Energy density of a one-dimensional strain under one of five laws; p: mu, lambda, eta, tau, yield_stress, hardening, eps_frac, gc."""
    e = 2 * p["mu"] + p["lambda"]
    hook = 0.5 * e * eps * eps
    stretch = 1 + eps
    log = F.log(F.when(stretch > 0, stretch))
    neo = F.when(stretch > 0, 0.5 * p["mu"] * (stretch * stretch - 1) - p["mu"] * log + 0.5 * p["lambda"] * log * log).otherwise(float("inf"))
    visco = hook + 0.5 * (p["eta"] / F.greatest(p["tau"], F.lit(1e-9))) * eps * eps
    limit = p["yield_stress"] / F.greatest(e, F.lit(1e-9))
    beyond = F.abs(eps) - limit
    plastic = F.when(beyond <= 0, hook).otherwise(0.5 * e * limit * limit + p["yield_stress"] * beyond + 0.5 * p["hardening"] * beyond * beyond)
    damage = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.abs(eps) - p["eps_frac"]) * e / F.greatest(p["gc"], F.lit(1e-9))))
    return F.when(kind == "hookean", hook).when(kind == "neo-hookean", neo).when(kind == "viscoelastic", visco).when(kind == "plastic", plastic).when(kind == "fracture", hook * (1 - damage))


def strain_gradient(kind: Column, eps: Column) -> tuple[Column, Column]:
    """How the energy of the elastic laws grows with mu and with lambda."""
    stretch = 1 + eps
    log = F.log(F.when(stretch > 0, stretch))
    plain = F.when(kind.isin("hookean", "viscoelastic"), eps * eps)
    mu = F.when(kind == "neo-hookean", 0.5 * (stretch * stretch - 1) - log).otherwise(plain)
    lam = F.when(kind == "neo-hookean", 0.5 * log * log).otherwise(0.5 * plain)
    return mu, lam


def rates(df: DataFrame) -> DataFrame:
    """df (wall_ms, gpu_ms arrays; candidates, emitted, uniq, dropped) with seven rates of a sample; a sum of no finite GPU times is NaN, a ratio to nothing 0, that of unique to emitted 1."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    fine = F.filter("gpu_ms", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    own = df.withColumn("total_wall_ms", total(F.col("wall_ms"))).withColumn("total_gpu_ms", F.when(F.size(fine) > 0, total(fine)).otherwise(float("nan")))
    c, wall = F.col, F.col("total_wall_ms")
    return own.withColumns({
        "emitted_per_ms": ratio(c("emitted"), wall), "candidates_per_ms": ratio(c("candidates"), wall), "emission_ratio": ratio(c("emitted"), c("candidates")),
        "dedup_ratio": ratio(c("uniq"), c("emitted"), 1.0), "saturation_ratio": ratio(c("dropped"), c("emitted") + c("dropped")),
    })


RATES = ("total_wall_ms", "emitted_per_ms", "candidates_per_ms", "emission_ratio", "dedup_ratio", "saturation_ratio")


def mean_rates(df: DataFrame, strategy: str, order: str, last: int = 240) -> DataFrame:
    """(strategy, n, the mean of each rate, total_gpu_ms over finite ones) of each strategy's last samples."""
    w = Window.partitionBy(strategy).orderBy(F.desc(order))
    own = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last)
    return own.groupBy(strategy).agg(F.count(F.lit(1)).alias("n"), *(F.avg(r).alias(r) for r in RATES), F.coalesce(F.avg(F.when(~F.isnan("total_gpu_ms"), F.col("total_gpu_ms"))), F.lit(float("nan"))).alias("total_gpu_ms"))
