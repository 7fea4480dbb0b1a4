"""Meshes and sparse matrices as tables: quality, shared faces, assembly and products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble(entries: DataFrame) -> DataFrame:
    """(row, col, value): entries of the same place added up."""
    return entries.groupBy("row", "col").agg(F.sum("value").alias("value"))


def times_vector(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(row, value) of matrix (row, col, value) times vector (col, x)."""
    return matrix.join(vector, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def inner(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("x", "_x"), "col").agg(F.coalesce(F.sum(F.col("x") * F.col("_x")), F.lit(0.0)).alias("value"))


def corners(tets: DataFrame, vertices: DataFrame) -> DataFrame:
    """tets (tet_id, v0 to v3) with p, the four corners' coordinates in order; vertices: vid, x, y, z."""
    each = tets.select("tet_id", F.posexplode(F.array("v0", "v1", "v2", "v3")).alias("n", "vid"))
    return each.join(vertices, "vid").groupBy("tet_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.array("x", "y", "z").alias("p")))), lambda s: s["p"]).alias("p"))


def _minus(a: Column, b: Column) -> list[Column]:
    return [a[i] - b[i] for i in range(3)]


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def volume(p: Column) -> Column:
    a, b, c = (_minus(p[i], p[0]) for i in (1, 2, 3))
    n = _cross(b, c)
    return (a[0] * n[0] + a[1] * n[1] + a[2] * n[2]) / 6


def aspect(p: Column) -> Column:
    """Longest edge by shortest; infinite for an edge of no length."""
    edges = [F.sqrt(sum((d * d for d in _minus(p[i], p[j])), F.lit(0.0))) for i in range(4) for j in range(i)]
    return F.when(F.least(*edges) > 0, F.greatest(*edges) / F.least(*edges)).otherwise(float("inf"))


def quality(tets: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: n_tets, mean and worst aspect, sum, least and mean volume, inverted, and faces that aren't shared by one or two."""
    own = corners(tets, vertices).select(volume(F.col("p")).alias("v"), aspect(F.col("p")).alias("a"))
    one = own.agg(F.count(F.lit(1)).alias("n_tets"), F.avg("a").alias("mean_aspect"), F.max("a").alias("worst_aspect"), F.sum("v").alias("volume"), F.min("v").alias("least_volume"), F.avg("v").alias("mean_volume"), F.count_if(F.col("v") <= 0).alias("inverted"))
    odd = faces(tets).groupBy("face").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(~F.col("n").isin(1, 2)).alias("non_manifold"))
    return one.crossJoin(odd)  # one row each


def faces(tets: DataFrame) -> DataFrame:
    """(tet_id, face): each of the four faces as its vertices in order."""
    v = [F.col(f"v{i}") for i in range(4)]
    return tets.select("tet_id", F.explode(F.array(*(F.array_sort(F.array(*(v[j] for j in range(4) if j != i))) for i in range(4)))).alias("face"))


def neighbours(tets: DataFrame) -> DataFrame:
    """(a, b), a < b, of the tets that share a face no third one has."""
    own = faces(tets).groupBy("face").agg(F.count(F.lit(1)).alias("n"), F.min("tet_id").alias("a"), F.max("tet_id").alias("b"))
    return own.filter("n = 2 AND a < b").select("a", "b")


def stiffness(tets: DataFrame, vertices: DataFrame, kappa: str = "kappa") -> DataFrame:
    """(row, col, value) of the linear finite-element Laplacian: kappa |V| (g_i . g_j) for the 16 entries of each tet, added up; tets under a volume of 1e-20 are skipped."""
    own = corners(tets, vertices).join(tets, "tet_id").withColumn("vol", volume(F.col("p"))).filter(F.abs("vol") >= 1e-20)
    p, six = F.col("p"), 6 * F.col("vol")
    g = []
    for i in range(4):
        j, k, m = ((i + 1) % 4, (i + 2) % 4, (i + 3) % 4)
        sign = 1 if i % 2 else -1
        g.append([sign * c / six for c in _cross(_minus(p[k], p[j]), _minus(p[m], p[j]))])
    entries = F.array(*(F.struct(F.col(f"v{i}").alias("row"), F.col(f"v{j}").alias("col"), (F.col(kappa) * F.abs("vol") * sum((a * b for a, b in zip(g[i], g[j])), F.lit(0.0))).alias("value")) for i in range(4) for j in range(4)))
    return assemble(own.select(F.explode(entries).alias("e")).select("e.*"))
