"""Signatures of graphs: feature classes of nodes, scores of how a shape can be made, and 40 numbers for each graph of a table.

Graphs are told by a column, so one plan serves all of them; nodes are read for their bounds and once more for the
sums, and a graph's numbers are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.tables import cut

AXES = ("x", "y", "z")
#: The classes in the order of their numbers, the weight of an inner node, the density from which a node is dense, and the seeds that a graph has at most, and one for so many nodes.
CLASSES = ("bulk", "boundary", "thin_wall", "overhang", "cavity", "stress_concentrator", "thermal_bottleneck", "symmetry_seed")
INNER, DENSE, SEEDS, NODES_A_SEED = 0.25, 0.4, 32, 50
#: How a class' share of the boundary (or, of bottlenecks, of all nodes) becomes a penalty, and what the penalty takes from feasibility.
PENALTIES = {"overhang": (1.5, 0.30), "cavity": (2.0, 0.20), "thin_wall": (1.2, 0.20), "stress_concentrator": (0.8, 0.15), "thermal_bottleneck": (1.4, 0.15)}


def feature_class(boundary: Column, tag: Column, curvature: Column, cavity: Column, downward: Column, wall: Column) -> Column:
    """The class of a node, the first that fits. Of boundary nodes: sharp ones of curvature 3 and fillets of curvature 2 or more concentrate stress; cavity walls; those that face down; thin walls by tag or of one or two steps. Of inner ones flat hotspots are bottlenecks."""
    stress = ((tag == "sharp") & (curvature >= 3)) | ((tag == "fillet") & (curvature >= 2))
    outer = F.when(stress, "stress_concentrator").when(cavity, "cavity").when(downward, "overhang").when((tag == "thin_wall") | ((wall > 0) & (wall <= 2)), "thin_wall").otherwise("boundary")
    return F.when(boundary, outer).when((tag == "hotspot") & (curvature == 0), "thermal_bottleneck").otherwise("bulk")


def _clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def signatures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, n_nodes, n_edges, symmetry, feasibility, support, access, distortion, complexity, vector) of every graph with nodes.

    nodes: (graph, id, x, y, z, curvature, density, boundary boolean, feature of CLASSES); edges: (graph, a, b, shared),
    each once. vector: shares of nodes by curvature 0 to 5 and more, thin and dense each (12); shares by class (8); mean
    place and spread by axis from the middle of the bounds, in parts of the longest side, mean and largest number of
    neighbours, edges a node, mean shared area, symmetry, size (12); the scores and the three first penalties (8). Of bulk
    nodes those nearest to a middle plane are symmetry seeds, one for NODES_A_SEED nodes.
    """
    box = cut(nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n"), *(f(a).cast("double").alias(f"{m}_{a}") for a in AXES for m, f in (("min", F.min), ("max", F.max)))))
    sides = [F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES]
    box = box.withColumns({"ext": F.greatest(F.lit(1e-6), *sides), "aspect": F.greatest(*sides) / F.greatest(F.lit(1e-6), F.least(*sides)), **{f"c_{a}": (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in AXES}})
    own = nodes.join(box, "graph")
    near = F.least(*(F.abs(F.col(a) - F.col(f"c_{a}")) for a in AXES))
    own = own.withColumn("_near", near)
    # The nearest of a graph are among the nearest of its shares.
    share = own.select("graph", "id", "n", "_near", F.pmod(F.xxhash64("id"), F.lit(64)).alias("_share"))
    first = share.withColumn("_r", F.row_number().over(Window.partitionBy("graph", "_share").orderBy("_near", "id"))).filter(F.col("_r") <= SEEDS)
    wanted = F.least(F.lit(SEEDS), F.floor(F.col("n") / NODES_A_SEED))
    seeds = first.withColumn("_r", F.row_number().over(Window.partitionBy("graph").orderBy("_near", "id"))).filter(F.col("_r") <= wanted).select("graph", "id", F.lit(True).alias("_seed"))
    own = own.join(seeds, ["graph", "id"], "left").withColumn("feature", F.when((F.col("feature") == "bulk") & F.col("_seed"), "symmetry_seed").otherwise(F.col("feature")))
    weight = F.when(F.col("boundary"), 1.0).otherwise(INNER)
    bend, dense = F.least(F.lit(5), F.col("curvature")), F.col("density") >= DENSE
    off = {a: (F.col(a) - F.col(f"c_{a}")) / F.col("ext") for a in AXES}
    sums = own.groupBy("graph").agg(
        *(F.count_if((bend == c) & (dense if d else ~dense)).alias(f"k{c}{d}") for c in range(6) for d in (0, 1)), *(F.count_if(F.col("feature") == c).alias(c) for c in CLASSES),
        *(F.sum(off[a]).alias(f"m_{a}") for a in AXES), *(F.sum(off[a] * off[a]).alias(f"s_{a}") for a in AXES), F.sum(weight).alias("mass"), *(F.sum(F.when(F.col(a) < F.col(f"c_{a}"), weight).otherwise(0.0)).alias(f"low_{a}") for a in AXES),
    )
    ends = edges.select("graph", F.explode(F.array("a", "b")).alias("id")).groupBy("graph", "id").agg(F.count(F.lit(1)).alias("v")).groupBy("graph").agg(F.sum("v").alias("v_sum"), F.max("v").alias("v_max"))
    links = edges.groupBy("graph").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("shared").alias("area"))
    one = sums.join(box.select("graph", "n", "ext", "aspect"), "graph").join(ends, "graph", "left").join(links, "graph", "left").na.fill(0, ["v_sum", "v_max", "n_edges", "area"])
    n, edge = F.col("n"), F.greatest(F.lit(1), *[sum((F.col(c) for c in ("thin_wall", "overhang", "cavity", "stress_concentrator")), F.col("boundary"))])
    share_of = {c: F.col(c) / (n if c == "thermal_bottleneck" else edge) for c in PENALTIES}
    penalty = {c: _clamp(share_of[c] * rate) for c, (rate, _) in PENALTIES.items()}
    symmetry = _clamp(1 - sum((F.abs(2 * F.col(f"low_{a}") - F.col("mass")) / F.col("mass") for a in AXES), F.lit(0.0)) / 3)
    feasibility = F.lit(1.0)
    for c, (_, part) in PENALTIES.items():
        feasibility = feasibility - part * penalty[c]
    scores = {
        "symmetry": symmetry, "feasibility": _clamp(feasibility), "support": _clamp(share_of["overhang"] + 0.4 * share_of["thin_wall"]), "access": _clamp(1 - penalty["cavity"] * 0.7 - _clamp((F.col("aspect") - 2) / 8) * 0.3),
        "distortion": _clamp(penalty["thermal_bottleneck"] * 0.5 + penalty["thin_wall"] * 0.4 + (1 - symmetry) * 0.4), "complexity": _clamp(edge / n * 1.3 + penalty["cavity"] * 0.4),
    }
    vector = [
        *(F.col(f"k{c}{d}") / n for c in range(6) for d in (0, 1)), *(F.col(c) / n for c in CLASSES), *(F.col(f"m_{a}") / n for a in AXES), *(F.sqrt(F.col(f"s_{a}") / n) for a in AXES), F.col("v_sum") / n / 6, F.col("v_max") / 6,
        F.col("n_edges") / n, F.col("area") / F.greatest(F.lit(1), F.col("n_edges")) / (F.col("ext") * F.col("ext")), symmetry, F.log10(n + 1) / 6, *(scores[k] for k in ("feasibility", "support", "access", "distortion", "complexity")), *(penalty[c] for c in ("overhang", "cavity", "thin_wall")),
    ]
    return one.select("graph", F.col("n").alias("n_nodes"), "n_edges", *(v.alias(k) for k, v in scores.items()), F.array(*(v.cast("double") for v in vector)).alias("vector"))
