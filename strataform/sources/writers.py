"""Tables written as mesh files and report documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def obj_lines(tets: DataFrame, vertices: DataFrame) -> DataFrame:
    """(part, position, line) of an OBJ file: vertices in order of vid, then each tet's four faces; vertex numbers start at 1 and follow vid from 0 without gaps."""
    v = vertices.select(F.lit(0).alias("part"), F.col("vid").cast("long").alias("position"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("line"))
    corner = [F.col(f"v{i}") + 1 for i in range(4)]
    faces = F.array(*(F.concat_ws(" ", F.lit("f"), *(corner[i] for i in f)) for f in ((0, 2, 1), (0, 1, 3), (1, 2, 3), (0, 3, 2))))
    f = tets.select(F.lit(1).alias("part"), F.col("tet_id").cast("long").alias("tet"), F.posexplode(faces).alias("n", "line")).select("part", (F.col("tet") * 4 + F.col("n")).alias("position"), "line")
    return v.unionByName(f)


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files whose names, in order, hold the lines in order."""
    lines.repartitionByRange("part", "position").sortWithinPartitions("part", "position").select("line").write.text(path)


def report(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, body): each section's rows as JSON, one row each; sections are summaries of few rows."""
    out = None
    for name, df in sections.items():
        part = df.select(F.to_json(F.struct(*df.columns)).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rows")).select(F.lit(name).alias("section"), F.concat(F.lit("["), F.array_join("rows", ","), F.lit("]")).alias("body"))
        out = part if out is None else out.unionByName(part)
    return out


def append_by_date(samples: DataFrame, path: str, at: str = "ingested_at") -> None:
    samples.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def _head(counts: DataFrame, part: int, *lines) -> DataFrame:
    """Lines at the head of a part, made from a row of counts."""
    return counts.select(F.lit(part).alias("part"), F.posexplode(F.array(*lines)).alias("n", "line")).select("part", (F.col("n") - len(lines)).cast("long").alias("position"), "line")


def vtk_lines(tets: DataFrame, vertices: DataFrame, values: tuple[str, ...] = ()) -> DataFrame:
    """(part, position, line) of a legacy VTK file of tets (tet_id, v0 to v3, and the values, a number a tet): vertex numbers follow vid from 0 without gaps."""
    n = vertices.agg(F.count(F.lit(1)).alias("points")).crossJoin(tets.agg(F.count(F.lit(1)).alias("cells")))  # one row each
    cells, order = F.col("cells"), F.col("tet_id").cast("long").alias("position")
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    parts = [
        _head(n, 0, F.lit("# vtk DataFile Version 3.0"), F.lit("mesh"), F.lit("ASCII"), F.lit("DATASET UNSTRUCTURED_GRID"), text("POINTS ", F.col("points").cast("string"), " float")),
        vertices.select(F.lit(0).alias("part"), F.col("vid").cast("long").alias("position"), F.concat_ws(" ", "x", "y", "z").alias("line")),
        _head(n, 1, text("CELLS ", cells.cast("string"), " ", (cells * 5).cast("string"))),
        tets.select(F.lit(1).alias("part"), order, F.concat_ws(" ", F.lit("4"), "v0", "v1", "v2", "v3").alias("line")),
        _head(n, 2, text("CELL_TYPES ", cells.cast("string"))),
        tets.select(F.lit(2).alias("part"), order, F.lit("10").alias("line")),
    ]
    for k, name in enumerate(values):
        first = [text("CELL_DATA ", cells.cast("string"))] if k == 0 else []
        parts += [_head(n, 3 + k, *first, F.lit(f"SCALARS {name} float 1"), F.lit("LOOKUP_TABLE default")), tets.select(F.lit(3 + k).alias("part"), order, F.col(name).cast("string").alias("line"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def refined(tets: DataFrame, errors: DataFrame, split: float, merge: float) -> DataFrame:
    """tets with error and mask: 1 for those to split, -1 for those to merge, 0 for others; a tet without an error has 0. errors: (tet_id, error)."""
    own = tets.join(errors.select("tet_id", "error"), "tet_id", "left").withColumn("error", F.coalesce("error", F.lit(0.0)))
    return own.withColumn("mask", F.when(F.col("error") >= split, 1).when(F.col("error") <= merge, -1).otherwise(0))


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a line."""
    df.write.json(path)
