"""Files read into tables: inspection and training data, telemetry with aliased headers, and exchange files of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strataform.functions.scalars import finite
from strataform.operators.ordered import numbered


def read_table(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """Rows of a .json (an array, or one under rows, records, samples or observations), .jsonl, .ndjson or delimited file, as text cells.

    A delimited file needs a header; it is split at tabs if the header has a tab and no comma. Cells are trimmed.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("jsonl", "ndjson"):
        return spark.read.json(path)
    if kind == "json":
        df = spark.read.option("multiLine", True).json(path)
        for name in ("rows", "records", "samples", "observations"):
            if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType):
                return df.select(F.explode(name).alias("r")).select("r.*")
        return df
    head = spark.read.text(path).limit(1).collect()
    first = head[0][0] if head else ""
    tabs = "\t" in first and "," not in first
    return spark.read.csv(path, header=True, sep="\t" if tabs else ",", quote=quote, escape="", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def number(cell: Column) -> Column:
    """The finite number that a cell reads as, else null."""
    value = F.try_to_number(F.lit("0"), F.lit("9")) if cell is None else cell.cast("string").try_cast("double")
    return F.when(finite(value), value)


def typed(df: DataFrame) -> DataFrame:
    """df with each text column in which all cells that aren't empty are numbers as doubles. Flags become 0 and 1, arrays and structs JSON text."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    checks = df.agg(*(F.count_if((F.trim(F.col(f"`{n}`")) != "") & number(F.trim(F.col(f"`{n}`"))).isNull()).alias(n) for n in names)).first() if names else {}
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.name in names and checks[f.name] == 0:
            c = number(F.trim(c))
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int").cast("double")
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def observations(df: DataFrame, predicted: str, measured: str, part: str | None = None, ts: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows with finite predicted and measured values as (row, predicted, measured, part_id, ts); the others with a reason. A missing part is named after its row."""
    own = df.withColumn("row", F.monotonically_increasing_id())
    p, m = number(F.col(predicted)), number(F.col(measured))
    own = own.withColumns({"_p": p, "_m": m})
    part_id = F.coalesce(F.nullif(F.trim(F.col(part).cast("string")), F.lit("")), F.concat(F.lit("row-"), F.col("row"))) if part else F.concat(F.lit("row-"), F.col("row"))
    time = F.coalesce(number(F.col(ts)).cast("long"), F.unix_millis(F.col(ts).cast("string").try_cast("timestamp"))) if ts else F.lit(None).cast("long")
    good = own.filter("_p IS NOT NULL AND _m IS NOT NULL").select("row", F.col("_p").alias("predicted"), F.col("_m").alias("measured"), part_id.alias("part_id"), time.alias("ts"))
    bad = own.filter("_p IS NULL OR _m IS NULL").select("row", F.when(F.col("_p").isNull(), f"{predicted} isn't a number").otherwise(f"{measured} isn't a number").alias("reason"))
    return good, bad


def guess_columns(names: list[str], hints: dict[str, list[str]]) -> dict[str, str | None]:
    """For each role the column whose name holds most of its hints; the first of equals; none if no hint is found."""
    out: dict[str, str | None] = {}
    for role, words in hints.items():
        scores = [sum(w in n.lower() for w in words) for n in names]
        out[role] = names[scores.index(max(scores))] if scores and max(scores) else None
    return out


#: The header names that stand for telemetry columns.
ALIASES = {
    "t": "t", "time": "t", "timestamp": "t", "ts": "t",
    "energy_drift_pct": "energy_drift_pct", "drift": "energy_drift_pct", "energy_drift": "energy_drift_pct",
    "constraint_l2": "constraint_l2", "constraint": "constraint_l2", "l2": "constraint_l2",
    "divergence_risk": "divergence_risk", "divergence": "divergence_risk", "risk": "divergence_risk",
    "velocity_max": "velocity_max", "vmax": "velocity_max", "v_max": "velocity_max",
    "nan_count": "nan_count", "nans": "nan_count", "nan": "nan_count",
    "source": "source", "sensor": "source", "channel": "source",
}
TELEMETRY = ("t", "energy_drift_pct", "constraint_l2", "divergence_risk", "velocity_max", "nan_count", "source")


def telemetry(df: DataFrame, order: str | None = None) -> DataFrame:
    """df's rows as telemetry samples: columns found by their aliases, of several the last one that has a value; cells that aren't finite numbers dropped, rows without a time numbered among themselves in order, sources cut to 64 characters."""
    found: dict[str, list[str]] = {}
    for c in df.columns:
        if name := ALIASES.get(c.strip().lower()):
            found.setdefault(name, []).insert(0, c)
    cells = lambda name, f: F.coalesce(*(f(F.col(f"`{c}`")) for c in found.get(name, [])), F.lit(None))
    own = df.withColumn("_row", F.col(order) if order else F.monotonically_increasing_id())
    cols = {k: cells(k, number).cast("double") for k in TELEMETRY[:-1]}
    source = cells("source", lambda c: F.nullif(F.substring(F.trim(c.cast("string")), 1, 64), F.lit("")))
    own = numbered(own.select("_row", *(c.alias(k) for k, c in cols.items()), source.cast("string").alias("source")), "_row", where=F.col("t").isNull())
    return own.withColumn("t", F.coalesce("t", F.col("_n").cast("double"))).withColumn("nan_count", F.col("nan_count").cast("int")).drop("_n", "_row")


def valid_sample() -> Column:
    """Whether a sample keeps to its ranges: time there, residual, speed and count not negative, risk within 0..1, source of 1 to 64 characters."""
    c = F.col
    ok = c("t").isNotNull()
    for name in ("constraint_l2", "velocity_max", "nan_count"):
        ok &= c(name).isNull() | (c(name) >= 0)
    return ok & (c("divergence_risk").isNull() | c("divergence_risk").between(0, 1)) & (c("source").isNull() | F.length("source").between(1, 64))


def entities(files: DataFrame, file_id: str = "file_id", text: str = "text") -> DataFrame:
    """(file_id, position, id, type, args, duplicate) of the entities #id = TYPE(args); of exchange files, one text a row.

    Comments go; only the DATA section counts; a statement ends at a semicolon outside quotes. Of an id's statements
    the first stands, later ones are marked as duplicates; statements of several types are left out.
    """
    plain = F.regexp_replace(F.col(text), r"(?s)/\*.*?\*/", " ")
    data = F.regexp_extract(plain, r"(?s)DATA\s*;(.*?)ENDSEC\s*;", 1)
    statements = F.regexp_extract_all(data, F.lit(r"(?s)((?:[^;']|'[^']*')+);"), 1)
    own = files.select(file_id, F.posexplode(statements).alias("position", "s"))
    head = r"(?s)^\s*#(\d+)\s*=\s*([A-Z][A-Z0-9_]*)\s*\((.*)\)\s*$"
    own = own.filter(F.col("s").rlike(head)).select(file_id, "position", F.regexp_extract("s", head, 1).cast("long").alias("id"), F.regexp_extract("s", head, 2).alias("type"), F.regexp_extract("s", head, 3).alias("args"))
    return own.withColumn("duplicate", F.row_number().over(Window.partitionBy(file_id, "id").orderBy("position")) > 1)


def references(own: DataFrame, file_id: str = "file_id") -> DataFrame:
    """(file_id, from_id, position, to_id) of every #id in the entities' arguments, quoted text aside."""
    bare = F.regexp_replace("args", "'(?:[^']|'')*'", "")
    refs = F.transform(F.regexp_extract_all(bare, F.lit(r"#(\d+)"), 1), lambda x: x.cast("long"))
    return own.filter("NOT duplicate").select(file_id, F.col("id").alias("from_id"), F.posexplode(refs).alias("position", "to_id"))


def orphans(own: DataFrame, refs: DataFrame, file_id: str = "file_id") -> DataFrame:
    """References to entities that the file hasn't got."""
    return refs.join(own.select(file_id, F.col("id").alias("to_id")).distinct(), [file_id, "to_id"], "left_anti")


def roots(own: DataFrame, refs: DataFrame, file_id: str = "file_id") -> DataFrame:
    """Entities that nothing refers to."""
    return own.filter("NOT duplicate").join(refs.select(file_id, F.col("to_id").alias("id")).distinct(), [file_id, "id"], "left_anti")


def describe(own: DataFrame, file_id: str = "file_id") -> DataFrame:
    """(file_id, n_entities, n_duplicates, n_points, n_solids, min_x, max_x, ... of the points' coordinates) of the entities of each file; null for a file without points."""
    numbers = F.regexp_extract("args", r"\(\s*([^()]*?)\s*\)\s*$", 1)
    point = F.col("type") == "CARTESIAN_POINT"
    at = F.when(point & ~F.col("duplicate"), F.transform(F.split(numbers, ","), lambda x: F.trim(x).try_cast("double")))
    first = own.withColumn("_at", at)
    ends = [f(F.get("_at", i)).alias(f"{name}_{a}") for i, a in enumerate("xyz") for name, f in (("min", F.min), ("max", F.max))]
    return first.groupBy(file_id).agg(F.count_if(~F.col("duplicate")).alias("n_entities"), F.count_if("duplicate").alias("n_duplicates"), F.count_if(point & ~F.col("duplicate")).alias("n_points"), F.count_if(F.col("type").isin("MANIFOLD_SOLID_BREP", "BREP_WITH_VOIDS") & ~F.col("duplicate")).alias("n_solids"), *ends)


def with_source(df: DataFrame) -> DataFrame:
    """df of files with the path, size in bytes and time of the file that each row came from."""
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_bytes"), F.col("_metadata.file_modification_time").alias("file_time"))


def file_summary(df: DataFrame) -> DataFrame:
    """(file_path, rows, columns, bytes) of each file that df was read from."""
    return with_source(df).groupBy("file_path").agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.first("file_bytes").alias("bytes"))


#: The most samples that one delivery may hold.
BATCH = 256


def batches(deliveries: DataFrame, delivery: str, samples: str) -> tuple[DataFrame, DataFrame]:
    """((delivery, sample) of deliveries of 1 to BATCH samples (an array), one row a sample; (delivery, n) of the others)."""
    n = F.coalesce(F.size(samples), F.lit(0))
    fine = (n >= 1) & (n <= BATCH)
    return deliveries.filter(fine).select(delivery, F.explode(samples).alias("sample")), deliveries.filter(~fine).select(delivery, n.alias("n"))
