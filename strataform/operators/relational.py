"""Lookups, listings, existence, flags, upserts and text parsed into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.functions.scalars import bucket100


def latest(df: DataFrame, newest: str, tie: str, n: int = 50, equal: dict | None = None, contains: dict | None = None) -> DataFrame:
    """The n newest rows that fit: equal values, and case-insensitive patterns in which % and _ are wildcards. None is no condition."""
    for name, value in (equal or {}).items():
        df = df if value is None else df.filter(F.col(name) == value)
    for name, value in (contains or {}).items():
        df = df if value is None else df.filter(F.col(name).ilike(f"%{value}%"))
    return df.orderBy(F.desc(newest), F.desc(tie)).limit(n)


def single(df: DataFrame, optional: bool = False):
    """The one row of df; None if it may be missing; an error if there are more."""
    rows = df.limit(2).collect()
    if len(rows) == 1 or (optional and not rows):
        return rows[0] if rows else None
    raise ValueError("more than one row" if rows else "no row")


def lookup(df: DataFrame, other: DataFrame, key: str, other_key: str, columns: list[str]) -> DataFrame:
    """df with columns of the row of other that has its key; null where none has."""
    side = other.select(F.col(other_key).alias("_key"), *columns)
    return df.join(side, df[key] == side["_key"], "left").drop("_key")


def having(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    return df.join(other.select(F.col(other_key).alias(key)), key, "left_semi")


def lacking(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows without a partner: references whose target is missing, or targets that nothing refers to."""
    return df.join(other.select(F.col(other_key).alias(key)), key, "left_anti")


def flag_state(override: Column, enabled: Column, roles_given: Column, role_fits: Column, rollout: Column, seed: Column) -> Column:
    """Whether a flag is on: the user's override; else off if disabled; else on for a fitting role; else, where no
    roles are asked for, on for a rollout of 100; else by the hash bucket of a partial rollout; else off."""
    part = (rollout > 0) & (rollout < 100) & (bucket100(seed) < rollout)
    return F.coalesce(override, F.when(~enabled, False).when(roles_given & role_fits, True).when(~roles_given & (rollout == 100), True).otherwise(part))


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table and those of rows whose keys it doesn't have; of rows with the same keys, one."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({k: F.when(condition, v).otherwise(F.col(k)) for k, v in values.items()})


def append_event(events: DataFrame, snapshot: DataFrame, job: str, order: str, progress: str) -> DataFrame:
    """snapshot with each job's latest progress, rounded and kept within 0 to 100."""
    bounded = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.col(progress) + 0.5))).cast("int")
    last = events.groupBy(F.col(job).alias("_job")).agg(F.max_by(bounded, order).alias("_progress"))
    return snapshot.join(last, snapshot[job] == last["_job"], "left").withColumn("progress", F.coalesce("_progress", F.lit(0))).drop("_job", "_progress")


def kinds_of_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column how many cells are empty, numbers or text; a cell is a number if it reads as a finite one."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.trim(F.col(c).cast("string")).alias("cell")) for c in columns))).alias("c")).select("c.*")
    value = F.expr("try_cast(cell AS double)")
    number = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    empty = F.col("cell").isNull() | (F.col("cell") == "")
    return cells.groupBy("column_name").agg(F.count_if(empty).alias("n_empty"), F.count_if(~empty & number).alias("n_number"), F.count_if(~empty & ~number).alias("n_text"))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows with the same keys, the first."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def ranked(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """df with rank within the key, from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def scoped(clients: DataFrame, scope: str) -> DataFrame:
    """Clients that aren't revoked and have the scope among theirs (revoked_at, scopes)."""
    return clients.filter(F.col("revoked_at").isNull() & F.array_contains("scopes", scope))


def visible(rows: DataFrame, owner: str, user: int, roles: DataFrame, admin: str = "admin") -> DataFrame:
    """The rows that a user may see: all for one with the admin role, else their own. roles: (user_id, role)."""
    boss = roles.filter((F.col("user_id") == user) & (F.col("role") == admin)).limit(1).select(F.lit(True).alias("_boss"))
    own = rows.join(F.broadcast(boss), F.lit(True), "left")  # one row at most
    return own.filter(F.coalesce("_boss", F.lit(False)) | (F.col(owner) == user)).drop("_boss")


def display_name(meta: Column, email: Column) -> Column:
    """A profile's name: that given, the full name given, or what stands before the @ of the address."""
    return F.coalesce(F.get_json_object(meta, "$.display_name"), F.get_json_object(meta, "$.full_name"), F.split_part(email, F.lit("@"), F.lit(1)))


def stamped(df: DataFrame, old: DataFrame, key: str, columns: list[str], at: Column) -> DataFrame:
    """df with updated_at: `at` for rows that are new or differ from the old row of their key in a column, else the old time. old: key, columns, updated_at."""
    was = old.select(F.col(key).alias("_key"), F.struct(*columns).alias("_was"), F.col("updated_at").alias("_at"))
    both = df.join(was, df[key] == was["_key"], "left")
    return both.withColumn("updated_at", F.when(F.struct(*(df[c] for c in columns)).eqNullSafe(F.col("_was")), F.col("_at")).otherwise(at)).drop("_key", "_was", "_at")


def agreed(*sets: DataFrame) -> DataFrame:
    """The distinct rows of all, in order."""
    rows = sets[0]
    for s in sets[1:]:
        rows = rows.union(s)
    return rows.distinct().orderBy(*rows.columns)


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def in_first_only(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).distinct()


def summary_sets(df: DataFrame, keys: list[str], sets: list[list[str]], measures: dict[str, Column]) -> DataFrame:
    """Aggregates over several sets of keys at once: keys that a set leaves out are null, grouping_id tells the sets apart."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in keys)).agg(F.grouping_id(*keys).alias("grouping_id"), *(v.alias(k) for k, v in measures.items()))


def all_capable(paths: DataFrame, toggle: str, active: str, capable: str) -> DataFrame:
    """(toggle, allowed, lacking): whether every active path can do it, and the names of those that can't."""
    return paths.filter(active).groupBy(toggle).agg(F.every(capable).alias("allowed"), F.array_sort(F.collect_list(F.when(~F.col(capable), F.col("path")))).alias("lacking"))
