"""Cells and surfaces: shared faces, thickness, cavities, curvature and deformation, partitions and how to balance them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.functions.scalars import morton30, rounded_key
from strataform.operators import graph
from strataform.operators.ordered import numbered
from strataform.tables import bucketed, cut, drop, large

AXES = ("x", "y", "z")


def leaf_faces(leaves: DataFrame, step: float = 1e-6) -> DataFrame:
    """(a, b, axis, area), a < b, of the leaves (id, min_x, max_x, ...) that share a whole face; leaves of different sizes don't. Faces meet by their rounded corners."""
    faces = []
    for axis in AXES:
        others = [a for a in AXES if a != axis]
        area = (F.col(f"max_{others[0]}") - F.col(f"min_{others[0]}")) * (F.col(f"max_{others[1]}") - F.col(f"min_{others[1]}"))
        for side in ("min", "max"):
            corners = [F.col(f"{side}_{axis}"), *(F.col(f"{m}_{o}") for o in others for m in ("min", "max"))]
            faces.append(F.struct(F.concat(F.lit(f"{axis}|"), rounded_key(corners, step)).alias("key"), F.lit(axis).alias("axis"), area.alias("area")))
    rows = leaves.select("id", F.explode(F.array(*faces)).alias("f")).select("id", "f.*")
    each = rows.groupBy("key", "axis").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("area").alias("area"))
    return each.filter("a < b").groupBy("a", "b").agg(F.first("axis").alias("axis"), F.min("area").alias("area"))


def vertex_pool(points: DataFrame, order: str, step: float) -> DataFrame:
    """(order, vertex, first): each point's vertex, numbered from 0 in order of first use; points within the same step share one."""
    own = points.withColumn("_key", rounded_key([F.col(a) for a in AXES], step))
    firsts = own.groupBy("_key").agg(F.min(order).alias("first"))
    return own.select(order, "_key").join(numbered(firsts, "first"), "_key").select(order, F.col("_n").alias("vertex"), "first")


def wall_thickness(edges: DataFrame, boundary: DataFrame, most: int = 6) -> DataFrame:
    """(key, thickness): steps from each boundary node to the nearest other one that isn't beside it through the surface, along edges (a, b, both ways), `most` at most; 0 if none is reached."""
    edges = cut(edges.select("a", "b").distinct())
    seen = cut(boundary.select(F.col("key").alias("root"), "key", F.lit(0).alias("depth")))
    marks = boundary.select("key", F.lit(True).alias("hit"))
    found = None
    for depth in range(1, most + 1):
        front = seen.filter(F.col("depth") == depth - 1).select("root", F.col("key").alias("a"))
        new = edges.join(front, "a").select("root", F.col("b").alias("key")).distinct().join(seen.select("root", "key"), ["root", "key"], "left_anti")
        new = cut(new.withColumn("depth", F.lit(depth)))
        hits = cut(new.join(marks, "key").groupBy("root").agg(F.min("depth").alias("thickness")))
        found = hits if found is None else found.unionByName(hits)
        done = hits.select("root")
        seen = cut(seen.unionByName(new).join(done, "root", "left_anti"))
        if seen.filter(F.col("depth") == depth).isEmpty():
            break
    return boundary.select("key").join(found.select(F.col("root").alias("key"), "thickness"), "key", "left").select("key", F.coalesce("thickness", F.lit(0)).alias("thickness"))


def cavities(nodes: DataFrame, edges: DataFrame, outside: DataFrame) -> DataFrame:
    """(key, component) of the nodes that no path of edges (a, b) joins with an outside node: enclosed pockets, each named after its smallest node."""
    parts = graph.components(edges, sort=True)
    named = cut(nodes.select("key").join(large(parts), "key", "left").select("key", F.coalesce("component", "key").alias("component")))
    open_ = named.join(large(outside.select("key")), "key", "left_semi").select("component").distinct()
    return named.join(large(open_), "component", "left_anti").select("key", "component")


def corner_angles(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """(tri_id, vid, angle, area) of each corner of each triangle (tri_id, v0, v1, v2); vertices: vid, x, y, z."""
    each = triangles.select("tri_id", F.posexplode(F.array("v0", "v1", "v2")).alias("n", "vid")).join(vertices, "vid")
    own = each.groupBy("tri_id").agg(F.array_sort(F.collect_list(F.struct("n", "vid", F.array(*AXES).alias("p")))).alias("c"))
    p = [F.col("c")[i]["p"] for i in range(3)]
    minus = lambda a, b: [a[i] - b[i] for i in range(3)]
    length = lambda v: F.sqrt(sum((d * d for d in v), F.lit(0.0)))
    u, v = minus(p[1], p[0]), minus(p[2], p[0])
    area = length([u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]) / 2
    rows = []
    for i in range(3):
        a, b = minus(p[(i + 1) % 3], p[i]), minus(p[(i + 2) % 3], p[i])
        size = length(a) * length(b)
        cosine = F.when(size > 0, sum((x * y for x, y in zip(a, b)), F.lit(0.0)) / size).otherwise(1.0)
        rows.append(F.struct(F.col("c")[i]["vid"].alias("vid"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))).alias("angle")))
    return own.select("tri_id", area.alias("area"), F.explode(F.array(*rows)).alias("r")).select("tri_id", "r.vid", "r.angle", "area")


def curvature(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vid, area, gauss): what the angles around each vertex lack of a full turn, by a third of the area of its triangles."""
    sums = corner_angles(triangles, vertices).groupBy("vid").agg(F.sum("angle").alias("angle"), (F.sum("area") / 3).alias("area"))
    return sums.select("vid", "area", F.when(F.col("area") > 0, (2 * F.pi() - F.col("angle")) / F.col("area")).otherwise(0.0).alias("gauss"))


def deformation(edges: DataFrame, rest: DataFrame, moved: DataFrame) -> DataFrame:
    """One row: mean and largest displacement of the vertices (vid, x, y, z), and of the edges (a, b) the mean and largest change of length by their length at rest."""
    far = lambda s, t: F.sqrt(sum(((F.col(f"{s}{c}") - F.col(f"{t}{c}")) * (F.col(f"{s}{c}") - F.col(f"{t}{c}")) for c in AXES), F.lit(0.0)))
    both = rest.select("vid", *(F.col(c).cast("double").alias(f"r{c}") for c in AXES)).join(moved.select("vid", *(F.col(c).cast("double").alias(f"m{c}") for c in AXES)), "vid")
    shift = both.agg(F.avg(far("r", "m")).alias("mean_shift"), F.max(far("r", "m")).alias("most_shift"))
    ends = both.select(F.struct("*").alias("s"))
    pairs = edges.select("a", "b").join(ends.select(F.col("s.vid").alias("a"), F.col("s").alias("p")), "a").join(ends.select(F.col("s.vid").alias("b"), F.col("s").alias("q")), "b")
    length = lambda m: F.sqrt(sum(((F.col(f"p.{m}{c}") - F.col(f"q.{m}{c}")) * (F.col(f"p.{m}{c}") - F.col(f"q.{m}{c}")) for c in AXES), F.lit(0.0)))
    change = F.when(length("r") > 0, F.abs(length("m") / length("r") - 1)).otherwise(0.0)
    return shift.crossJoin(pairs.agg(F.avg(change).alias("mean_stretch"), F.max(change).alias("most_stretch")))  # one row each


def strip_partition(cells: DataFrame, parts: int, row_id: str = "id", axes=AXES) -> DataFrame:
    """(row_id, part): cells (coordinates in 0..1) in the order of a space-filling curve, cut into parts of equal number, the first ones a cell larger where it doesn't divide."""
    coded = cells.select(row_id, morton30(*(F.col(a) for a in axes)).alias("code"))
    n = cells.count()
    return numbered(coded, "code", row_id).select(row_id, graph.block_owner(F.col("_n"), F.lit(n), parts).alias("part"))


def loads(owners: DataFrame, weight: Column | None = None) -> DataFrame:
    """(part, load, target, over): the weights of each part's rows, 0 counting as 1, the mean of all parts, and the share above it."""
    w = F.lit(1.0) if weight is None else F.when(F.coalesce(weight, F.lit(0)) > 0, weight).otherwise(1.0)
    own = owners.groupBy(F.col("owner").alias("part")).agg(F.sum(w).alias("load"))
    mean = F.broadcast(own.agg(F.avg("load").alias("target")))  # one row
    return own.crossJoin(mean).select("part", "load", "target", (F.col("load") / F.col("target") - 1).alias("over"))


def migration(edges: DataFrame, owners: DataFrame, rounds: int = 8, most: float = 1.1) -> tuple[DataFrame, DataFrame]:
    """(owners after, moves (round, key, from_part, to_part)): in each round every part above `most` times the mean sends boundary nodes to the neighbouring part they have most edges to, if that is below the mean, as many as it has too many and those can take.

    owners: (key, owner); edges: (a, b). All parts move at once, unlike a scheme that moves one node after another.
    """
    both = cut(graph.both_ways(edges))
    now, moves = cut(owners.select("key", "owner")), None
    for k in range(rounds):
        load = cut(loads(now))
        high = load.filter(F.col("load") > most * F.col("target")).select(F.col("part").alias("owner"), F.floor(F.col("load") - F.col("target")).alias("spare"))
        low = load.filter(F.col("load") < F.col("target")).select(F.col("part").alias("to_part"), F.floor(F.col("target") - F.col("load")).alias("room"))
        o = lambda side: now.select(F.col("key").alias(side), F.col("owner").alias(f"o_{side}"))  # noqa: E731, B023
        touch = both.join(o("a"), "a").join(o("b"), "b").filter("o_a <> o_b").groupBy(F.col("a").alias("key"), F.col("o_a").alias("owner"), F.col("o_b").alias("to_part")).agg(F.count(F.lit(1)).alias("contact"))
        best = touch.join(low, "to_part").join(high, "owner").groupBy("key", "owner", "spare").agg(F.max_by(F.struct("to_part", "room"), F.struct("contact", -F.col("to_part"))).alias("t"), F.max("contact").alias("contact"))
        ranked = best.select("key", "owner", "spare", "t.*", "contact")
        out = Window.partitionBy("owner").orderBy(F.desc("contact"), "key")
        into = Window.partitionBy("to_part").orderBy(F.desc("contact"), "key")
        chosen = cut(ranked.withColumn("_o", F.row_number().over(out)).filter("_o <= spare").withColumn("_i", F.row_number().over(into)).filter("_i <= room").select(F.lit(k).alias("round"), "key", F.col("owner").alias("from_part"), "to_part"))
        if chosen.isEmpty():
            break
        moves = chosen if moves is None else moves.unionByName(chosen)
        now = cut(now.join(chosen.select("key", "to_part"), "key", "left").select("key", F.coalesce("to_part", "owner").alias("owner")))
    if moves is None:
        moves = now.select(F.lit(0).alias("round"), "key", F.col("owner").alias("from_part"), F.col("owner").alias("to_part")).limit(0)
    return now, moves


def recovery(parts: DataFrame, failed: DataFrame, survivors: DataFrame) -> DataFrame:
    """(part, from_owner, to_owner): the parts of failed owners dealt to survivors, largest first to the least loaded by turns. parts: (part, owner, size); a row a part and owner, so few."""
    lost = parts.join(failed.select("owner"), "owner", "left_semi")
    kept = survivors.select("owner").join(parts.groupBy("owner").agg(F.sum("size").alias("load")), "owner", "left").select("owner", F.coalesce("load", F.lit(0)).alias("load"))
    n = kept.count()
    seats = kept.withColumn("seat", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("load", "owner")) - 1)
    turns = lost.withColumn("turn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "part")) - 1)
    seat = F.when(F.floor(F.col("turn") / n) % 2 == 0, F.col("turn") % n).otherwise(n - 1 - F.col("turn") % n)
    return turns.withColumn("seat", seat.cast("int")).join(seats.select("seat", F.col("owner").alias("to_owner")), "seat").select("part", F.col("owner").alias("from_owner"), "to_owner")


def digests(rows: DataFrame, part: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """((part, n, digest), root digest): a digest of each part's rows that doesn't depend on their order, and one over all parts."""
    each = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("string").alias("sum"), F.bit_xor(F.xxhash64(*columns, F.lit(7))).alias("xor"))
    each = each.select(part, "n", F.sha2(F.concat_ws("|", part, "n", "sum", "xor"), 256).alias("digest"))
    return each, each.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), "|"), 256).alias("root"))


def send_rounds(messages: DataFrame) -> DataFrame:
    """(a, b, n, round): each pair of parts that exchange n rows gets a round in which neither has another partner: pairs in order, each in the first round that is free. Pairs of parts are few: as many as a cluster's processes squared."""
    rows = sorted((r["a"], r["b"], r["n"]) for r in messages.select("a", "b", "n").collect())
    busy: dict = {}
    out = []
    for a, b, n in rows:
        k = 0
        while k in busy.setdefault(a, set()) or k in busy.setdefault(b, set()):
            k += 1
        busy[a].add(k), busy[b].add(k)
        out.append((a, b, n, k))
    return messages.sparkSession.createDataFrame(out, messages.select("a", "b", "n").schema.add("round", "integer"))


#: Hops from the boundary within which a cell can be reached, and neighbours on it that make it dense.
IN_REACH, DENSE = 3, 4


def fabrication(cells: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class, dense, pocket) of every cell (id, z, boundary boolean); links: (a, b), in either direction.

    A boundary cell is `overhang` without a neighbour that lies lower, else `boundary`, and dense if four neighbours or
    more are on the boundary. Other cells are `trapped` if no way through such cells leads to the boundary (pocket: the
    smallest id of those it is trapped with), `deep` if more than three hops from it, else `interior`.
    """
    own = cut(cells.select("id", "z", F.coalesce("boundary", F.lit(False)).alias("boundary")))
    side = lambda n: own.select(F.col("id").alias(n), F.struct("z", "boundary").alias(f"_{n}"))
    both = cut(graph.both_ways(links).filter("a <> b").distinct().join(large(side("a")), "a").join(large(side("b")), "b"))
    lower = F.max(F.col("_b.z") < F.col("_a.z") - 1e-9)
    around = both.groupBy(F.col("a").alias("id")).agg(lower.alias("held"), F.count_if("_b.boundary").alias("n_boundary"))
    inside = both.filter("NOT _a.boundary AND NOT _b.boundary AND a < b").select("a", "b")
    pockets = own.filter("NOT boundary").select("id").join(large(graph.components(inside, sort=True)).withColumnRenamed("key", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("pocket"))
    pockets = cut(pockets)
    open_ = pockets.join(large(around.filter("n_boundary > 0").select("id")), "id", "left_semi").select("pocket").distinct()
    shut = pockets.join(large(open_), "pocket", "left_anti")
    reached = graph.depths(both, own.filter("boundary").select(F.col("id").alias("key")), IN_REACH, sort=True).select(F.col("key").alias("id"), "depth")
    told = own.join(large(around), "id", "left").join(large(shut), "id", "left").join(large(reached), "id", "left")
    kind = F.when(F.col("boundary"), F.when(F.coalesce("held", F.lit(False)), "boundary").otherwise("overhang")).when(F.col("pocket").isNotNull(), "trapped").when(F.col("depth").isNull(), "deep").otherwise("interior")
    return told.select("id", kind.alias("class"), ((kind == "boundary") & (F.coalesce("n_boundary", F.lit(0)) >= DENSE)).alias("dense"), "pocket")


def second_vector(edges: DataFrame, rounds: int = 60, seed: int = 1) -> DataFrame:
    """(key, value): what is left of a random start after lazy steps of a random walk over edges (a, b), its degree-weighted mean taken out: close to the second eigenvector, which changes slowly along edges.

    Edges are bucketed once; a step shuffles a value a key. Every eighth step is written, centred and scaled.
    """
    both, _ = bucketed(graph.both_ways(edges).filter("a <> b").distinct(), "b")
    degrees = cut(both.groupBy(F.col("a").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("degree")))
    x = degrees.select("key", "degree", ((F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 20))) / float(1 << 19) - 1).alias("value"))
    before = None
    for k in range(rounds):
        heard = both.join(x.select(F.col("key").alias("b"), "value"), "b").groupBy(F.col("a").alias("key")).agg(F.sum("value").alias("heard"))
        x = x.join(heard, "key").select("key", "degree", ((F.col("value") + F.col("heard") / F.col("degree")) / 2).alias("value"))
        if k % 8 == 7 or k == rounds - 1:
            now = cut(x)
            if before is not None:
                drop(before)
            s = now.agg((F.sum(F.col("degree") * F.col("value")) / F.sum("degree")).alias("mean"), F.max(F.abs("value")).alias("most")).first()
            mean, scale = s["mean"] or 0.0, max((s["most"] or 0.0) - abs(s["mean"] or 0.0), 1e-300)
            before, x = now, now.select("key", "degree", ((F.col("value") - mean) / scale).alias("value"))
    return x.select("key", "value")


def spectral_partition(edges: DataFrame, parts: int, rounds: int = 60, most: float = 1.05, refine: int = 8) -> DataFrame:
    """(key, owner): keys in the order of second_vector(), cut into parts of equal number, and refined()."""
    vector = cut(second_vector(edges, rounds))
    owners = numbered(vector, "value", "key").select("key", graph.block_owner(F.col("_n"), F.lit(vector.count()), parts).alias("owner"))
    return refined(edges, owners, refine, most)


def refined(edges: DataFrame, owners: DataFrame, rounds: int = 8, most: float = 1.05) -> DataFrame:
    """(key, owner): owners after rounds of moves that lessen the edges (a, b) cut between parts, the best first, with no part above `most` times the mean or below its mirror image.

    Moves go to parts of higher number in one round and of lower number in the next, so that two neighbours don't change
    places; a round that would cut more edges (neighbours moving at once) is taken back, and the rounds end.
    """
    both, _ = bucketed(graph.both_ways(edges).filter("a <> b").distinct(), "b")
    now = best = cut(owners.select("key", "owner"))
    fewest, idle = None, 0
    for k in range(rounds + 1):
        o = now.select(F.col("key").alias("b"), F.col("owner").alias("part"))
        near = cut(both.join(o, "b").groupBy(F.col("a").alias("key"), "part").agg(F.count(F.lit(1)).alias("n")).join(now, "key"))
        crossing = near.filter("part <> owner").agg(F.sum("n")).first()[0] or 0
        if fewest is not None and crossing > fewest:
            break
        best, fewest = now, crossing
        if idle == 2 or k == rounds:
            break
        own = near.filter("part = owner").select("key", F.col("n").alias("held"))
        gains = near.filter("part > owner" if k % 2 == 0 else "part < owner").join(own, "key", "left").withColumn("gain", F.col("n") - F.coalesce("held", F.lit(0))).filter("gain > 0")
        wish = gains.groupBy("key", "owner").agg(F.max_by(F.struct("part", "gain"), F.struct("gain", -F.col("part"))).alias("to")).select("key", "owner", "to.*")
        sizes = now.groupBy("owner").agg(F.count(F.lit(1)).alias("size"))
        mean = now.count() / max(1, sizes.count())
        room, spare = (sizes.select(F.col("owner").alias("part"), F.floor(most * mean - F.col("size")).alias("room")), sizes.select("owner", F.floor(F.col("size") - (2 - most) * mean).alias("spare")))
        out, into = Window.partitionBy("owner").orderBy(F.desc("gain"), "key"), Window.partitionBy("part").orderBy(F.desc("gain"), "key")
        ranked = wish.join(room, "part").join(spare, "owner").withColumn("_o", F.row_number().over(out)).filter("_o <= spare").withColumn("_i", F.row_number().over(into)).filter("_i <= room")
        moved = cut(ranked.select("key", "part"))
        idle = idle + 1 if moved.isEmpty() else 0
        now = cut(now.join(moved, "key", "left").select("key", F.coalesce("part", "owner").alias("owner")))
    return best
