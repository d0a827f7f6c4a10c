"""Graph operators over nodes(id, name, type, ...) and edges(type, source, target)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.sources.shared import discard, materialize

#: A frontier of up to this many ids is broadcast; larger ones are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Bits of a bitmap of ids at most; it is broadcast as a row for each 64.
BITMAP_BITS = 1 << 25


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Each (type, source, target) once, with the least ``ord``."""
    return edges.groupBy("type", "source", "target").agg(F.min("ord").alias("ord"))


def type_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def filled(column: str):
    """How many rows have a value that counts as true."""
    c = F.col(column)
    return F.count_if(c.isNotNull() & (c.cast("string") != ""))


def statistics(nodes: DataFrame, edges: DataFrame, contexts: Sequence[str] = ("full_context", "summary", "embedding", "llm_description")) -> DataFrame:
    """(key, value): node types, totals, counts of filled context columns, edge types, in one flat table."""
    totals = nodes.agg(F.count(F.lit(1)).alias("total_elements"), *(filled(c).alias(f"with_{c}") for c in contexts if c in nodes.columns))
    flat = totals.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, totals.columns)), F.array(*totals.columns))).alias("key", "value"))
    kinds = lambda df: type_counts(df).select(F.col("type").alias("key"), F.col("n").alias("value"))
    return kinds(nodes).unionByName(flat).unionByName(edges.agg(F.count(F.lit(1)).alias("value")).select(F.lit("total_relationships").alias("key"), "value")).unionByName(kinds(edges))


def small(ids: DataFrame) -> DataFrame:
    """``ids``, broadcast if they are few."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def n_hop(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """(id, hop) of the nodes within ``hops`` undirected steps of the seeds that exist, and the distinct edges with an end within
    ``hops - 1`` steps. Each step's frontier is written to shared storage; edges are joined once by source and once by target."""
    seen = materialize(seeds.select("id").distinct().withColumn("hop", F.lit(0)), "hop")
    frontier, touched = seen.select("id"), None
    for hop in range(1, hops + 1):
        at = small(frontier)
        out = edges.join(at.withColumnRenamed("id", "source"), "source", "left_semi").select("type", "source", "target")
        back = edges.join(at.withColumnRenamed("id", "target"), "target", "left_semi").select("type", "source", "target")
        step = materialize(out.unionByName(back).distinct(), "hop-edges")
        touched = step if touched is None else touched.unionByName(step)
        ends = step.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        new = materialize(ends.join(small(seen.select("id")), "id", "left_anti").withColumn("hop", F.lit(hop)), "hop")
        seen, frontier = seen.unionByName(new), new.select("id")
    if touched is None:
        touched = edges.select("type", "source", "target").limit(0)
    return seen.join(nodes.select("id"), "id", "left_semi"), touched.distinct()


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with both ends among ``ids``."""
    ends = ids.select("id")
    return edges.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi")


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id with ``incoming`` and ``outgoing`` arrays of (type, id), sorted; empty arrays without edges."""
    def side(key: str, other: str, name: str) -> DataFrame:
        return edges.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct("type", F.col(other).alias("id")))).alias(name))

    empty = F.array().cast("array<struct<type:string,id:string>>")
    joined = nodes.select("id").join(side("target", "source", "incoming"), "id", "left").join(side("source", "target", "outgoing"), "id", "left")
    return joined.select("id", F.coalesce("incoming", empty).alias("incoming"), F.coalesce("outgoing", empty).alias("outgoing"))


def neighbour_counts(nodes: DataFrame, edges: DataFrame, least_of: str) -> DataFrame:
    """(id, n_in, n_out, first_in, first_of): how many edges come in and go out, the least source, and the least target over
    edges of type ``least_of``. Sums and minima are taken before the shuffle, so hubs make no long rows."""
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n_in"), F.min("source").alias("first_in"))
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n_out"), F.min(F.when(F.col("type") == least_of, F.col("target"))).alias("first_of"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select("id").join(into, "id", "left").join(out, "id", "left").select("id", n("n_in"), n("n_out"), "first_in", "first_of")


def related_rows(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """(owner, pos, id, name, type, summary) of ``lists`` (owner, pos, id), a row for each element: no owner's list is gathered."""
    named = nodes.select("id", "name", "type", F.coalesce(F.nullif("summary", F.lit("")), F.concat_ws(": ", "type", "name")).alias("summary"))
    return lists.join(named, "id").select("owner", "pos", "id", "name", "type", "summary")


def related(nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """For ``lists`` (id, related_elements): the elements as (id, name, type, summary) in order, missing ones left out, the
    summary falling back to ``type: name``."""
    parts = lists.select(F.col("id").alias("owner"), F.posexplode("related_elements").alias("pos", "id"))
    named = parts.join(nodes.select("id", "name", "type", F.coalesce(F.nullif("summary", F.lit("")), F.concat_ws(": ", "type", "name")).alias("summary")), "id")
    grouped = named.groupBy(F.col("owner").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "name", "type", "summary"))).alias("x"))
    return lists.select("id").join(grouped, "id", "left").select(
        "id", F.coalesce(F.transform("x", lambda e: F.struct(e["id"].alias("id"), e["name"].alias("name"), e["type"].alias("type"), e["summary"].alias("summary"))),
                         F.array().cast("array<struct<id:string,name:string,type:string,summary:string>>")).alias("related_elements"))


def element_view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A node with its related elements and its incoming and outgoing edges."""
    return nodes.drop("related_elements").join(related(nodes, nodes.select("id", "related_elements")), "id").join(neighbours(nodes, edges), "id")


def _steps(edges: DataFrame, mark: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """(u, v) of each edge from either end, if ``mark`` holds it true; one that leads back to its own node once. ``mark`` adds to edges, for an end, a flag."""
    marked = mark(mark(edges.select("source", "target"), "source", "out"), "target", "back").where("out or back")
    way = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    back = F.col("back") & ~F.col("source").eqNullSafe(F.col("target"))
    ways = marked.select(F.explode(F.array(F.when(F.col("out"), way("source", "target")), F.when(back, way("target", "source")))).alias("way"))
    return ways.where("way is not null").select("way.u", "way.v")


def _perhaps_among(ids: DataFrame, n: int) -> Callable[[DataFrame, str, str], DataFrame]:
    """Adds a flag that is true for all of the ``n`` ``ids`` (id) and for few other values, so that few rows need dealing before they are joined with ids:
    hashes are held against a broadcast bitmap, of 16 bits an id and ``BITMAP_BITS`` at most, in words of 64."""
    bits = min(BITMAP_BITS, 1 << max(10, (16 * n).bit_length()))
    word = F.shiftright(F.pmod("hash", F.lit(bits).cast("long")), 6)
    bit = F.expr("shiftleft(1L, cast(pmod(hash, 64L) as int))")
    words = F.broadcast(ids.select(F.xxhash64("id").alias("hash")).select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("held")))

    def mark(df: DataFrame, end: str, flag: str) -> DataFrame:
        met = df.withColumn("hash", F.xxhash64(end)).join(words, (word == F.col("word")) & (F.col("held").bitwiseAND(bit) != 0), "left")
        return met.select(*df.columns, (F.col("word").isNotNull() & F.col(end).isNotNull()).alias(flag))

    return mark


def _numbered(starts: DataFrame) -> DataFrame:
    """(start, no, rows) of each of the ``starts`` (id): a number of its own, and how many rows it has."""
    own = starts.where("id is not null").groupBy(F.col("id").alias("start")).agg(F.count(F.lit(1)).alias("rows"))
    return materialize(own.withColumn("no", F.monotonically_increasing_id()), "starts")


def _path_copies(starts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(start, no, end, copies), and a written table that this reads: from each of the ``starts`` (start, no), how many undirected paths of one or two
    different edges lead to an end; several rows may name the same two.

    Edges at a start are counted by their other end. A second step over an edge at this end can follow each of the ``m`` first ones, less itself
    if it leads back to the start, so edges need no number of their own. Only edges at these ends are dealt out."""
    at = small(starts.select("start", "no"))
    ones = _steps(edges, lambda df, end, flag: df.join(at.select(F.col("start").alias(end), F.lit(True).alias(flag)), end, "left"))
    near = materialize(ones.groupBy("u", "v").agg(F.count(F.lit(1)).alias("m")).join(at.withColumnRenamed("start", "u"), "u").select(F.col("u").alias("start"), "no", "v", "m"), "near")
    ends = near.where("v is not null").withColumnRenamed("v", "u")
    met = _steps(edges, _perhaps_among(ends.select(F.col("u").alias("id")), ends.count())).join(small(ends), "u")
    two = met.select("start", "no", F.col("v").alias("end"), (F.col("m") - F.col("v").eqNullSafe(F.col("start")).cast("long")).alias("copies"))
    return near.select("start", "no", F.col("v").alias("end"), F.col("m").alias("copies")).unionByName(two).where("copies > 0"), near


def paths_up_to_two(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, end) over undirected paths of one or two different edges, from each row of ``starts``; each row of ``edges`` is an edge."""
    own = _numbered(starts)
    one_by_one = _path_copies(own, edges)[0].select("start", "end", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return one_by_one.join(small(own.select("start", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("row"))), "start").select("start", "end")


def path_counts(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, n_paths, n_ends) of :func:`paths_up_to_two`, without a row for each path: an end has a row for each 64 starts, with those that reach it as bits."""
    own = _numbered(starts)
    found, near = _path_copies(own, edges)
    paths = found.select("no", "end", "copies", F.shiftright("no", 6).alias("block"), F.expr("shiftleft(1L, cast(no & 63 as int))").alias("bit"))
    both = paths.groupingSets([["end", "block"], ["no"]], "end", "block", "no").agg(
        F.grouping("no").alias("of_end"), F.bit_or("bit").alias("bits"), F.sum("copies").alias("n"))
    both = materialize(both.where("of_end = 0 or end is not null").groupBy("of_end", "no", "block", F.when(F.col("of_end") == 1, F.col("bits")).alias("bits")).agg(F.sum("n").alias("n"), F.count("end").alias("ends")), "paths")
    discard(near)
    number = F.explode(F.sequence(F.lit(0), F.lit(63)))
    reached = both.where("of_end = 1").select("block", "bits", "ends", number.alias("i")).where("shiftright(bits, i) & 1 = 1")
    n_ends = reached.groupBy((F.shiftleft("block", 6) + F.col("i")).alias("no")).agg(F.sum("ends").alias("n_ends"))
    counted = both.where("of_end = 0").select("no", "n").join(n_ends, "no", "left").join(own, "no")
    return counted.select("start", (F.col("n") * F.col("rows")).alias("n_paths"), F.coalesce("n_ends", F.lit(0)).cast("long").alias("n_ends"))


def outside_domain(edges: DataFrame, nodes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges whose (type, source type, target type) isn't among ``allowed``."""
    kind = nodes.select("id", F.col("type").alias("kind"))
    typed = edges.join(kind.select(F.col("id").alias("source"), F.col("kind").alias("source_type")), "source", "left").join(
        kind.select(F.col("id").alias("target"), F.col("kind").alias("target_type")), "target", "left")
    return typed.join(F.broadcast(allowed), ["type", "source_type", "target_type"], "left_anti")


def outside_domain_counts(edges: DataFrame, nodes: DataFrame, allowed: DataFrame) -> DataFrame:
    """(type, source_type, n) of :func:`outside_domain`. ``nodes`` have each id once. Only edges of types that ``allowed`` names are dealt by target, to
    nodes of the types that it allows there; then edges are counted by source before they are dealt to those."""
    kind = nodes.select("id", F.col("type").alias("kind"))
    named = F.broadcast(allowed.select("type").distinct())
    ends = kind.join(F.broadcast(allowed.select(F.col("target_type").alias("kind")).distinct()), "kind", "left_semi")
    free = edges.join(named, "type", "left_anti").select("type", "source", F.lit(None).cast("string").alias("target_type"))
    bound = edges.join(named, "type", "left_semi").join(ends.select(F.col("id").alias("target"), F.col("kind").alias("target_type")), "target", "left").select("type", "source", "target_type")
    counted = lambda df: df.groupBy("type", "source", "target_type").agg(F.count(F.lit(1)).alias("n"))
    typed = counted(free).unionByName(counted(bound)).join(kind.select(F.col("id").alias("source"), F.col("kind").alias("source_type")), "source", "left")
    outside = typed.join(F.broadcast(allowed), ["type", "source_type", "target_type"], "left_anti")
    return outside.groupBy("type", "source_type").agg(F.sum("n").alias("n"))
