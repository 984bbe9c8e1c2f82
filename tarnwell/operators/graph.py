"""Facts merged by id, typed edges between known nodes, neighbours, and closures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import stored

CONFIDENCE = ("low", "medium", "high")


def confidence_rank(value: Column) -> Column:
    return F.coalesce(*[F.when(value == c, F.lit(i)) for i, c in enumerate(CONFIDENCE)], F.lit(-1))


def merge_facts(facts: DataFrame, key: str, evidence: Column, confidence: Column) -> tuple[DataFrame, DataFrame]:
    """Facts merged by id: one row per id with its evidence count, first evidence and highest confidence; and one row per id and evidence.

    Evidence stays rows, not an array, so that a fact that a third of all rows support is no single value.
    """
    rows = facts.select(F.col(key).alias("id"), evidence.alias("evidence"), confidence_rank(confidence).alias("rank"))
    proofs = rows.groupBy("id", "evidence").agg(F.max("rank").alias("rank"))
    named = F.get(F.array(*map(F.lit, CONFIDENCE)), F.max("rank"))
    merged = proofs.groupBy("id").agg(F.count("*").alias("n_evidence"), F.min("evidence").alias("first_evidence"), named.alias("confidence"))
    return merged, proofs.select("id", "evidence")


EDGE = ("family", "type", "src", "dst")


def edges(parts: Sequence[DataFrame], nodes: DataFrame, dropped: Observation | None = None) -> DataFrame:
    """Union of edges (family, type, src, dst) whose ends are both nodes (id), each once with the number of times it was seen.

    ``dropped`` observes, in the pass that makes the edges, how many rows were seen and how many went for want of their source, their target or both: seen, no_src, no_dst, no_ends.
    """
    rows = reduce(DataFrame.unionByName, [p.select(*EDGE) for p in parts]).groupBy(*EDGE).agg(F.count("*").alias("seen"))
    return _between(rows, nodes, F.col("seen"), dropped)


def _between(rows: DataFrame, nodes: DataFrame, weight: Column, dropped: Observation | None) -> DataFrame:
    ids = nodes.select("id").distinct()
    for end in ("src", "dst"):
        rows = rows.join(ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    src, dst = F.col("_src").isNull(), F.col("_dst").isNull()
    if dropped is not None:
        of = lambda kept, name: F.sum(F.when(kept, weight).otherwise(0)).alias(name)
        rows = rows.observe(dropped, of(F.lit(True), "seen"), of(src & ~dst, "no_src"), of(~src & dst, "no_dst"), of(src & dst, "no_ends"))
    return rows.where(~src & ~dst).drop("_src", "_dst")


def evidenced_edges(parts: Sequence[DataFrame], nodes: DataFrame, dropped: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (family, type, src, dst, attrs: an array of structs of key and value) of parts that also have evidence (an array of strings), and their evidence as rows (the same columns and evidence), each once.

    Equal edges are one, whatever their evidence. ``dropped`` as for :func:`edges`, counted in rows of the parts.
    """
    rows = reduce(DataFrame.unionByName, [p.select(*EDGE, "attrs", "evidence") for p in parts])
    kept = _between(rows, nodes, F.lit(1), dropped)
    proofs = kept.select(*EDGE, "attrs", F.explode_outer("evidence").alias("evidence")).groupBy(*EDGE, "attrs", "evidence").agg(F.lit(True).alias("_"))
    return proofs.select(*EDGE, "attrs").distinct(), proofs.where(F.col("evidence").isNotNull()).drop("_")


def observed_reasons(events: DataFrame, reason: str, reasons: Sequence[str], counts: Observation) -> DataFrame:
    """``events`` unchanged; while anything reads them, ``counts`` gathers how often each of the reasons came up, and all others as other."""
    known = F.col(reason).isin(*reasons)
    return events.observe(counts, *[F.count_if(F.col(reason) == r).alias(r) for r in reasons], F.count_if(~F.coalesce(known, F.lit(False))).alias("other"))


def neighbours(edges_: DataFrame, *, family: str | None = None, type_: str | None = None, direction: str = "out") -> DataFrame:
    """Distinct (node, neighbour) pairs along, against or in both directions of the edges of a family and type."""
    kept = edges_.where((F.lit(family is None) | (F.col("family") == family)) & (F.lit(type_ is None) | (F.col("type") == type_)))
    out = kept.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"))
    back = kept.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def unbound(nodes: DataFrame, bound: DataFrame, key: str) -> DataFrame:
    """Nodes that nothing binds."""
    return nodes.join(bound.select(key).distinct(), key, "left_anti")


def reached(seeds: DataFrame, edges_: DataFrame, most: int | None = None) -> DataFrame:
    """Nodes (node, hops) reached from ``seeds`` (node) along ``edges_`` (src, dst), seeds included, cycles allowed.

    Each round joins only the last frontier, removes what is known, and is stored; the loop ends with an empty frontier. Joins sort: a stored table of few columns is many times its files' size in a
    broadcast, and that of every round would go through the driver.
    """
    frontier = stored(seeds.select("node").distinct().withColumn("hops", F.lit(0)), "frontier")
    seen, hop = frontier, 0
    while frontier.take(1) and (most is None or hop < most):
        hop += 1
        after = frontier.join(edges_.hint("merge"), frontier["node"] == edges_["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = stored(after.join(seen.select("node").hint("merge"), "node", "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def closure(edges_: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (root, node) with node reachable from root, itself included. The output is as large as the closure; meant for shallow graphs."""
    frontier = stored(roots.select("root", F.col("root").alias("node")).distinct(), "closure")
    seen = frontier
    while frontier.take(1):
        after = frontier.join(edges_, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = stored(after.join(seen, ["root", "node"], "left_anti"), "closure")
        seen = seen.unionByName(frontier)
    return seen


def strong_components(edges_: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the strongly connected components of ``edges_`` (src, dst) and ``nodes`` (node), each named by its greatest node.

    Rounds of trimming and colouring: nodes without a way in or out are components by themselves; in what is left the greatest node that reaches a node is its colour, and those that reach
    a colour's own node against the edges, within the colour, are its component. No component and no pair of its nodes is ever gathered.
    """
    ways = stored(edges_.select("src", "dst").where("src <> dst").distinct(), "ways")
    every = ways.select(F.col("src").alias("node")).unionByName(ways.select(F.col("dst").alias("node")))
    left = stored((every if nodes is None else every.unionByName(nodes.select("node"))).distinct(), "left")
    done = []
    while left.take(1):
        both = ways.select(F.col("src").alias("node")).distinct().join(ways.select(F.col("dst").alias("node")).distinct().hint("merge"), "node")
        inner = stored(both, "inner")
        done.append(stored(left.join(inner.hint("merge"), "node", "left_anti").select("node", F.col("node").alias("component")), "components"))
        trimmed = left.count() > (n := inner.count())
        left = inner
        ways = stored(_within(ways, left), "ways")
        if not n:
            break
        if trimmed:
            continue
        colour = left.select("node", F.col("node").alias("colour"))
        while True:  # the greatest colour spreads along the edges
            spread = ways.join(colour.hint("merge"), F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("_more"))
            after = stored(colour.join(spread.hint("merge"), "node", "left").select("node", F.greatest("colour", "_more").alias("colour"), (F.col("_more") > F.col("colour")).alias("_new")), "colour")
            colour = after.select("node", "colour")
            if not after.where("_new").take(1):
                break
        inside = ways.join(colour.withColumnsRenamed({"node": "src", "colour": "_a"}).hint("merge"), "src").join(colour.withColumnsRenamed({"node": "dst", "colour": "_b"}).hint("merge"), "dst").where("_a = _b").select("src", "dst")
        own = reached(colour.where("node = colour").select("node"), inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = stored(own.select("node").join(colour.hint("merge"), "node").select("node", F.col("colour").alias("component")), "components")
        done.append(found)
        left = stored(left.join(found.hint("merge"), "node", "left_anti"), "left")
        ways = stored(_within(ways, left), "ways")
    return reduce(DataFrame.unionByName, done) if done else left.select("node", F.col("node").alias("component"))


def _within(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    return ways.join(nodes.withColumnRenamed("node", "src").hint("merge"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst").hint("merge"), "dst", "left_semi")


def reached_items(edges_: DataFrame, items: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What roots (root) reach over ``edges_`` (src, dst), themselves included, of ``items`` (node, item): sets (root, word, bits) and the items' places (item, word, bit).

    A set is rows of 64 items each, bit ``bit`` of row ``word``. Cycles are one node each: sets belong to the strongly connected components, follow the condensed graph from its ends upwards, by
    bitwise or, and are joined to the roots last, so neither pairs of nodes nor pairs of node and item are made on the way.
    """
    nodes = roots.select(F.col("root").alias("node")).unionByName(items.select("node"))
    part = stored(strong_components(edges_, nodes), "strong")
    of = lambda end: part.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")).hint("merge")
    up = stored(edges_.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst").where("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct(), "condensed")
    at = F.monotonically_increasing_id()
    places = stored(items.select("item").distinct().select("item", at.alias("_at")).select("item", F.shiftright("_at", 6).alias("word"), F.col("_at").bitwiseAND(F.lit(63)).cast("int").alias("bit")), "places")
    own = items.join(places, "item").join(part.hint("merge"), "node").groupBy(F.col("component").alias("node"), "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    waiting, sets = stored(part.select(F.col("component").alias("node")).distinct(), "waiting"), []
    own = stored(own, "sets")
    while waiting.take(1):
        # Nodes all of whose ways lead to settled ones are next.
        held = up.join(waiting.withColumnRenamed("node", "dst").hint("merge"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        ready = stored(waiting.join(held.hint("merge"), "node", "left_anti"), "ready")
        below = [up.join(ready.withColumnRenamed("node", "src").hint("merge"), "src", "left_semi").join(s.withColumnRenamed("node", "dst").hint("merge"), "dst").select(F.col("src").alias("node"), "word", "bits") for s in sets]
        mine = own.join(ready.hint("merge"), "node", "left_semi").select("node", "word", "bits")
        sets.append(stored(reduce(DataFrame.unionByName, below, mine).groupBy("node", "word").agg(F.expr("bit_or(bits)").alias("bits")), "sets"))
        if len(sets) > 8:
            sets = [stored(reduce(DataFrame.unionByName, sets), "sets")]
        waiting = stored(waiting.join(ready.hint("merge"), "node", "left_anti"), "waiting")
    every = reduce(DataFrame.unionByName, sets) if sets else own
    found = roots.select("root").distinct().join(part.withColumnRenamed("node", "root").hint("merge"), "root").join(every.withColumnRenamed("node", "component").hint("merge"), "component").select("root", "word", "bits")
    return found, places


def item_counts(sets: DataFrame) -> DataFrame:
    """(root, n): how many items each root's set has; roots without any are left out."""
    return sets.groupBy("root").agg(F.sum(F.bit_count("bits")).cast("long").alias("n"))


def listed_items(sets: DataFrame, places: DataFrame) -> DataFrame:
    """(root, item): sets written out."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", F.col("bits"), b) == 1)
    return sets.select("root", "word", F.explode(bits).alias("bit")).join(places, ["word", "bit"]).select("root", "item")


def liveness(nodes: DataFrame, entrypoints: DataFrame, edges_: DataFrame) -> DataFrame:
    """``nodes`` (node) with liveness: invoked, reachable or defined."""
    live = reached(entrypoints, edges_)
    return nodes.join(live, "node", "left").select("node", F.when(F.col("hops") == 0, "invoked").when(F.col("hops") > 0, "reachable").otherwise("defined").alias("liveness"))


def affected(changed: DataFrame, edges_: DataFrame) -> DataFrame:
    """Modules that depend on a changed one, at any distance, with the changed ones."""
    return reached(changed, edges_.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("node")


def roles(agents: DataFrame, edges_: DataFrame) -> DataFrame:
    """``agents`` (node) with role: supervisor (hands off), else router (routes), else worker (is handed to), else solo."""
    out = edges_.groupBy(F.col("src").alias("node")).agg(F.bool_or(F.col("type") == "handoff").alias("_hands"), F.bool_or(F.col("type") == "route").alias("_routes"))
    into = edges_.where(F.col("type") == "handoff").select(F.col("dst").alias("node"), F.lit(True).alias("_target")).distinct()
    found = agents.join(out, "node", "left").join(into, "node", "left")
    return found.select("node", F.when(F.col("_hands"), "supervisor").when(F.col("_routes"), "router").when(F.col("_target"), "worker").otherwise("solo").alias("role"))


def merged_sets(facts: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(id, field, value): the distinct values that the duplicates of a fact bring, of single-valued and of array columns. Values stay rows."""
    rows = [facts.select(F.col(key).alias("id"), F.lit(c).alias("field"), (F.explode(c) if facts.schema[c].dataType.typeName() == "array" else F.col(c)).alias("value")).withColumn("value", F.col("value").cast("string")) for c in columns]
    return reduce(DataFrame.unionByName, rows).where(F.col("value").isNotNull()).distinct()
