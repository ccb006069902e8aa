"""Graphs as edge tables: accumulation, collapse, PageRank, reachability, transparent callers, bounded propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.functions.scalars import damped
from changeloom.operators.labels import packed, reached_by
from changeloom.session import cut


def accumulate_edges(refs: DataFrame, src: str = "src", dst: str = "dst", kind: str | None = None, order: str | None = None) -> DataFrame:
    """References counted into edges (src, dst, n, kind of the first): none of a node to itself."""
    first = F.min_by(kind, order) if kind and order else F.lit("")
    return refs.filter(F.col(src) != F.col(dst)).groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count("*").alias("n"), first.alias("kind"))


def weigh(edges: DataFrame) -> DataFrame:
    return edges.withColumn("w", damped(F.col("n")))


def collapse(edges: DataFrame, groups: DataFrame, node: str = "node", group: str = "grp") -> DataFrame:
    """Edges (src, dst, w) between groups of nodes: sums of weights, damped; none within a group or without one."""
    of = lambda end: groups.select(F.col(node).alias(end), F.col(group).alias(f"_{end}"))
    met = edges.join(of("src"), "src").join(of("dst"), "dst").filter("_src <> _dst")
    return met.groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(damped(F.sum("w")).alias("w"))


def resolve_edges(edges: DataFrame, nodes: DataFrame, stubs: DataFrame | None = None, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Edges whose source is a node and whose target is a node or stub, and those that leave the graph."""
    ids = nodes.select(F.col(key).alias("_id"))
    known = edges.join(ids, edges["src"] == ids["_id"], "left_semi")
    ends = ids if stubs is None else ids.unionByName(stubs.select(F.col(key).alias("_id"))).distinct()
    return known.join(ends, known["dst"] == ends["_id"], "left_semi"), known.join(ends, known["dst"] == ends["_id"], "left_anti")


def teleport(nodes: DataFrame, id_: str = "id", share: str = "share") -> DataFrame:
    """(id, tele): virtual nodes have a share; real ones (null share) part what is left evenly, at least a tenth."""
    sums = nodes.agg(F.least(F.lit(0.9), F.coalesce(F.sum(share), F.lit(0.0))).alias("_vs"), F.sum(F.col(share).isNull().cast("int")).alias("_real"))
    return nodes.crossJoin(F.broadcast(sums)).select(F.col(id_).alias("id"), F.coalesce(F.col(share), (1 - F.col("_vs")) / F.col("_real")).alias("tele"))


def shares(edges: DataFrame) -> DataFrame:
    """edges(src, dst, w) with p, the edge's share of its source's weight."""
    out = edges.groupBy("src").agg(F.sum("w").alias("_out"))
    return edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("_out")).alias("p"))


def pagerank(nodes: DataFrame, edges: DataFrame, d: float = 0.85, rounds: int = 200, tol: float = 1e-10, fixed: int | None = None) -> DataFrame:
    """(id, pr) of nodes(id, share?) and edges(src, dst, w): weighted, personalised, ranks of nodes without edges spread.

    Nodes that nothing leads to all have the same multiple of their teleport in a round, so their edges are summed once, and a round
    joins only edges between others: it is one join, if there are such edges, one sum and one write of the ranks of nodes that
    something leads to. Two numbers come to the driver: what is lost in nodes without edges, and how far the ranks have moved. It
    stops below tol, or after ``fixed`` rounds.
    """
    tele = teleport(nodes if "share" in nodes.columns else nodes.withColumn("share", F.lit(None).cast("double")))
    flow = cut(shares(edges))
    led = flow.groupBy(F.col("dst").alias("id")).agg(F.lit(True).alias("led"))
    sources = flow.select(F.col("src").alias("id")).distinct().withColumn("_flows", F.lit(True))
    known = cut(tele.join(sources, "id", "left").join(led, "id", "left").select("id", "tele", F.coalesce("_flows", F.lit(False)).alias("flows"), F.coalesce("led", F.lit(False)).alias("led")))
    base = flow.join(known.filter("flows AND NOT led").select(F.col("id").alias("src"), "tele"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("tele") * F.col("p")).alias("base"))
    between = known.filter("flows AND led").select(F.col("id").alias("src"))
    none = between.isEmpty()
    inner = None if none else cut(flow.join(between, "src", "left_semi").select("src", "dst", "p"))
    free, gone = known.filter("NOT led").agg(F.coalesce(F.sum("tele"), F.lit(0.0)), F.coalesce(F.sum(F.when(~F.col("flows"), F.col("tele"))), F.lit(0.0))).first()
    state = known.filter("led").join(base, "id", "left").select("id", "tele", "flows", F.coalesce("base", F.lit(0.0)).alias("base"), F.col("tele").alias("pr"), F.lit(1.0).alias("last"))
    times, before = 1.0, None  # the multiple of those that nothing leads to, in this round and the last
    for i in range(fixed or rounds):
        state = cut(state)
        lost, moved = state.agg(F.coalesce(F.sum(F.when(~F.col("flows"), F.col("pr"))), F.lit(0.0)), F.coalesce(F.sum(F.abs(F.col("pr") - F.col("last"))), F.lit(0.0))).first()
        lost, moved = lost + times * gone, moved + (0.0 if before is None else abs(times - before) * free)
        if fixed is None and i and moved < tol:
            break
        got = state if none else state.join(state.join(inner, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("pr") * F.col("p")).alias("_in")), F.col("id") == F.col("dst"), "left")
        into = times * F.col("base") + (F.lit(0.0) if none else F.coalesce("_in", F.lit(0.0)))
        next_ = (1 - d) * F.col("tele") + d * float(lost) * F.col("tele") + d * into
        state = got.select("id", "tele", "flows", "base", next_.alias("pr"), F.col("pr").alias("last"))
        times, before = (1 - d) + d * float(lost), times
    return known.filter("NOT led").select("id", (F.lit(float(times)) * F.col("tele")).alias("pr")).unionByName(state.select("id", "pr"))


def reach(starts: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """(sid, node, hop): all nodes that lead to a start's node along edges, with the fewest hops; starts(sid, node).

    Semi-naive: a round joins only what the last one found, for all starts at once.
    """
    back = cut(edges.select(F.col("dst").alias("node"), F.col("src").alias("_next")).distinct())
    edge = seen = cut(starts.select("sid", "node").distinct().withColumn("hop", F.lit(0)))
    hop = 0
    while hops is None or hop < hops:
        hop += 1
        found = cut(edge.join(back, "node").select("sid", F.col("_next").alias("node")).distinct().join(seen.select("sid", "node"), ["sid", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if hops is None and found.isEmpty():
            break
        edge, seen = found, seen.unionByName(found)
        if hops is None:
            seen = cut(seen)
    return seen


def dependents(starts: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int | None = None) -> DataFrame:
    """(sid, syms, files, repos): what depends on a start; nodes(node, file, repo, internal?). Starts count only by others."""
    met = nodes.filter("NOT coalesce(internal, false)") if "internal" in nodes.columns else nodes
    tallies = reached_by(packed(edges), starts.select("sid", "node"), met.select("node", "file", "repo"), hops)
    repos = F.array_sort(F.collect_set(F.when(F.col("of") == "repo", F.col("value"))).cast(f"array<{nodes.schema['repo'].dataType.simpleString()}>"))
    return tallies.groupBy("sid").agg(F.sum(F.when(F.col("of") == "", F.col("n"))).alias("syms"), F.count_if(F.col("of") == "file").alias("files"), repos.alias("repos"))


def dependent_counts(edges: DataFrame, nodes: DataFrame, words: int = 1024) -> DataFrame:
    """(node, syms, files, repos): how many nodes, files and repos lead to each of nodes(node, file, repo), by any number of hops.

    A task holds the edges of one block and 4096 x ``words`` starts that their targets lead to at a time. A node on a cycle isn't its
    own dependent.
    """
    blocks = packed(edges)
    tallies = reached_by(blocks, values=nodes.select("node", "file", "repo"), words=words)
    of = lambda name: F.col("of") == name
    counts = tallies.groupBy(F.col("sid").alias("node")).agg(F.sum(F.when(of(""), F.col("n"))).alias("syms"), F.count_if(of("file")).alias("files"), F.count_if(of("repo")).alias("repos"))
    starts = blocks.select(F.explode("dsts").alias("node")).distinct().join(nodes.select("node").distinct(), "node", "left_semi")
    return starts.join(counts, "node", "left").select("node", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("syms", "files", "repos")])


def direct_callers(edges: DataFrame, transparent: DataFrame) -> DataFrame:
    """(node, caller): who calls a node, seen through transparent nodes(node), which stand for their own callers, in
    chains of any length: a round sees one further, and ends when no pair is new. A node on a cycle isn't its own caller."""
    clear = transparent.select("node").distinct()
    edge = edges.select(F.col("dst").alias("node"), F.col("src").alias("caller")).distinct()
    real, through = edge.join(clear.withColumnRenamed("node", "caller"), "caller", "left_anti"), edge.join(clear.withColumnRenamed("node", "caller"), "caller", "left_semi")
    seen = through
    while True:
        next_ = through.select("node", F.col("caller").alias("_via")).join(edge.select(F.col("node").alias("_via"), "caller"), "_via").select("node", "caller").distinct()
        real = cut(real.unionByName(next_.join(clear.withColumnRenamed("node", "caller"), "caller", "left_anti")).distinct())
        through = cut(next_.join(clear.withColumnRenamed("node", "caller"), "caller", "left_semi").join(seen, ["node", "caller"], "left_anti"))
        if through.isEmpty():
            break
        seen = cut(seen.unionByName(through))
    return real.select("node", "caller").filter("node <> caller").distinct()


def caller_counts(edges: DataFrame, transparent: DataFrame) -> DataFrame:
    """(node, callers): how many pairs ``direct_callers`` has of each node, without making them."""
    return reached_by(packed(edges), clear=transparent.select("node")).select(F.col("sid").alias("node"), F.col("n").alias("callers"))


def propagate(seeds: DataFrame, edges: DataFrame, hops: int, decay: float, silent: DataFrame | None = None) -> DataFrame:
    """(node, tag, score, hop): tags of seeds(node, tag, score) carried to those that lead to them, at most so many hops;
    the fewest hops count, and a score falls to score * (1 - decay * hop), rounded. silent(node): nodes that pass tags on but
    get none themselves. A round goes on from what no round before has reached."""
    back = cut(edges.select(F.col("dst").alias("node"), F.col("src").alias("_next")).distinct())
    level = seeds.select("node", "tag", F.col("score").alias("_first"), F.lit(0).alias("hop"))
    every = level
    for hop in range(1, hops + 1):
        level = level.join(back, "node").select(F.col("_next").alias("node"), "tag", "_first", F.lit(hop).alias("hop"))
        level = cut(level.groupBy("node", "tag", "hop").agg(F.max("_first").alias("_first")).join(every.select("node", "tag").distinct(), ["node", "tag"], "left_anti").select("node", "tag", "_first", "hop"))
        every = every.unionByName(level)
    if silent is not None:
        every = every.join(silent.select("node").distinct(), "node", "left_anti")
    best = every.groupBy("node", "tag").agg(F.min(F.struct("hop", (-F.col("_first")).alias("_minus"))).alias("_b"))
    score = F.floor(-F.col("_b._minus") * (1 - F.lit(decay) * F.col("_b.hop")) + 0.5).cast("int")
    return best.select("node", "tag", score.alias("score"), F.col("_b.hop").alias("hop"))
