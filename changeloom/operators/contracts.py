"""Contracts: URL literals against operations, generated clients and servers, consumers outside the code, sinks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.patterns import map_glob
from changeloom.functions.scalars import ancestors, normal_operation
from changeloom.operators.joins import best_match
from changeloom.operators.labels import carried, packed


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def url_score(ref: Column, servers: Column, operation: Column) -> Column:
    """How well a literal's segments match an operation's, aligned at their ends; 0 is no match.

    All of the operation's segments must match, at least one of them literally ({...} matches any): 10 a segment, 1 a
    literal one, and 5 for each segment of the first server whose segments stand right before.
    """
    off = F.size(ref) - F.size(operation)
    tail = F.slice(ref, F.greatest(off, F.lit(0)) + 1, F.greatest(F.size(operation), F.lit(1)))
    equal = lambda a, b: (a == b) | b.startswith("{") | a.startswith("{")
    fits = (F.size(operation) > 0) & (off >= 0) & F.forall(F.zip_with(tail, operation, equal), lambda x: F.coalesce(x, F.lit(False)))
    literal = F.size(F.filter(F.zip_with(tail, operation, lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False))))

    def before(server: Column) -> Column:
        s = segments(server)
        n = F.size(s)
        return F.when((n > 0) & (n <= off) & (F.slice(ref, F.greatest(off - n, F.lit(0)) + 1, F.greatest(n, F.lit(1))) == s), 5 * n)

    bonus = F.coalesce(F.try_element_at(F.filter(F.transform(servers, before), lambda x: x.isNotNull()), F.lit(1)), F.lit(0))
    return F.when(fits & (literal > 0), F.size(operation) * 10 + literal + bonus).otherwise(0)


def url_edges(refs: DataFrame, operations: DataFrame) -> DataFrame:
    """Edges of refs(src, service, path) to the operations(service, key, servers, op_path) tied at the best score."""
    left = refs.select("src", "service", "path", segments(F.col("path")).alias("_ref"))
    right = operations.select("service", "key", "servers", segments(F.col("op_path")).alias("_op"))
    best = best_match(left, right, ["service"], url_score(F.col("_ref"), F.col("servers"), F.col("_op")), ["src", "service", "path"])
    return best.select("src", F.col("key").alias("dst"), "score", F.lit("contract").alias("kind")).distinct()


def client_edges(nodes: DataFrame, operations: DataFrame, symbol: str) -> DataFrame:
    """Edges of generated clients: nodes(key, repo, dir, sym) whose symbol names an operation(repo, dir, key, name), by the
    group of an expression and without regard to case and punctuation."""
    named = nodes.withColumn("_op", normal_operation(F.regexp_extract("sym", symbol, 1))).filter("_op <> ''")
    ops = operations.select("repo", "dir", F.col("key").alias("dst"), normal_operation(F.col("name")).alias("_op"))
    return named.join(ops, ["repo", "dir", "_op"]).select(F.col("key").alias("src"), "dst", F.lit("contract").alias("kind"))


def server_edges(nodes: DataFrame, operations: DataFrame, interface: str) -> DataFrame:
    """Edges from operations(repo, dir, key, name) to what serves them: the methods of a generated interface of the
    operation's directory, and for operations without any, methods of that directory with the operation's name.

    nodes(key, repo, dir, sym, kind); ``interface``: an expression whose first group is the operation of such a method.
    """
    ops = operations.select("repo", "dir", F.col("key").alias("src"), normal_operation(F.col("name")).alias("_op"))
    made = nodes.withColumn("_op", normal_operation(F.regexp_extract("sym", interface, 1))).filter("_op <> ''")
    served = made.join(ops, ["repo", "dir", "_op"]).select("src", F.col("key").alias("dst"))
    plain = nodes.filter((F.col("kind") == "method") & F.col("sym").contains(").")).withColumn("_op", normal_operation(F.regexp_extract("sym", r"\)\.(.*)$", 1)))
    rest = plain.join(ops.join(served.select("src").distinct(), "src", "left_anti"), ["repo", "dir", "_op"]).select("src", F.col("key").alias("dst"))
    return served.unionByName(rest).distinct().withColumn("kind", F.lit("contract"))


def configured_clients(nodes: DataFrame, operations: DataFrame, clients: DataFrame) -> DataFrame:
    """Edges of generated clients named in a configuration: nodes(key, repo, dir, sym) in or below the directory of
    clients(repo, client_dir, spec) whose symbol is an operation(spec, key, name): an equi-join on ancestors."""
    spread = nodes.select("key", "repo", normal_operation(F.col("sym")).alias("_op"), F.explode(ancestors(F.col("dir"), itself=True)).alias("client_dir"))
    ops = operations.select("spec", F.col("key").alias("dst"), normal_operation(F.col("name")).alias("_op"))
    found = spread.join(clients, ["repo", "client_dir"]).join(ops, ["spec", "_op"])
    return found.select(F.col("key").alias("src"), "dst", F.lit("contract").alias("kind")).distinct()


def virtual_consumers(operations: DataFrame, consumers: list[dict], path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of consumers outside the code: each (name, weight, specs: globs) depends on the operations(key, path)
    whose specification matches. Consumers are few and become literal patterns."""
    spark = operations.sparkSession
    nodes = spark.createDataFrame([("virtual:" + c["name"], float(c["weight"])) for c in consumers], "key string, share double")
    hits = F.array(*[F.when(F.lit(False) if not c["specs"] else reduce(or_, [F.col(path).rlike(map_glob(g)) for g in c["specs"]]), F.lit("virtual:" + c["name"])) for c in consumers])
    edges = operations.select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("src"), F.col("key").alias("dst"))
    return nodes, edges.withColumns({"n": F.lit(1), "kind": F.lit("contract")})


#: Kinds of nodes that only mention what they name.
MENTIONS = ["type", "iface-method", "const", "api-op"]


def sink_hits(nodes: DataFrame, edges: DataFrame, sinks: list[dict]) -> DataFrame:
    """(node, tag, score): what calls a sink, or is one. nodes(key, kind, category); edges(src, dst), also to code outside.

    A sink has an id, a score, expressions ``callee`` for keys, and perhaps categories, which count for the caller.
    """
    eligible = nodes.filter(~F.col("kind").isin(MENTIONS)).select(F.col("key").alias("node"), "category")
    any_ = reduce(or_, [F.col("dst").rlike(x) for s in sinks for x in s["callee"]], F.lit(False))  # other edges need no join
    keys = eligible.select("node", "category", F.col("node").alias("_callee")).unionByName(edges.filter(any_).select(F.col("src").alias("node"), F.col("dst").alias("_callee")).join(eligible, "node"))
    made = []
    for s in sinks:
        holds = reduce(or_, [F.col("_callee").rlike(x) for x in s["callee"]])
        if s.get("category"):
            holds = holds & F.col("category").isin(s["category"])
        made.append(F.when(holds, F.struct(F.lit(s["id"]).alias("tag"), F.lit(s["score"]).alias("score"))))
    return keys.select("node", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("t")).select("node", "t.*").distinct()


def serve_tags(tags: DataFrame, operations: DataFrame, edges: DataFrame, hops: int = 3, least: int = 40, less: int = 5) -> DataFrame:
    """(node, tag, score): who implements an operation gets its strong tags as serves:<tag>, a little lower.

    tags(node, tag, score); operations(node); edges(src, dst, kind), of which contract and impl edges are followed from
    the operation, at most so many hops.
    """
    strong = tags.join(operations.select("node").distinct(), "node", "left_semi").filter(F.col("score") >= least)
    met = carried(packed(edges.filter(F.col("kind").isin("contract", "impl"))), strong, hops)
    return met.groupBy("node", F.concat(F.lit("serves:"), F.col("tag")).alias("tag")).agg((F.max("score") - less).alias("score"))
