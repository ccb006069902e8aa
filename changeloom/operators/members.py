"""Members of types: overrides, method sets, the declarations that names mean, and which are new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.operators.graph import reach
from changeloom.session import cut


def override_edges(members: DataFrame, supers: DataFrame) -> DataFrame:
    """Edges of kind impl from a member to what overrides it.

    members(type, name, key); supers(type, super): direct ones. For each direct super the nearest type up its line that
    has the member counts, so the line is followed from each super until a type has it.
    """
    lines = reach(supers.select(F.concat_ws("\n", "type", "super").alias("sid"), F.col("super").alias("node")), supers.select(F.col("super").alias("src"), F.col("type").alias("dst")))
    split = lines.select(F.split("sid", "\n")[0].alias("type"), F.col("sid"), F.col("node").alias("_at"), "hop")
    own = members.select("type", "name", F.col("key").alias("dst"))
    above = members.select(F.col("type").alias("_at"), "name", F.col("key").alias("src"))
    met = split.join(own, "type").join(above, ["_at", "name"])
    best = met.groupBy("sid", "name", "dst").agg(F.min_by("src", F.struct("hop", "src")).alias("src"))
    return best.filter("src <> dst").select("src", "dst", F.lit("impl").alias("kind")).distinct()


def method_sets(required: DataFrame, methods: DataFrame) -> DataFrame:
    """(iface, type): types that have all methods of an interface, by name and signature: a relational division.

    required(iface, name, sig); methods(type, name, sig). Interfaces without methods are no interfaces here.
    """
    need = required.select("iface", "name", "sig").distinct()
    sizes = need.groupBy("iface").agg(F.count("*").alias("_need"))
    have = need.join(methods.select("type", "name", "sig").distinct(), ["name", "sig"]).groupBy("iface", "type").agg(F.count("*").alias("_have"))
    return have.join(sizes, "iface").filter("_have = _need").select("iface", "type")


def implement_edges(required: DataFrame, methods: DataFrame) -> DataFrame:
    """Edges of kind impl from an interface's methods(key) to those of the types that satisfy it."""
    pairs = method_sets(required, methods)
    left = pairs.join(required.select("iface", "name", F.col("key").alias("src")), "iface")
    return left.join(methods.select("type", "name", F.col("key").alias("dst")), ["type", "name"]).select("src", "dst", F.lit("impl").alias("kind")).distinct()


def last_declared(tokens: DataFrame, declarations: DataFrame, on: list[str], name: str = "name") -> DataFrame:
    """tokens(on, name) with the key of the declaration(on, name, key, ord) that the name means: the last one, or null."""
    last = declarations.groupBy(*on, name).agg(F.max_by("key", "ord").alias("key"))
    return tokens.join(last, [*on, name], "left")


def new_symbols(units: DataFrame, base: DataFrame, on: list[str]) -> DataFrame:
    """units(on, file, symbol, status) with is_new: whether the base(on, file, name) lacks the symbol; null where nothing
    is known of the file, where it isn't modified, or where the unit has no symbol."""
    known = base.select(*on, "file").distinct().withColumn("_file", F.lit(True))
    names = base.select(*on, "file", F.col("name").alias("symbol")).distinct().withColumn("_name", F.lit(True))
    met = units.join(known, [*on, "file"], "left").join(names, [*on, "file", "symbol"], "left")
    asked = F.col("_file") & (F.col("status") == "modified") & (F.col("symbol") != "")
    return met.withColumn("is_new", F.when(asked, F.col("_name").isNull())).drop("_file", "_name")


def resolved_aliases(aliases: DataFrame, on: list[str], depth: int = 8) -> DataFrame:
    """(on, name, means, steps): what each alias stands for in the end, through at most ``depth`` others; null beyond, and in a cycle.

    aliases(on, name, target, ord): of several targets the first declared counts. A round doubles the steps of all aliases at
    once, so a chain takes as many joins as its length has bits, and a cycle ends with the bound.
    """
    state = cut(aliases.groupBy(*on, "name").agg(F.min_by("target", F.struct("ord", "target")).alias("means"), F.lit(1).alias("steps")))
    names = state.select(*on, F.col("name").alias("means"), F.lit(True).alias("_alias"))
    reached = 1
    while reached < depth:
        more = min(reached, depth - reached)  # the last round adds what is left of the bound
        jump = state if more == reached else _steps(aliases, on, more)
        ahead = jump.select(*on, F.col("name").alias("means"), F.col("means").alias("_then"), F.col("steps").alias("_more"))
        state = cut(state.join(ahead, [*on, "means"], "left").select(*on, "name", F.coalesce("_then", "means").alias("means"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps")))
        reached += more
    met = state.join(names, [*on, "means"], "left")
    return met.select(*on, "name", F.when(F.col("_alias").isNull(), F.col("means")).alias("means"), F.when(F.col("_alias").isNull(), F.col("steps")).alias("steps"))


def _steps(aliases: DataFrame, on: list[str], many: int) -> DataFrame:
    """(on, name, means, steps): each alias followed for exactly so many steps, or to its end."""
    one = aliases.groupBy(*on, "name").agg(F.min_by("target", F.struct("ord", "target")).alias("means"), F.lit(1).alias("steps"))
    state, ahead = one, one.select(*on, F.col("name").alias("means"), F.col("means").alias("_then"))
    for _ in range(many - 1):
        state = cut(state.join(ahead, [*on, "means"], "left").select(*on, "name", F.coalesce("_then", "means").alias("means"), (F.col("steps") + F.col("_then").isNotNull().cast("int")).alias("steps")))
    return state


def inherited_members(members: DataFrame, supers: DataFrame, depth: int = 6) -> DataFrame:
    """(type, name, key, via, hops): each type's members and those it inherits, as they are found by looking into the type, then into
    its supers in the order of their declaration, each with its own supers first, at most ``depth`` up.

    members(type, name, key, ord); supers(type, super, ord). A line of supers is the list of their places; the order of these
    lists is the order of looking. Cycles end with the bound.
    """
    step = supers.groupBy(F.col("type").alias("via"), F.col("super").alias("_up")).agg(F.min("ord").alias("_ord"))
    line = members.select("type").unionByName(supers.select("type")).distinct().select("type", F.col("type").alias("via"), F.array().cast("array<int>").alias("path"))
    every = line
    for _ in range(depth):
        up = line.join(step, "via").select("type", F.col("_up").alias("via"), F.concat("path", F.array(F.col("_ord").cast("int"))).alias("path"))
        line = cut(up.groupBy("type", "via").agg(F.min("path").alias("path")))
        every = every.unionByName(line)
    own = members.groupBy(F.col("type").alias("via"), "name").agg(F.min_by("key", F.struct("ord", "key")).alias("key"))
    found = every.join(own, "via").groupBy("type", "name").agg(F.min(F.struct("path", "via", "key")).alias("m"))
    return found.select("type", "name", "m.key", "m.via", F.size("m.path").alias("hops"))
