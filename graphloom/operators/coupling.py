"""Coupling and cohesion of types, dependence of packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, checkpointed, parent

TYPES = ("class", "interface")


def _owners(g: Graph) -> DataFrame:
    """(id, owner, kind): types own themselves; methods and variables below a type are owned by it."""
    types = g.nodes.where(F.col("kind").isin(*TYPES)).select(F.col("id").alias("owner"))
    members = g.nodes.where(F.col("kind").isin("method", "variable", "function")).select("id", "kind", parent(F.col("id")).alias("owner"))
    own = g.nodes.where(F.col("kind").isin(*TYPES)).select("id", "kind", F.col("id").alias("owner"))
    return members.join(types, "owner", "left_semi").select("id", "kind", "owner").unionByName(own)


def type_metrics(g: Graph) -> DataFrame:
    """(id, methods, cbo, rfc, atfd, wmc): counts are 0 where nothing was found, wmc is null unless all methods were measured."""
    own = _owners(g)
    kinds = g.nodes.select(F.col("id").alias("dst"), F.col("kind").alias("to_kind"))
    e = g.plain().select("src", "dst", "kind").join(own.select(F.col("id").alias("src"), F.col("owner").alias("a"), F.col("kind").alias("from_kind")), "src", "left")
    e = e.join(own.select(F.col("id").alias("dst"), F.col("owner").alias("b")), "dst", "left").join(kinds, "dst")
    # What is counted of an edge: the owner it leads to, the foreign method it calls, the foreign datum it touches.
    lifted = e.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    cbo = lifted.union(lifted.select("b", "a")).groupBy(F.col("a").alias("id")).agg(F.count_distinct("b").alias("cbo"))
    mine = e.where("a is not null and from_kind = 'method'")
    foreign = F.col("b").isNull() | (F.col("b") != F.col("a"))
    called = mine.where("kind = 'calls' and to_kind = 'method'").where(foreign).groupBy(F.col("a").alias("id")).agg(F.count_distinct("dst").alias("_called"))
    data = mine.where("kind in ('calls', 'reads', 'writes') and to_kind in ('method', 'variable')").where(foreign & (F.col("dst") != F.col("a")))
    atfd = data.groupBy(F.col("a").alias("id")).agg(F.count_distinct("dst").alias("atfd"))
    methods = g.nodes.where("kind = 'method'").select("id", "decisions").join(own.select("id", "owner"), "id").groupBy(F.col("owner").alias("id")).agg(
        F.count(F.lit(1)).alias("methods"), F.when(F.count("decisions") == F.count(F.lit(1)), F.sum(F.col("decisions").cast("long") + 1)).alias("wmc")
    )
    out = g.nodes.where(F.col("kind").isin(*TYPES)).select("id")
    for d in (methods, cbo, called, atfd):
        out = out.join(d, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select("id", zero("methods").alias("methods"), zero("cbo").alias("cbo"), (zero("methods") + zero("_called")).alias("rfc"), zero("atfd").alias("atfd"), "wmc")


def cohesion(g: Graph) -> DataFrame:
    """(id, sharing, non_sharing, tcc): pairs of a type's methods with and without a common member.

    Null where there are fewer than two methods or none touches a member.
    Methods with equal sets of members count as one set; different sets meet
    only on members that they share.
    """
    kinds = g.nodes.select("id", "kind", "label", "refs")
    types = kinds.where(F.col("kind").isin(*TYPES)).select(F.col("id").alias("owner"))
    own = checkpointed(kinds.where("kind = 'method'").withColumn("owner", parent(F.col("id"))).join(types, "owner", "left_semi").select("id", "owner", "label", "refs"))
    touch = g.edges.where("kind in ('reads', 'writes')").select("src", "dst", "kind").distinct()
    touch = touch.join(own.select(F.col("id").alias("src"), "owner"), "src").join(kinds.select(F.col("id").alias("dst"), F.col("label").alias("to_label")), "dst")
    touch = checkpointed(touch.select("owner", F.col("src").alias("id"), "to_label", "kind"))
    names = own.select("owner", "label").union(touch.where("kind = 'writes'").select("owner", "to_label")).distinct()
    used = own.select("owner", "id", F.explode("refs").alias("label")).union(touch.select("owner", "id", "to_label"))
    # A label counts where the owner has a member of that name: one row each, never a type's whole member list.
    seen = used.join(names, ["owner", "label"], "left_semi").groupBy("owner", "id").agg(F.array_sort(F.collect_set("label")).alias("s"))
    m = own.select("owner", "id").join(seen, ["owner", "id"], "left").withColumn("s", F.coalesce("s", F.array().cast("array<string>")))
    sets = checkpointed(m.groupBy("owner", "s").agg(F.count(F.lit(1)).alias("n")))
    n = sets.groupBy("owner").agg(F.sum("n").alias("methods"), F.max(F.size("s") > 0).alias("any"))
    own_pairs = sets.select("owner", F.when(F.size("s") > 0, F.col("n") * (F.col("n") - 1) / 2).otherwise(F.lit(0.0)).alias("p"))
    # Different sets meet on the members they share, each pair counted once.
    key = F.sha1(F.array_join("s", "\x00"))
    each = sets.where(F.size("s") > 0).select("owner", "n", key.alias("k"), F.explode("s").alias("member"))
    # A member of one set alone meets no other.
    each = checkpointed(each.withColumn("_sets", F.count(F.lit(1)).over(Window.partitionBy("owner", "member"))).where("_sets > 1").drop("_sets"))
    met = each.join(each.select("owner", "member", F.col("k").alias("k2"), F.col("n").alias("n2")), ["owner", "member"]).where("k < k2")
    cross = met.select("owner", "k", "k2", "n", "n2").distinct().select("owner", (F.col("n") * F.col("n2")).cast("double").alias("p"))
    shared = own_pairs.union(cross).groupBy("owner").agg(F.sum("p").cast("long").alias("sharing"))
    pairs = (F.col("methods") * (F.col("methods") - 1) / 2).cast("long")
    ok = (F.col("methods") >= 2) & F.col("any")
    out = n.join(shared, "owner").select(F.col("owner").alias("id"), F.when(ok, F.col("sharing")).alias("sharing"), F.when(ok, pairs - F.col("sharing")).alias("non_sharing"), F.when(ok, F.col("sharing") / pairs).alias("tcc"))
    return g.nodes.where(F.col("kind").isin(*TYPES)).select("id").join(out, "id", "left")


def package_metrics(g: Graph) -> DataFrame:
    """(id, ca, ce, external_ce, instability): distinct pairs of nodes across packages; instability is null without any."""
    p = g.profile
    e = g.edges.where(~p.is_in("containment")).select("src", "dst").distinct()
    e = e.select("src", "dst", p.package_of(F.col("src")).alias("a"), p.package_of(F.col("dst")).alias("b"))
    ce = e.where("a is not null and b is not null and a <> b").groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("ce"))
    ca = e.where("a is not null and b is not null and a <> b").groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("ca"))
    ext = e.where("a is not null and b is null").groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("external_ce"))
    all_ = g.nodes.select(p.package_of(F.col("id")).alias("id")).where("id is not null").distinct()
    out = all_.join(ca, "id", "left").join(ce, "id", "left").join(ext, "id", "left").na.fill(0, ["ca", "ce", "external_ce"])
    return out.withColumn("instability", F.try_divide(F.col("ce").cast("double"), (F.col("ca") + F.col("ce")).cast("double")))
