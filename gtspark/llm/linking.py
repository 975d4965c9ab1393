"""Union-find and candidate pairing shared by the similarity operators.

``components`` is the alternating large-star / small-star algorithm: every
round is a grouped minimum (combined before its shuffle) and a join whose hot
keys Spark can split; nothing is collected per node or on the driver.

``link`` finds links that span the components of the graph "share a key and pass ``verify``"
without emitting all pairs of a key's rows.  First every row is verified
against one leader, that of the keys it shares most often;
that ties large groups of copies together in a linear number of pairs.  Then
only pairs whose components still differ are verified, all of them, so no
link that would join two components is missed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store


def _stars(e: DataFrame) -> bool:
    """Whether every id has one edge up, or only edges down: the edges (a, b), a > b, are the components."""
    ends = e.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        e.select("b", F.lit(0), F.lit(1)))
    own = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return own.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (a, b); component is the smallest id reachable."""
    e = store(edges.where(F.col("a") != F.col("b"))
              .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(e):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (both.where(F.col("b") > F.col("a")).join(low, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = store(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where(F.col("b") != F.col("m"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        e = store(small, "edges")
    return (e.select(F.col("a").alias("id"), F.col("b").alias("component"))
            .union(e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct())


def link(postings: DataFrame, verify: Callable[[DataFrame], DataFrame],
         bound: Callable[[str, str], Column] | None = None, detail: Callable | None = None) -> DataFrame:
    """Edges (a, b) that span the components of the links among ``postings`` (key, id, w, ...).

    The id of the largest weight ``w`` leads a key.  ``verify`` keeps those
    pairs (a, b) that link; ``bound`` is a cheap necessary condition on the
    postings of a pair, given their two aliases.  ``detail`` takes the ids that
    reach the second pass and gives (a frame of columns by id, the condition
    of that pass on these, the key, ``size`` and ``component``, and its ``verify``).
    """
    shared = store(postings, "shared")
    own = F.struct(*[c for c in shared.columns if c != "key"])
    leads = (shared.groupBy("key").agg(F.count(F.lit(1)).alias("__n"), F.max_by(own, "w").alias("__l"))
             .where(F.col("__n") > 1).select("key", "__l.*"))

    def candidates(x, y, on, bound=bound):
        on = (F.col("x.key") == F.col("y.key")) & on
        if bound is not None:
            on = on & bound("x", "y")
        return x.alias("x").join(y.alias("y"), on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    star = (candidates(leads, shared, F.col("x.id") != F.col("y.id")).groupBy("a", "b").count()
            .groupBy("b").agg(F.max_by("a", "count").alias("a")).select("a", "b"))
    first = store(verify(store(star, "pairs")), "links")
    own = store(components(first), "components")
    tagged = shared.join(own, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = (tagged.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where(F.col("lo") != F.col("hi")).select("key"))
    if detail is not None:
        tagged = tagged.select("key", "id", "size", "component")
    tagged = store(tagged.join(mixed, "key", "leftsemi"), "mixed")
    closer = bound
    if detail is not None:
        more, closer, verify = detail(tagged.select("id").distinct())
        tagged = tagged.join(more, "id")
    pairs = candidates(tagged, tagged, (F.col("x.id") < F.col("y.id"))
                       & (F.col("x.component") != F.col("y.component")), closer).distinct()
    second = store(verify(store(pairs, "pairs")), "links")
    return own.select(F.col("id").alias("a"), F.col("component").alias("b")).union(second)
