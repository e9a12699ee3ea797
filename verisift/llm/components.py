"""Connected components of a table of links, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node reachable from each node that has a link: node, component.

    Every round, a node and the node that it points to take over the smallest label among its neighbours, and
    pointers jump once. Groups are only ever reduced by min(), which is computed before the shuffle too; the joins
    read saved tables on both sides, so that AQE can split a node to which very many point. The number of rounds is
    about logarithmic in the longest path. Loops and repeated links are ignored, links with a null end too.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = save(links.select(F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))).alias("l")).select("l.*").distinct(), "links")
    labels = save(both.groupBy("u").agg(F.least("u", F.min("v")).alias("f")), "labels")
    seen = None
    while True:
        nearby = both.join(labels.select(F.col("u").alias("v"), F.col("f").alias("vf")), "v").groupBy("u").agg(F.min("vf").alias("m"))
        jump = labels.join(labels.select(F.col("u").alias("f"), F.col("f").alias("g")), "f")
        met = jump.join(nearby, "u")
        own = F.struct(F.col("u"), F.least("g", "m").alias("f"))
        hook = F.struct(F.col("f").alias("u"), F.col("m").alias("f"))
        new = save(met.select(F.explode(F.array(own, hook)).alias("x")).select("x.*").groupBy("u").agg(F.min("f").alias("f")), "labels")
        state = new.agg(F.bit_xor(F.xxhash64("u", "f"))).first()[0]
        drop(labels)
        labels = new
        if state == seen:
            break
        seen = state
    drop(both)
    return labels.select(F.col("u").alias("node"), F.col("f").alias("component"))
