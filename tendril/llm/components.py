"""Connected components of a link table, as rounds of joins and minima.

Each round every node hooks to its smallest neighbour, hooks are followed one
step further, and the links are rewritten between the nodes that are left, so
the table shrinks by half at least in each round.  Tables between rounds are
written to the shared folder.  Minima combine before they are shuffled, so a node
with very many links costs no single task its links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.llm.shared import stored


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component`` for every node of ``links``; the component is its smallest node.

    Links to oneself and null ends are passed over; links may repeat and stand in
    either direction.  An empty table gives no rows.
    """
    pair = links.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).where(F.col("a") < F.col("b"))
    live = stored(pair.distinct(), "links")
    spark = links.sparkSession
    hops: list[DataFrame] = []
    while not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("to")))
        hook = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to"))
        further = hook.select(F.col("node").alias("to"), F.col("to").alias("end"))
        hook = stored(hook.join(further, "to").select("node", F.col("end").alias("to")), "hooks")
        hops.append(hook)
        one = live.join(hook.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(hook.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        live = stored(one.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where(F.col("a") < F.col("b")).distinct(), "links")
    if not hops:
        return spark.createDataFrame([], f"node {links.schema[left].dataType.simpleString()}, component {links.schema[left].dataType.simpleString()}")
    found = hops[-1].withColumnRenamed("to", "component")
    for hook in reversed(hops[:-1]):  # a node's component is that of the node it hooked to
        after = found.withColumnRenamed("node", "to")
        found = hook.join(after, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    return stored(found, "components")
