"""Connected components of a link table, in any number of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opledger.llm.common import Spread, dropped, materialised


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``links (a, b)``; the root is the least node.

    Every round gives a node the least label among its own, its neighbours' and
    its label's label, so labels spread along paths while trees are halved.  Each
    round is written to the shared folder, which keeps lineage short; only the
    number of changed labels comes to the driver.  Ends with very many links, and
    labels of very many nodes, are joined in parts.  Null ends are left out.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a is not null and b is not null")
    edges = materialised(both.distinct())
    labels = materialised(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    ends = Spread(edges.groupBy("b").agg(F.count("*").alias("n")), "b", "n")
    while True:
        near = ends.join(edges, labels.select(F.col("node").alias("b"), "root")).groupBy("a").agg(F.min("root").alias("near"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        roots = Spread(labels.groupBy("root").agg(F.count("*").alias("n")), "root", "n")
        step = roots.join(labels, up).join(near, F.col("node") == F.col("a")).select("node", F.least("up", "near", "root").alias("least"), "root")
        new = materialised(step.select("node", F.col("least").alias("root"), (F.col("least") != F.col("root")).alias("changed")))
        moved = new.filter("changed").limit(1).count()
        dropped(labels)
        labels = new.select("node", "root")
        if not moved:
            dropped(edges)
            return labels
