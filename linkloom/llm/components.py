"""Connected components of a graph, by alternating large and small stars.

Edges are first joined up within tasks of bounded size, which leaves a forest of fewer edges; a forest that fits one such
task is joined up there. Only what is larger goes through the rounds of stars, each of which is several jobs of all partitions.

A node with very many neighbours, as the centre of a star is, is hot: the rows of its edges stay where they are, and what
is known of it is broadcast.

Cases: edges with a null end are left out, as are those from a node to itself; repeated edges count once; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import checkpointed, hot_share, join_hot, ship

#: Edges that one task joins up at most (2.3 s and 213 MB more than before it for so many random ones).
ALONE = 2_000_000


def _joined(batches):
    """Over (u, v), longs: each node but the least of what these edges connect, with that least node."""
    import numpy as np
    import pyarrow as pa

    held = [tuple(batch.column(c).to_numpy() for c in (0, 1)) for batch in batches]
    n = sum(len(u) for u, _ in held)
    names, at = np.unique(np.concatenate([x[c] for c in (0, 1) for x in held] or [np.zeros(0, np.int64)]), return_inverse=True)
    del held
    label, a, b = np.arange(len(names)), at[:n], at[n:]
    while len(a):
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    ends = np.flatnonzero(label != np.arange(len(names)))
    for k in range(0, len(ends), 65536):
        some = ends[k : k + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[label[some]])], ["u", "v"])


def _forest(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Checkpointed edges that connect what the given ones do, and whether each of them is from a node to its root."""
    n = edges.count()
    while True:
        tasks = -(-n // ALONE)
        edges = checkpointed(edges.coalesce(max(1, tasks)).mapInArrow(_joined, "u long, v long"))
        if tasks <= 1:
            return edges, True
        before, n = n, edges.count()
        if n > ALONE and n > 0.7 * before:
            return edges, False


def _facts(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, root): every node that an edge names, with the least node of its component."""
    spark = edges.sparkSession
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    if dict(edges.dtypes) == {"u": "bigint", "v": "bigint"}:
        ship(spark)
        edges, done = _forest(edges)
        if done:
            return _rooted(edges)
    before = None
    while (now := _facts(edges)) != before:
        before, share = now, hot_share(spark, 2 * now[0])
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stars are computed again where they are used, unless there are hot ones.
        hot = not both.groupBy("u").count().where(F.col("count") > share).isEmpty()
        once = (lambda df: checkpointed(df, 2 * now[0])) if hot else lambda df: df
        least = once(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")))
        # Each neighbour above a node goes to the least of the node's neighbours.
        large = (join_hot(both, least, "u", share) if hot else both.join(least, "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = once(large.where("u <> v").distinct())
        # Each neighbour below a node, and the node, go to the least of them.
        least = once(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = (join_hot(large, least, "u", share) if hot else large.join(least, "u")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.where("u <> v").distinct(), 2 * now[0])
    return _rooted(edges)


def _rooted(edges: DataFrame) -> DataFrame:
    """(node, root) from edges of nodes to their roots."""
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select("v", "v").distinct().toDF("node", "root"))


def least_ids(rows: DataFrame, nodes: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """rows (node, ...) with component_id, the least id of their node's component. nodes: (node, first, n), checkpointed: each
    node's least id and number of rows; links (u, v) between nodes."""
    spark = rows.sparkSession
    total = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = components(links)
    ends = nodes.join(found.withColumnRenamed("node", "_node"), F.col(node) == F.col("_node"), "left")
    ends = checkpointed(ends.select(node, "first", "n", F.coalesce("root", node).alias("root")), total[0])
    roots = checkpointed(ends.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), total[0])
    own = join_hot(ends.select(node, F.col("n").alias("size"), "root"), roots, "root", hot_share(spark, total[0]))
    own = checkpointed(own.select(node, F.col("size").alias("n"), "component_id"), total[0])
    return join_hot(rows, own, node, hot_share(spark, total[1]))
