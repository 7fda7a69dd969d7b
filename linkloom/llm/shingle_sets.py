"""Sets of shingles, and the exact similarity of candidate pairs.

Nodes that candidate links connect are a cluster, dealt into blocks, and each pair of blocks is compared in a task. Only a spanning forest of the links leaves a task; components of the forests
are those of all links. Sets are made again for the nodes of clusters, and no others move.

Cases: words and null, blank and short texts as in simhash (texts without a word are equal, a text of fewer words than a
shingle is one shingle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import checkpointed, hot_share, join_hot, some_of, swept
from linkloom.llm.components import components

SEED = 42
#: Nodes of a block of a cluster.
BLOCK = 256


def shingles(text: bytes, shingle: int):
    """The distinct hashes of a text's shingles, sorted."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: lowers A-Z, splits at ASCII white space
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64))


def node_of(grams) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(grams.tobytes(), SEED)


def _sets(shingle: int):
    """(id, text) -> (node, grams)"""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sets = [shingles((p.as_py() or "").encode(), shingle) for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([node_of(s) for s in sets], np.uint64).view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "grams"])

    return run


class _Index:
    """Sets of shingles, by shingle."""

    def __init__(self, nodes: list, sets: list, least: tuple[int, int]):
        import numpy as np

        self.least, self.nodes, self.sizes = least, nodes, np.array([len(s) for s in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        place = np.argsort(every, kind="stable")
        self.grams, first = np.unique(every[place], return_index=True)
        self.owner, self.start = owner[place], np.append(first, len(every))

    def similar(self, own):
        """Of the sets that are similar to this one: their nodes."""
        import numpy as np

        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = at[self.grams[at] == own]
        n = self.start[at + 1] - self.start[at]
        rows = np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(self.owner[rows], minlength=len(self.nodes))
        up, down = self.least
        return [self.nodes[k] for k in np.flatnonzero((up + down) * shared >= up * (self.sizes + len(own)))]


def _links(least: tuple[int, int]):
    """Over (task, side, node, grams) sorted by task and side: links (u, v) between its sides, as many as connect them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        task, index, waiting, root = None, None, ([], []), {}

        def find(a):
            while root.setdefault(a, a) != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        for batch in batches:
            out = []
            for name, side, node, grams in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if name != task:
                    task, index, waiting, root = name, None, ([], []), {}
                own = np.frombuffer(grams, np.uint64)
                if side == 0:
                    waiting[0].append(node)
                    waiting[1].append(own)
                    continue
                if not waiting[0]:
                    continue
                index = index or _Index(*waiting, least)
                for other in index.similar(own):
                    a, b = find(node), find(other)
                    if a != b:
                        root[a] = b
                        out.append((node, other))
            pairs = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, c])) for c in (0, 1)], ["u", "v"])

    return run


def verified(texts: DataFrame, nodes: DataFrame, met: DataFrame, n: int, shingle: int, least: tuple[int, int]) -> DataFrame:
    """Links (u, v) of similarity `least` or more, as many as connect what all of them connect.

    texts: (id, text). nodes: (node, first), checkpointed, the n nodes and a text that has each. met: (u, v), links that
    connect whatever may be similar; all pairs of nodes that they connect are compared.
    """
    spark = texts.sparkSession
    clusters = components(met)
    swept(spark)
    sizes = checkpointed(clusters.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).alias("blocks")), n)
    placed = join_hot(clusters, sizes, "root", hot_share(spark, n)).withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # A node is on the first side of some tasks, on the second of others and, where its block meets itself, on both.
    sides = F.when(F.col("own") == F.col("other"), F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("own") > F.col("other")).cast("int")))
    asked = checkpointed(placed.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("task"), F.explode(sides).alias("side"), "node"))
    wanted = checkpointed(nodes.join(clusters.select("node"), "node", "left_semi").select(F.col("first").alias("id")).distinct(), n)
    sets = some_of(texts, wanted, "id").mapInArrow(_sets(shingle), "node long, grams binary")
    sets = checkpointed(sets.groupBy("node").agg(F.first("grams").alias("grams")))
    swept(spark)
    both = asked.join(sets, "node").select("task", "side", "node", "grams")
    return both.repartition("task").sortWithinPartitions("task", "side").mapInArrow(_links(least), "u long, v long")
