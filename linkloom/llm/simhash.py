"""Near duplicates by SimHash and a generalised pigeonhole search.

Fingerprints of 64 bits are cut into partitions of correlated bits. Two fingerprints that differ in at most `radius` bits
differ, in some partition i, in at most t_i bits, whenever the t_i sum to radius - partitions + 1. The t_i may differ, -1
meaning that a partition is not probed at all; dynamic programming over estimated candidates chooses them, and the number
of partitions, from the number of fingerprints and a bounded sample of them. That choice moves costs, never results.

Equal fingerprints are one node. Each node goes under its value in each probed partition, and under all values within t_i
bits of it. Under a value, distances are computed and only a spanning forest of the links leaves the task; where very
many nodes share a value, the same search is made again within them over the rest of their bits. Components of the forest
are those of all links.

`near_groups` links fingerprints. `similar_groups` links texts by the similarity of their shingles: it searches wider, over
more than one fingerprint, and computes the similarity of what meets exactly.

Cases: null text and texts without a word have fingerprint 0 and are linked like any other; whole texts count; repeated
rows share a fingerprint; a null identifier takes its component's least other identifier; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import shingle_sets
from linkloom.llm.common import checkpointed, ship
from linkloom.llm.components import least_ids

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Fingerprints that the plan of the search is made from.
SAMPLE = 4096
#: Cost of a moved row against that of a computed distance.
ROW_COST = 100.0
#: Nodes whose distances are computed in one matrix.
BLOCK = 2048
_SHINGLES_AT_ONCE = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []  # of bytes: lowers A-Z, splits at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.array([len(w) for w in words]) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, _SHINGLES_AT_ONCE):
        some = zip(starts[k : min(n, k + _SHINGLES_AT_ONCE)].tolist(), ends[k : k + _SHINGLES_AT_ONCE].tolist())
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in some], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    ship(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_fingerprints, "id long, fp long")


def _grouped_bits(sample, parts: int) -> list[list[int]]:
    """Bits in groups of like size, the bits of a group correlated."""
    import numpy as np

    if len(sample) < 2:
        return [list(range(BITS))[i::parts] for i in range(parts)]
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(float)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0))
    near = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    free, groups = list(range(BITS)), []
    for i in range(parts):
        size = BITS // parts + (i < BITS % parts)
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: near[b, group].mean())
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def plan_search(sample, n: int, radius: int = RADIUS, row_cost: float = ROW_COST) -> list[tuple[list[int], int]]:
    """Partitions and their thresholds, those that are probed."""
    import numpy as np

    sample = np.asarray(sample, np.uint64)
    some = sample[:1024]
    differ = some[:, None] ^ some[None, :]
    differ = differ[np.triu_indices(len(some), 1)]
    best, best_cost = [], float("inf")
    for parts in range(1, radius + 2):
        groups, total = _grouped_bits(sample, parts), radius - parts + 1
        cost = []
        for bits in groups:
            near = np.bitwise_count(differ & np.uint64(_mask(bits)))
            row = {-1: 0.0}
            for t in range(total + parts):
                probes = sum(comb(len(bits), d) for d in range(t + 1))
                likely = max(probes / 2.0 ** len(bits), float((near <= t).mean()) if len(near) else 0.0)
                row[t] = n * (1.0 + (probes if t else 0)) * row_cost + n * n / 2.0 * likely
            cost.append(row)
        # least[s]: the least cost of thresholds that sum to s, and those thresholds
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in least.items():
                for t, x in row.items():
                    if s + t not in new or c + x < new[s + t][0]:
                        new[s + t] = (c + x, [*ts, t])
            least = new
        found, thresholds = least[total]
        if found < best_cost:
            best_cost, best = found, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]
    return best


def _forest(fps, radius: int, bits: list[int]):
    """Links (a, b), b the least of its tree, that connect what any links within the radius connect."""
    import numpy as np

    if len(fps) < 2:
        return []
    if len(fps) <= BLOCK or len(bits) <= radius:
        links = []
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
        if int(near.sum()) == len(fps):
            return []
        free = np.ones(len(fps), bool)
        for k in np.flatnonzero(near.sum(axis=1) > 1):
            if not free[k]:
                continue
            tree, edge = np.zeros(len(fps), bool), np.zeros(len(fps), bool)
            tree[k] = edge[k] = True
            while edge.any():
                edge = near[edge].any(axis=0) & ~tree
                tree |= edge
            free &= ~tree
            members = fps[tree]
            links.append((members[members != members.min()], members.min()))
        return [(a, b) for many, b in links for a in many]
    out = []
    for i in range(radius + 1):
        own = bits[i :: radius + 1]
        rest = [b for b in bits if b not in own]
        value = fps & np.uint64(_mask(own))
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        for group in np.split(order, cuts):
            out += _forest(fps[group], radius, rest)
    return out


def _links(partitions: list[tuple[list[int], int]], radius: int):
    """Over rows (part, key, fp) sorted by part and key: links (u, v)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last, held = None, []

        def close():
            fps = np.unique(np.concatenate(held)).view(np.uint64)
            taken = partitions[last[0]][0]
            bits = [b for b in range(BITS) if b not in taken] if partitions[last[0]][1] == 0 else list(range(BITS))
            return _forest(fps, radius, bits)

        for batch in batches:
            part, key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(key) != 0)) + 1
            found: list = []
            for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(part)]))):
                if a == b:
                    continue
                name = (int(part[a]), int(key[a]))
                if name != last:
                    if held and sum(map(len, held)) > 1:
                        found += close()
                    last, held = name, []
                held.append(fp[a:b])
            yield _batch(found)
        if held and sum(map(len, held)) > 1:
            yield _batch(close())

    def _batch(found):
        import numpy as np
        import pyarrow as pa

        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, c])) for c in (0, 1)], ["u", "v"])

    return run


def _keys(partitions: list[tuple[list[int], int]]):
    """Over (fp): rows (part, key, fp), for each partition its value and those within its threshold."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for part, (bits, t) in enumerate(partitions):
                value = fp & np.uint64(_mask(bits))
                for d in range(t + 1):
                    for flips in combinations(bits, d):
                        key = (value ^ np.uint64(_mask(list(flips)))).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), part, np.int32)), pa.array(key), batch.column(0)], ["part", "key", "fp"])

    return run


def _plan(nodes: DataFrame, column: str, n: int, radius: int, row_cost: float = ROW_COST) -> list[tuple[list[int], int]]:
    sample = [r[0] % 2**64 for r in nodes.select(column).orderBy(F.xxhash64(column), column).limit(SAMPLE).collect()]
    return plan_search(sample, n, radius, row_cost)


def near_groups(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(id, fp) -> (id, fp, component_id): the least id that links reach."""
    rows = checkpointed(rows.select("id", "fp"))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), rows.count())
    partitions = _plan(nodes, "fp", nodes.count(), radius)
    keys = nodes.select("fp").mapInArrow(_keys(partitions), "part int, key long, fp long")
    links = keys.repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(_links(partitions, radius), "u long, v long")
    return least_ids(rows, nodes.select("fp", "first", "n"), links, "fp").select("id", "fp", "component_id")


def op8(df: DataFrame) -> DataFrame:
    return near_groups(fingerprints(df)).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near duplicates of a given similarity: the same search, wider and over more than one fingerprint, with exact links.

#: Shingles of five words, and the least similarity of a link.
SIMILAR_SHINGLE, SIMILAR = 5, (4, 5)
#: Fingerprints of a text, and the bits that one of them may differ in. A pair of similarity 0.8 differs in 9.7 bits of 64 on
#: average (an angle of arccos(0.889)), so that one fingerprint brings some 3 of 4 such pairs together and two some 93 %.
SIMILAR_PRINTS, SIMILAR_RADIUS = 2, 10
#: A wide search moves a node very often; its rows are dearer, as they take memory and disk.
SIMILAR_ROW_COST = 400.0
#: Fewer nodes than this are searched by the plan for so many, so that the rows of a node do not change with their number.
SIMILAR_LEAST = 300_000


def _prints(batches):
    """(id, text) -> (id, node, fp0, fp1, ...): the node is the text's set of shingles."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        nodes, found = [], []
        for text in batch.column(1):
            grams = shingle_sets.shingles((text.as_py() or "").encode(), SIMILAR_SHINGLE)
            nodes.append(shingle_sets.node_of(grams))
            found.append(_set_prints(grams))
        found = np.array(found, np.uint64).reshape(-1, SIMILAR_PRINTS).view(np.int64)
        columns = [batch.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64))] + [pa.array(np.ascontiguousarray(found[:, k])) for k in range(SIMILAR_PRINTS)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "node", *[f"fp{k}" for k in range(SIMILAR_PRINTS)]])


def _set_prints(grams) -> list[int]:
    """The fingerprints of a set of shingles, each from another mix of their hashes."""
    import numpy as np

    counts = np.zeros((SIMILAR_PRINTS, BITS), np.int64)
    for at in range(0, len(grams), _SHINGLES_AT_ONCE):
        some = grams[at : at + _SHINGLES_AT_ONCE]
        for k in range(SIMILAR_PRINTS):
            counts[k] += np.unpackbits(np.ascontiguousarray(some).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            some = some ^ (some >> np.uint64(31))
            some = some * np.uint64(0x9E3779B97F4A7C15)
            some = some ^ (some >> np.uint64(29))
    return [int(np.packbits(2 * c > len(grams), bitorder="little").view(np.uint64)[0]) for c in counts]


def _wide_keys(plans: list[list[tuple[list[int], int]]]):
    """Over (node, fp0, ...): rows (part, key, fp, node) for each fingerprint's partitions; parts are numbered through."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            part = 0
            for k, plan in enumerate(plans):
                column = batch.column(k + 1)
                fp = column.to_numpy().view(np.uint64)
                for bits, t in plan:
                    value = fp & np.uint64(_mask(bits))
                    for d in range(t + 1):
                        for flips in combinations(bits, d):
                            key = (value ^ np.uint64(_mask(list(flips)))).view(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), part, np.int32)), pa.array(key), column, batch.column(0)], ["part", "key", "fp", "node"])
                    part += 1

    return run


def _trees(fps, radius: int, bits: list[int]) -> list:
    """Arrays of the distinct fingerprints that links within the radius connect."""
    import numpy as np

    root: dict[int, int] = {}

    def find(a):
        while root.setdefault(a, a) != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in _forest(fps, radius, bits):
        root[find(int(a))] = find(int(b))
    out: dict[int, list[int]] = {}
    for a in list(root):
        out.setdefault(find(a), []).append(a)
    return [np.array(sorted(x), np.uint64) for x in out.values()]


def _met(plans: list[list[tuple[list[int], int]]], radius: int):
    """Over (part, key, fp, node) sorted by part and key: links (u, v), v the least of its tree, that connect all nodes whose
    fingerprints under a key are connected by distances within the radius."""
    parts = [p for plan in plans for p in plan]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def close(name, held):
            fp, node = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            fp = fp.view(np.uint64)
            order = np.argsort(fp, kind="stable")
            fp, node = fp[order], node[order]
            bits, t = parts[name[0]]
            free = [b for b in range(BITS) if b not in bits] if t == 0 else list(range(BITS))
            distinct, first, many = np.unique(fp, return_index=True, return_counts=True)
            trees = _trees(distinct, radius, free) if len(distinct) > 1 else []
            joined = set(np.concatenate(trees).tolist()) if trees else set()
            for tree in trees + [np.array([f], np.uint64) for f in distinct[many > 1] if int(f) not in joined]:
                at = np.searchsorted(distinct, tree)
                nodes = np.unique(np.concatenate([node[first[k] : first[k] + many[k]] for k in at]))
                yield nodes[1:], np.full(len(nodes) - 1, nodes[0])

        def batch_of(found):
            u, v = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        last, held = None, []
        for batch in batches:
            part, key, fp, node = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(key) != 0)) + 1
            found: list = []
            for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(part)]))):
                if a == b:
                    continue
                name = (int(part[a]), int(key[a]))
                if name != last:
                    if sum(len(h[0]) for h in held) > 1:
                        found += close(last, held)
                    last, held = name, []
                held.append((fp[a:b], node[a:b]))
            yield batch_of(found)
        if sum(len(h[0]) for h in held) > 1:
            yield batch_of(list(close(last, held)))

    return run


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, component_id): the least id that links reach, where a link is a pair of texts whose sets of shingles have
    a similarity of SIMILAR or more, if fingerprints bring it together. Texts of equal sets are one node."""
    ship(df.sparkSession)
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    prints = [f"fp{k}" for k in range(SIMILAR_PRINTS)]
    rows = checkpointed(texts.mapInArrow(_prints, f"id long, node long, {', '.join(f'{p} long' for p in prints)}"))
    nodes = checkpointed(rows.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("n"), *[F.first(p).alias(p) for p in prints]), rows.count())
    n = nodes.count()
    plans = [_plan(nodes, p, max(n, SIMILAR_LEAST), SIMILAR_RADIUS, SIMILAR_ROW_COST) for p in prints]
    keys = nodes.select("node", *prints).mapInArrow(_wide_keys(plans), "part int, key long, fp long, node long")
    met = keys.repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(_met(plans, SIMILAR_RADIUS), "u long, v long")
    links = shingle_sets.verified(texts, nodes, met, n, SIMILAR_SHINGLE, SIMILAR)
    return least_ids(rows.select("id", "node"), nodes.select("node", "first", "n"), links, "node")
