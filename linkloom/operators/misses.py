"""Missed pairs of equal names, made and compared block by block: a task's pairs exist as arrays alone, some thousands at a
time, and are listed or counted there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from linkloom.functions.similarity import block_ratios
from linkloom.operators.alike import equal, pairs_of, similarities, tokens

#: The columns of a missed pair, as miss_features has them.
LISTED = (
    "s1_id string, cand_id string, name_exact double, name_ratio double, name_jaccard double, name_overlap double, shared_name_tokens int, "
    "address_exact double, address_ratio double, address_jaccard double, address_overlap double, shared_address_tokens int, "
    "address_number_equal double, country_equal double, s1_name string, true_name string, s1_address string, true_address string"
)


def listed(blocks: DataFrame) -> DataFrame:
    """blocks: as blocking.named_alike makes them. A row for each pair, as diagnose.miss_features makes it."""
    columns = [c.split()[0] for c in LISTED.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records, i, j in pairs_of(batches):
            found = _compared(records, i, j)
            for name, k, at in (("s1_id", 1, i), ("cand_id", 1, j), ("s1_name", 0, i), ("true_name", 0, j), ("s1_address", 2, i), ("true_address", 2, j)):
                found[name] = pa.array([r[k] for r in records], pa.string()).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(found[c]) for c in columns], columns)

    return blocks.mapInArrow(rows, LISTED)


def value_counts(blocks: DataFrame, columns: list[str]) -> DataFrame:
    """How many pairs have each value of each column: (column, v, n), a row or more for each value."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[float, int]] = {c: {} for c in columns}
        for records, i, j in pairs_of(batches):
            found = _compared(records, i, j)
            for c, of in counts.items():
                for v, n in zip(*(x.tolist() for x in np.unique(found[c].astype(np.float64), return_counts=True))):
                    of[v] = of.get(v, 0) + n
        flat = [(c, v, n) for c, of in counts.items() for v, n in of.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int64()))], ["column", "v", "n"])

    return blocks.mapInArrow(rows, "column string, v double, n long")


def predicate_counts(blocks: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """How many pairs there are (all) and how many satisfy each predicate, comparisons (=, >=) joined by `and`: sums of a task."""
    names = ["all", *predicates]
    tests = [[(c, np.equal if op == "=" else np.greater_equal, float(v)) for c, op, v in (x.split() for x in p.split(" and "))] for p in predicates.values()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(names), np.int64)
        for records, i, j in pairs_of(batches):
            found = _compared(records, i, j)
            sums += [len(i), *(np.logical_and.reduce([op(found[c], v) for c, op, v in test]).sum() for test in tests)]
        yield pa.RecordBatch.from_arrays([pa.array([n]) for n in sums.tolist()], names)

    return blocks.mapInArrow(rows, ", ".join(f"`{n}` long" for n in names))


def _compared(records: list[tuple], i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
    """The similarities of pairs of records of equal names, which are not empty; addresses that meet more than once are compared once."""
    one = np.ones(len(i))
    out = {c: one for c in ("name_exact", "name_ratio", "name_jaccard", "name_overlap")}
    shared = {t: len(tokens(t)) for t in {r[0] for r in records}}
    out["shared_name_tokens"] = np.array([shared[r[0]] for r in records], np.int32)[i]
    for c, k in (("country_equal", 3), ("address_number_equal", 4)):
        out[c] = equal([r[k] for r in records], i, j)
    of = similarities([r[2] for r in records], i, j, block_ratios)
    return out | {"shared_address_tokens": of.pop("shared")} | {f"address_{c}": v for c, v in of.items()}
