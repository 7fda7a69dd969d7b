"""Pairs of records of equal names, made and compared block by block: a task's pairs exist as arrays alone, some thousands at a
time. blocking.named_alike makes the blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from linkloom.functions.similarity import indel_ratios
from linkloom.operators.split import BINS
from linkloom.schema import FEATURES

#: Pairs that are compared at once, and tokens of a text up to which sets are compared as rows of numbers.
PAIRS, MOST_TOKENS = 65_536, 64

#: What blocks carry for features: canonical forms; the name that makes the blocks is another.
CARRIED = ("canonical", "core", "address", "number", "country")


def featured(blocks: DataFrame) -> DataFrame:
    """blocks: with CARRIED. A row for each pair, as features.compared makes it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records, i, j in pairs_of(batches):
            yield pa.RecordBatch.from_arrays([*ids(records, i, j), *map(pa.array, features(records, i, j))], ["s1_id", "cand_id", *FEATURES])

    return blocks.mapInArrow(rows, "s1_id string, cand_id string, " + ", ".join(f"{c} double" for c in FEATURES))


def grouped(blocks: DataFrame) -> DataFrame:
    """The same, but equal features of a batch are one row: (*FEATURES, pairs), pairs an array of (s1_id, cand_id)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records, i, j in pairs_of(batches):
            found = features(records, i, j)
            first, code = _distinct(found)
            order, ends = np.argsort(code, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(first)))])
            pairs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(ids(records, i[order], j[order]), ["s1_id", "cand_id"]))
            yield pa.RecordBatch.from_arrays([*(pa.array(v[first]) for v in found), pairs], [*FEATURES, "pairs"])

    return blocks.mapInArrow(rows, ", ".join(f"{c} double" for c in FEATURES) + ", pairs array<struct<s1_id: string, cand_id: string>>")


def binned(blocks: DataFrame, seed: int) -> DataFrame:
    """blocks: with CARRIED and the true key, empty if there is none. How many pairs there are by bin of their digest (bin, n), a
    row or more for each; true pairs as bin -1."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS + 1, np.int64)
        for records, i, j in pairs_of(batches):
            true = equal([r[-1] for r in records], i, j) > 0
            counts[-1] += true.sum()
            counts[:-1] += np.bincount(_bins(records, i[~true], j[~true], seed), minlength=BINS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(some == BINS, -1, some), pa.int32()), pa.array(counts[some])], ["bin", "n"])

    return blocks.mapInArrow(rows, "bin int, n long")


def labelled(blocks: DataFrame, seed: int, last: int) -> DataFrame:
    """blocks: as for binned. Features and labels of the true pairs, and of the others up to the last bin of digests."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records, i, j in pairs_of(batches):
            label = equal([r[-1] for r in records], i, j).astype(np.int32)
            stays, others = label > 0, np.flatnonzero(label == 0)
            stays[others] = _bins(records, i[others], j[others], seed) <= last
            i, j, label = i[stays], j[stays], label[stays]
            if len(i):
                yield pa.RecordBatch.from_arrays([*ids(records, i, j), *map(pa.array, features(records, i, j)), pa.array(label)], ["s1_id", "cand_id", *FEATURES, "label"])

    return blocks.mapInArrow(rows, "s1_id string, cand_id string, " + ", ".join(f"{c} double" for c in FEATURES) + ", label int")


def _bins(records: list[tuple], i: np.ndarray, j: np.ndarray, seed: int) -> np.ndarray:
    """split.digest_bin of pairs."""
    own = [r[1].encode() for r in records]
    begun = [b"%d:%b:" % (seed, x) for x in own]
    md5 = partial(hashlib.md5, usedforsecurity=False)
    first = b"".join([md5(begun[p] + own[q]).digest()[:2] for p, q in zip(i.tolist(), j.tolist())])
    return (np.frombuffer(first, ">u2") >> 4).astype(np.int64)


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The places of rows, one of each kind, and for each row the number of its kind."""
    mixed = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        mixed ^= (c + 0.0).view(np.uint64)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    _, first, code = np.unique(mixed, return_index=True, return_inverse=True)
    if not all((c[first[code]] == c).all() for c in columns):  # two kinds were mixed into one number
        _, first, code = np.unique(np.stack(columns, axis=1), axis=0, return_index=True, return_inverse=True)
    return first, code.ravel()


def ids(records: list[tuple], i: np.ndarray, j: np.ndarray) -> list[pa.Array]:
    """The identifiers of both sides of pairs."""
    own = pa.array([r[1] for r in records], pa.string())
    return [own.take(pa.array(at)) for at in (i, j)]


def features(records: list[tuple], i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """The features of pairs of records (name, id, CARRIED), in their order."""
    column = lambda k: [r[k] for r in records]
    out = {f"{what}_{c}": v for what, k in (("name", 2), ("address", 4)) for c, v in similarities(column(k), i, j, indel_ratios).items()}
    out |= {c: equal(column(k), i, j) for c, k in (("name_core_exact", 3), ("address_number_equal", 5), ("country_equal", 6))}
    out["name_address_mean"] = (out["name_ratio"] + out["address_ratio"]) / 2
    out["name_address_min"] = np.minimum(out["name_ratio"], out["address_ratio"])
    return [out[c] for c in FEATURES]


def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Records (name, id and what blocks carry) and pairs of their places: at most about PAIRS at a time, of one large block or
    of many small ones."""
    records, found, size = [], [], 0
    for name, left, right, gone in _blocks(batches):
        if not left or not right:
            continue
        lo, mid = len(records), len(records) + len(left)
        records += [(name, r[0], *r[2:]) for r in left + right]
        places = {r[0]: k for k, r in enumerate(left, lo)}, {r[0]: k for k, r in enumerate(right, mid)}
        out = np.array([places[0][r[0]] * len(records) + places[1][r[1]] for r in gone], np.int64)
        step = max(1, PAIRS // len(right))
        for k in range(lo, mid, step):
            some, others = np.arange(k, min(mid, k + step)), np.arange(mid, len(records))
            i, j = np.repeat(some, len(others)), np.tile(others, len(some))
            if len(out):
                stays = ~np.isin(i * len(records) + j, out)
                i, j = i[stays], j[stays]
            found.append((i, j))
            size += len(i)
            if size >= PAIRS // 2:
                yield records, *map(np.concatenate, zip(*found))
                found, size = [], 0
        if not found:
            records = []
    if size:
        yield records, *map(np.concatenate, zip(*found))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list, list, list]]:
    """The name of each block and its rows (id, other and what blocks carry) of each side."""
    last, sides = None, ([], [], [])
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != last:
                if last:
                    yield last[0], *sides
                last, sides = row[:3], ([], [], [])
            sides[row[3]].append(row[4:])
    if last:
        yield last[0], *sides


def numbered(texts: list) -> tuple[np.ndarray, list]:
    """A number for each text, the same for equal ones, and the texts by number."""
    numbers: dict = {}
    return np.array([numbers.setdefault(t, len(numbers)) for t in texts], np.int64), list(numbers)


def tokens(text: str) -> set[str]:
    return {x for x in text.split(" ") if x}


def equal(texts: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """1.0 where both are the same and not empty."""
    code, texts = numbered(texts)
    full = np.array([t != "" for t in texts], bool)
    return ((code[i] == code[j]) & full[code[i]]).astype(np.float64)


def similarities(texts: list[str], i: np.ndarray, j: np.ndarray, ratios: Callable) -> dict[str, np.ndarray]:
    """exact, ratio, jaccard, overlap and the number of shared tokens of pairs texts[i], texts[j]; texts that meet more than once
    are compared once."""
    code, texts = numbered(texts)
    some, back = np.unique(code[i] * len(texts) + code[j], return_inverse=True)
    x, y = np.divmod(some, len(texts))
    sets = [tokens(t) for t in texts]
    size, shared = np.array([len(s) for s in sets], np.int64), _shared(sets, x, y)
    either, least = size[x] + size[y] - shared, np.minimum(size[x], size[y])
    found = {
        "exact": ((x == y) & np.array([t != "" for t in texts], bool)[x]).astype(np.float64), "ratio": ratios(texts, x, y),
        "jaccard": np.where(either == 0, 1.0, shared / np.maximum(either, 1)), "overlap": np.where(least == 0, 0.0, shared / np.maximum(least, 1)),
        "shared": shared.astype(np.int32),
    }
    return {c: v[back] for c, v in found.items()}


def _shared(sets: list[set], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of members that the sets of each pair share."""
    most = max(map(len, sets))
    if most > MOST_TOKENS:
        return np.array([len(sets[p] & sets[q]) for p, q in zip(x.tolist(), y.tolist())], np.int64)
    numbers: dict[str, int] = {}
    rows = [np.zeros((most, len(sets)), np.uint32) for _ in range(2)]  # what fills them up differs, so that it is never shared
    rows[1] += 1
    for k, s in enumerate(sets):
        for r in rows:
            r[: len(s), k] = [numbers.setdefault(t, len(numbers) + 2) for t in s]
    if len(numbers) + 2 < 1 << 16:
        rows = [r.astype(np.uint16) for r in rows]
    out = np.zeros(len(x), np.int64)
    for f in range(0, len(x), 4096):
        a, b = (r[:, v[f : f + 4096]] for r, v in zip(rows, (x, y)))
        for t in a:
            out[f : f + 4096] += np.logical_or.reduce(b == t, axis=0)
    return out
