"""Similarities of two texts or token sets, 0 to 1."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.matching import matching_lengths


def equal(a: Column, b: Column) -> Column:
    """1.0 if both are the same and not empty."""
    return ((a != "") & (a == b)).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1.0 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Shared members against the smaller set; 0.0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bit-parallel steps over whole numbers of any width."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


#: Pairs that are compared at once, characters of a text up to which they are, bits of a word (one is left for the carry), words of a table.
AT_ONCE, LONGEST, BITS, TABLE = 8192, 190, 63, 1 << 22


def common_lengths(a: list[str], b: list[str]):
    """common_length of each pair."""
    import numpy as np

    place = {t: k for k, t in enumerate(dict.fromkeys([*a, *b]))}
    return subsequence_lengths(list(place), *(np.array([place[t] for t in s], np.int64) for s in (a, b)))


def subsequence_lengths(texts: list[str], i, j):
    """common_length of each pair texts[i], texts[j], by the same steps over arrays: a text's places of a character are bits
    of one word or more, made once for all of its pairs; the text that takes fewer words has the bits."""
    import numpy as np

    out = np.zeros(len(i), np.int64)
    short = np.array([len(t) <= LONGEST and "\0" not in t for t in texts], bool)
    plain = short[i] & short[j]
    for k in np.flatnonzero(~plain):
        out[k] = common_length(texts[i[k]], texts[j[k]])
    if not plain.any():
        return out
    texts = [t if ok else "" for t, ok in zip(texts, short)]
    length = np.array([len(t) for t in texts], np.int64)
    chars = np.array(texts, dtype=f"U{max(1, length.max())}").view(np.uint32).reshape(len(texts), -1).T
    used = np.zeros(int(chars.max()) + 1, bool)
    used[chars.ravel()] = used[0] = True
    codes = np.ascontiguousarray((np.cumsum(used) - 1).astype(np.int32)[chars])  # 0: after a text's end
    words = -(-length // BITS)
    x, y = np.where(words[i] > words[j], (j, i), (i, j))
    for w in range(1, int(words.max()) + 1):
        some = np.flatnonzero(plain & (words[x] == w))
        some = some[np.argsort(length[y[some]], kind="stable")]
        alphabet, step = int(used.sum()), len(some)
        if step * alphabet * w > TABLE and np.count_nonzero(np.bincount(x[some])) * alphabet * w > TABLE:
            step = max(1, TABLE // (alphabet * w))
        for f in range(0, len(some), step or 1):
            part = some[f : f + step]
            out[part] = _by_words(codes, alphabet, length, x[part], y[part], w)
    return out


def _by_words(codes, alphabet: int, length, x, y, words: int):
    """Of pairs in the order of the length of y, x having the bits."""
    import numpy as np

    own = np.flatnonzero(np.bincount(x))
    n, at = len(own), np.zeros(int(own[-1]) + 1, np.int64)
    at[own] = np.arange(n)
    tables = np.zeros((words, alphabet, n), np.uint64)
    for t in range(int(length[own].max())):
        tables[t // BITS, codes[t, own], np.arange(n)] |= np.uint64(1 << t % BITS)
    tables[:, 0] = 0
    tables, low, x = tables.reshape(words, -1), np.uint64((1 << BITS) - 1), at[x]
    out = np.zeros(len(x), np.int64)
    for f in range(0, len(x), AT_ONCE):
        s = slice(f, f + AT_ONCE)
        mine, others = x[s], y[s]
        rows = [np.full(len(mine), low) for _ in range(words)]
        hit, total = np.empty_like(rows[0]), np.empty_like(rows[0])
        for t in range(int(length[others[-1]])):
            place = codes[t].take(others).astype(np.int64)
            place *= n
            place += mine
            carry = None
            for k, row in enumerate(rows):
                tables[k].take(place, out=hit, mode="clip")
                hit &= row
                np.add(row, hit, out=total)
                if carry is not None:
                    total += carry
                if k + 1 < words:
                    carry = total >> np.uint64(BITS)
                    total &= low
                row -= hit
                row |= total
        out[s] = sum(np.bitwise_count(~row & low).astype(np.int64) for row in rows)
    return out


def indel_ratios(texts: list[str], i, j):
    """Twice the longest common subsequence against both lengths, of each pair texts[i], texts[j]; 1.0 if both are empty."""
    import numpy as np

    length = np.array([len(t) for t in texts], np.int64)
    out, both = (i == j).astype(np.float64), length[i] + length[j]
    rest = np.flatnonzero((i != j) & (length[i] > 0) & (length[j] > 0))
    out[rest] = 2.0 * subsequence_lengths(texts, i[rest], j[rest]) / both[rest]
    return out


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence against both lengths; 1.0 if both are empty. Equal pairs of a batch are compared once."""
    return _of_series(a, b, indel_ratios)


def _of_series(a: pd.Series, b: pd.Series, ratios) -> pd.Series:
    import numpy as np

    pairs = list(zip(a.fillna(""), b.fillna("")))
    place = {t: k for k, t in enumerate(dict.fromkeys(t for p in pairs for t in p))}
    distinct = list(dict.fromkeys(pairs))
    i, j = (np.array([place[p[side]] for p in distinct], np.int64) for side in (0, 1))
    found = dict(zip(distinct, ratios(list(place), i, j).tolist()))
    return pd.Series([found[p] for p in pairs], dtype="float64")


@F.pandas_udf(T.DoubleType())
def matching_blocks_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The diagnostic ratio by longest matching blocks; equal pairs of a batch are compared once."""
    return _of_series(a, b, block_ratios)


def block_ratios(texts: list[str], i, j):
    """Twice the characters in matching blocks against both lengths, of each pair texts[i], texts[j]; 1.0 if both are empty."""
    import numpy as np

    length = np.array([len(t) for t in texts], np.int64)
    out, both = (i == j).astype(np.float64), length[i] + length[j]
    rest = np.flatnonzero((i != j) & (length[i] > 0) & (length[j] > 0))
    out[rest] = 2.0 * matching_lengths(texts, i[rest], j[rest]) / both[rest]
    return out


def ratio(a: Column, b: Column) -> Column:
    """indel_ratio; equal texts, and pairs with one empty text, don't go through Python."""
    plain = (a == b) | (a == "") | (b == "")  # Python is asked for all rows, so that these go there without their texts
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(indel_ratio(F.when(~plain, a), F.when(~plain, b)))
