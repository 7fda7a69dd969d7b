"""Matching blocks of many pairs of texts at once: what difflib.SequenceMatcher finds, over arrays instead of pair by pair."""

from __future__ import annotations

import difflib

import numpy as np

#: Characters up to which texts are compared as arrays: runs are bytes, and difflib leaves out frequent characters from 200 on.
LONGEST = 190
#: Bytes of a table of runs and of the texts of pairs that are compared at once, diagonals that are tried first, characters of a probe.
TABLE, AT_ONCE, DIAGONALS, PROBE = 1 << 21, 1 << 17, (0, 1, -1, 2, -2), 8


def matching_lengths(texts: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair texts[i], texts[j] the characters in matching blocks: the longest block first (the first in the first
    text, then in the second, of equals), then on both of its sides."""
    length = np.array([len(t) for t in texts], np.int64)
    short = np.array([len(t) <= LONGEST and "\0" not in t for t in texts], bool)
    plain = short[i] & short[j]
    out = np.zeros(len(i), np.int64)
    if plain.any():
        codes, pads = _codes([t if ok else "" for t, ok in zip(texts, short)])
        out[plain] = _matched(codes, pads, length, i[plain], j[plain])
    for k in np.flatnonzero(~plain):
        out[k] = sum(x.size for x in difflib.SequenceMatcher(None, texts[i[k]], texts[j[k]]).get_matching_blocks())
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, tuple[int, int]]:
    """A row of small numbers for each text, and two numbers that stand for no character."""
    chars = np.array(texts, dtype=f"U{max([1, *map(len, texts)])}").view(np.uint32).reshape(len(texts), -1)
    alphabet = np.unique(chars)
    return np.searchsorted(alphabet, chars).astype(np.min_scalar_type(len(alphabet) + 1)), (len(alphabet), len(alphabet) + 1)


def _matched(codes: np.ndarray, pads: tuple[int, int], length: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Stretches of all pairs that are still to be compared go round by round, those of like sizes together."""
    out = np.zeros(len(i), np.int64)
    width, flat = codes.shape[1], codes.ravel()
    pair, x, y, n, m = np.arange(len(i)), i * width, j * width, length[i], length[j]
    while len(some := np.flatnonzero((n > 0) & (m > 0))):
        about = (n[some] + 3) // 4 * 1024 + (m[some] + 3) // 4
        order = np.argsort(about, kind="stable")
        cuts = (np.flatnonzero(np.diff(about[order])) + 1).tolist()
        pair, x, y, n, m = (v[some[order]] for v in (pair, x, y, n, m))
        size, left, right = (np.empty(len(pair), np.int64) for _ in range(3))
        for s, e in zip([0, *cuts], [*cuts, len(pair)]):
            step = AT_ONCE // int(max(n[s:e].max(), m[s:e].max()))
            for f in range(s, e, step):
                t = slice(f, min(e, f + step))
                size[t], left[t], right[t] = _longest(flat, pads, x[t], y[t], n[t], m[t])
        out += np.bincount(pair, size, len(out)).astype(np.int64)
        hit = size > 0
        pair, x, y, n, m, size, left, right = (v[hit] for v in (pair, x, y, n, m, size, left, right))
        pair = np.concatenate([pair, pair])
        x, n = np.concatenate([x, x + left + size]), np.concatenate([left, n - left - size])
        y, m = np.concatenate([y, y + right + size]), np.concatenate([right, m - right - size])
    return out


def _longest(flat: np.ndarray, pads: tuple[int, int], x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray):
    """The longest block of stretches that begin at x and y: its size and its places in them. A column for each pair."""
    wide = [np.arange(w.max())[:, None] for w in (n, m)]
    a, b = (flat.take(w + at, mode="clip") for w, at in zip(wide, (x, y)))
    for rows, w, l, pad in zip((a, b), wide, (n, m), pads):
        np.putmask(rows, w >= l, pad)
    if min(len(a), len(b)) < 24:
        return _by_table(a, b)
    sure, *found = _by_diagonals(a, b)
    if len(rest := np.flatnonzero(~sure)):
        for old, new in zip(found, _by_table(a[:, rest], b[:, rest])):
            old[rest] = new
    return found


def _by_table(a: np.ndarray, b: np.ndarray):
    """By the lengths of the runs that end at any two places."""
    step = max(64, TABLE // (len(a) * len(b)))
    if a.shape[1] > step:
        parts = [_by_table(a[:, k : k + step], b[:, k : k + step]) for k in range(0, a.shape[1], step)]
        return [np.concatenate(p) for p in zip(*parts)]
    a, b = np.ascontiguousarray(a), np.ascontiguousarray(b)
    runs, top = np.empty((len(a), *b.shape), np.uint8), np.empty(a.shape, np.uint8)
    same = np.empty(b.shape, bool)
    for i, run in enumerate(runs):
        np.equal(b, a[i], out=same)
        run[0] = 1
        if i:
            np.add(runs[i - 1, :-1], 1, out=run[1:])
        else:
            run[1:] = 1
        np.multiply(run, same.view(np.uint8), out=run)
        np.maximum.reduce(run, axis=0, out=top[i])
    k, end = np.arange(a.shape[1]), top.argmax(axis=0)
    size = top[end, k]
    right = (runs[end, :, k] == size[:, None]).argmax(axis=1)
    size = size.astype(np.int64)
    return size, end - size + 1, right - size + 1


def _by_diagonals(a: np.ndarray, b: np.ndarray):
    """The longest run along a few diagonals, and whether it is sure to be the longest of all: as long a run covers one of
    the probes of the first text, so that other diagonals, which differ somewhere in each probe, have none."""
    (n, count), m = a.shape, len(b)
    same = np.zeros((n, len(DIAGONALS), count), np.uint8)
    for k, d in enumerate(DIAGONALS):
        lo, hi = max(0, -d), min(n, m - d)
        np.equal(a[lo:hi], b[lo + d : hi + d], out=same[lo:hi, k].view(bool))
    run, top, end = (np.zeros((len(DIAGONALS), count), np.uint8) for _ in range(3))
    for i in range(n):
        np.add(run, 1, out=run)
        np.multiply(run, same[i], out=run)
        np.copyto(end, i, where=run > top)
        np.maximum(top, run, out=top)
    which, k = top.argmax(axis=0), np.arange(count)
    size, left = top[which, k].astype(np.int64), end[which, k].astype(np.int64)
    left -= size - 1
    along = np.array(DIAGONALS)[which]
    least = int(np.partition(size, count // 8)[count // 8])
    sure = size >= least
    if least < 2 * PROBE:
        return np.zeros(count, bool), size, left, left + along
    for at in range(least - PROBE, n - PROBE + 1, least - PROBE + 1):
        lo, hi = -min(at, n - least), m - least - max(0, at + PROBE - least)
        if lo > hi:
            continue
        alive = np.ones((hi - lo + 1, count), bool)
        for i in range(at, at + PROBE):
            alive &= b[i + lo : i + hi + 1] == a[i]
        inside = np.flatnonzero((along >= lo) & (along <= hi))
        alive[along[inside] - lo, inside] = False
        sure &= ~np.logical_or.reduce(alive, axis=0)
        if at >= n - least:
            break
    return sure, size, left, left + along
