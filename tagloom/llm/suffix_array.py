"""Suffix arrays of one task's text by two-stage sorting.

Stage one sorts directly only the suffixes that are smaller than their successor,
comparing at most ``depth`` bytes. Stage two scans the buckets of first bytes in
order and places every other suffix by the one that follows it (Itoh and Tanaka,
1999). Bucket scans are vectorised: a bucket is moved as a whole.
"""
from __future__ import annotations

import numpy as np


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one is not."""
    n = len(t)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    differ = np.flatnonzero(t[:-1] != t[1:])
    rising = t[:-1][differ] < t[1:][differ]
    at = np.searchsorted(differ, np.arange(n - 1))
    known = at < len(differ)
    out[:-1][known] = rising[at[known]]
    return out


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """Start positions in order of their suffixes, as far as ``depth`` bytes tell."""
    t = np.frombuffer(data, np.uint8)
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    small = smaller_than_next(t)
    direct = np.flatnonzero(small)
    keys = [data[i : i + depth] for i in direct.tolist()]
    direct = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)] if len(direct) else direct
    del keys
    first = t[direct]
    edges = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[-1]].append(np.array([n - 1], np.int64))  # induced by the empty suffix
    out = []
    for c in range(256):
        bucket = []
        batch = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        while len(batch):  # runs of one byte induce within their own bucket
            bucket.append(batch)
            before = batch[batch > 0] - 1
            batch = before[(t[before] == c) & ~small[before]]
        bucket.append(direct[edges[c] : edges[c + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[t[before] > c]
        order = np.argsort(t[before], kind="stable")
        before = before[order]
        byte = t[before]
        cuts = np.flatnonzero(np.diff(byte)) + 1
        for part in np.split(before, cuts):
            if len(part):
                waiting[t[part[0]]].append(part)
    return np.concatenate(out)


def _powers(t: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Rolling hashes of every power-of-two length up to ``most``."""
    h = t.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    out, size = {1: h}, 1
    with np.errstate(over="ignore"):
        factor = np.uint64(0xD6E8FEB86659FD93)
        while size * 2 <= most and len(h) > size:
            h = h[:-size] * factor + h[size:]
            h = h ^ (h >> np.uint64(29))
            factor = factor * factor * np.uint64(3)
            size *= 2
            out[size] = h
    return out


def adjacent_common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to ``most`` bytes, of each suffix in ``sa`` with the one before it."""
    out = np.zeros(len(sa), np.int64)
    if len(sa) < 2:
        return out
    hashes = _powers(t, most)
    a, b = sa[:-1].copy(), sa[1:].copy()
    got = np.zeros(len(a), np.int64)
    for size in sorted(hashes, reverse=True):
        h = hashes[size]
        for _ in range(max(1, most // size) if size == max(hashes) else 1):
            ok = (a < len(h)) & (b < len(h)) & (got + size <= most)
            at = np.flatnonzero(ok)
            at = at[h[a[at]] == h[b[at]]]
            got[at] += size
            a[at] += size
            b[at] += size
    out[1:] = got
    return out


def _window_hashes(t: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` units from each position of ``at``."""
    powers, out, done = _powers(t, length), np.zeros(len(at), np.uint64), 0
    with np.errstate(over="ignore"):
        for size in sorted(powers, reverse=True):
            while done + size <= length:
                out = out * np.uint64(0x9E3779B97F4A7C15) + powers[size][at + done]
                out ^= out >> np.uint64(32)
                done += size
    return out


def repeated_starts(t: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the start positions ``valid`` (each with ``length`` units to go), whether the
    string of that length also starts at another of them; and for each a number that
    equal strings share. Adjacent common prefixes decide, the units confirm. Wider
    units are sorted by their lowest byte; strings that only differ above it are
    then told apart by a hash."""
    low = t if t.dtype == np.uint8 else (t & 0xFF).astype(np.uint8)
    sa = suffix_array(low.tobytes(), length)
    is_valid = np.zeros(len(t), bool)
    is_valid[valid] = True
    sa = sa[is_valid[sa]]
    same = adjacent_common_prefixes(low, sa, length) >= length
    if t.dtype != np.uint8:
        alike = same.copy()
        alike[:-1] |= same[1:]
        at = np.flatnonzero(alike)
        h = _window_hashes(t, sa[at], length)
        order = np.lexsort((h, np.cumsum(~same)[at]))
        sa[at], h = sa[at][order], h[order]
        whole = np.zeros(len(sa), np.uint64)
        whole[at] = h
        same[1:] &= whole[1:] == whole[:-1]
    for at in np.array_split(np.flatnonzero(same), max(1, int(same.sum()) * length // (1 << 24))):
        spread = np.arange(length)
        equal = (t[sa[at][:, None] + spread] == t[sa[at - 1][:, None] + spread]).all(axis=1)
        same[at] = equal
    repeated = same.copy()
    repeated[:-1] |= same[1:]
    group = np.cumsum(~same)
    out, names = np.zeros(len(t), bool), np.zeros(len(t), np.int64)
    out[sa], names[sa] = repeated, group
    return out[valid], names[valid]
