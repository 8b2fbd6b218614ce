"""Numpy core of the byte-level context-tree weighting model (no Spark here).

Texts are byte strings closed by one end symbol.  0xFF, which UTF-8 never
contains, is both that end symbol and the padding in front of a text, so every
coded position has exactly ``depth`` context bytes.

An n-gram key packs ``depth`` context bytes, the most recent one first (most
significant), and the coded byte in the lowest eight bits.  Cutting a key after
``d`` context bytes therefore yields the key of the context of depth ``d``, and
sorting keys groups every subtree of the context tree.

A byte is coded as eight binary decisions; decision node ``v`` (1..255) is the
path of the higher bits behind a leading one.  Each node of that decomposition
has a context tree of its own over the preceding bytes.
"""

from __future__ import annotations

import numpy as np

END = 255
U8 = np.uint64(8)
LOW = np.uint64(0xFF)


def pad_texts(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buffer of all texts between pads, and first position and length (end symbol included) of each."""
    gap = bytes([END]) * depth
    buffer = np.frombuffer(gap + gap.join(texts) + gap, dtype=np.uint8)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    starts = depth + np.concatenate(([0], np.cumsum(lengths + depth)[:-1])) if len(texts) else np.zeros(0, np.int64)
    return buffer, starts.astype(np.int64), lengths + 1


def ngram_keys(buffer: np.ndarray, depth: int) -> np.ndarray:
    """Key of every position from ``depth`` on."""
    n = max(len(buffer) - depth, 0)
    keys = np.zeros(n, dtype=np.uint64)
    for back in range(1, depth + 1):
        keys |= buffer[depth - back : depth - back + n].astype(np.uint64) << np.uint64(8 * (depth - back + 1))
    keys |= buffer[depth : depth + n]
    return keys


def empty_key(depth: int) -> int:
    """Key of the end symbol of an empty text, which pads share."""
    return int.from_bytes(b"\xff" * (depth + 1), "big")


def count_ngrams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order with their counts."""
    buffer, _, _ = pad_texts(texts, depth)
    keys = ngram_keys(buffer, depth)
    keys.sort()
    return fix_pads(*runs(keys), sum(1 for t in texts if not t), depth)


def fix_pads(keys: np.ndarray, counts: np.ndarray, n_empty: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Pads look like ends of empty texts: they go and the true ones are counted."""
    pad = (keys >> np.uint64(8 * depth) == LOW) & (keys & LOW == LOW)
    keys, counts = keys[~pad], counts[~pad]
    if n_empty:
        keys, counts = np.append(keys, np.uint64(empty_key(depth))), np.append(counts, n_empty)
    return keys, counts


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(ordered):
        return ordered, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[first], np.diff(np.append(first, len(ordered)))


def add_up(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    if not len(keys):
        return (keys, *values)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[first], *(np.add.reduceat(v[order], first) for v in values))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series after moving small arguments up."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift[small] -= np.log(y[small])
        y[small] += 1
    inv = 1 / y
    return shift + (y - 0.5) * np.log(y) - y + 0.9189385332046727 + inv * (1 / 12 - inv * inv * (1 / 360 - inv * inv / 1260))


#: ln Gamma(n + 1/2) and ln Gamma(n + 1) for small counts.
SMALL_COUNTS = np.arange(1 << 15)
HALF, WHOLE = log_gamma(SMALL_COUNTS + 0.5), log_gamma(SMALL_COUNTS + 1.0)


def looked_up(values: np.ndarray, counts: np.ndarray, shift: float) -> np.ndarray:
    out = values[np.minimum(counts, len(values) - 1)]
    large = np.flatnonzero(counts >= len(values))
    out[large] = log_gamma(counts[large] + shift)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability."""
    return looked_up(HALF, zeros, 0.5) + looked_up(HALF, ones, 0.5) - looked_up(WHOLE, zeros + ones, 1.0) - np.log(np.pi)


def shorten(keys: np.ndarray) -> np.ndarray:
    """Drop the oldest context byte, keep the low byte (symbol or node)."""
    return ((keys >> np.uint64(16)) << U8) | (keys & LOW)


def nodes_of(keys: np.ndarray, counts: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decision nodes (context, v) behind ``j`` bits under ascending symbol counts: keys (ascending), zeros, ones."""
    symbol = keys & LOW
    at = (keys & ~LOW) | np.uint64(1 << j) | (symbol >> np.uint64(8 - j))
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    ones = np.add.reduceat(counts * ((symbol >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64), first)
    return at[first], np.add.reduceat(counts, first) - ones, ones


def weigh_up(keys: np.ndarray, counts: np.ndarray, depth: int, top: int, children: list | None = None) -> list[dict]:
    """From depth up to ``top``: KT estimate, own weight and log weighted probability of each node.

    ``keys`` ascend.  Per depth, ``nodes`` has a tuple for each number of bits
    already coded: node keys, KT probability of a one, own weight, visits.
    ``children``: (node keys of the next depth cut to this one, their log
    weighted probabilities) for each such number, where that depth was made
    elsewhere.
    """
    levels = []
    for d in range(depth, top - 1, -1):
        if d < depth:
            keys, counts = add_up(shorten(keys), counts)
        nodes, passed = [], []
        for j in range(8 if len(keys) else 0):
            at, zeros, ones = nodes_of(keys, counts, j)
            total = log_kt(zeros, ones)
            weight = np.ones(len(at))
            if children is not None:
                below = np.bincount(np.searchsorted(at, children[j][0]), children[j][1], len(at))
                gap = np.clip(below - total, -700, 700)
                weight = 1 / (1 + np.exp(gap))
                total = total + np.logaddexp(0, gap) - np.log(2)
            nodes.append((at, (ones + 0.5) / (zeros + ones + 1.0), weight, zeros + ones))
            passed.append((at, total))
        levels.append({"depth": d, "keys": keys, "counts": counts, "nodes": nodes, "weighted": passed})
        children = [(shorten(at), total) for at, total in passed]
    return levels


class Model:
    """Frozen mixture: for each depth the probability of a one at every node, contexts cut there."""

    def __init__(self, depth: int):
        self.depth, self.at, self.p1 = depth, {}, {}
        self.left = self.done = None

    def copy(self) -> "Model":
        """A model with the same levels, to which others may be added."""
        out = Model(self.depth)
        out.at, out.p1, out.left, out.done = dict(self.at), dict(self.p1), self.left, self.done
        return out

    def add(self, d: int, parts: list) -> None:
        """The next depth, from 0 on: arrays of node keys, KT probability of a one and weight of the node itself, part by part."""
        at, p1, own = (np.concatenate([np.zeros(0, kind), *(x[i] for x in parts)]) for i, kind in enumerate((np.uint64, np.float64, np.float64)))
        order = np.argsort(at)
        at, p1, own = at[order], p1[order], own[order]
        rest, sure = np.ones(len(at)), np.zeros(len(at))
        if d and len(at):
            up = np.searchsorted(self.at[d - 1], shorten(at))
            rest, sure = self.left[up], self.done[up]
        self.at[d], self.p1[d] = at, sure + rest * p1
        self.done, self.left = sure + rest * own * p1, rest * (1 - own)

    def bits(self, keys: np.ndarray, most: int = 200_000) -> np.ndarray:
        """Code length of each full-depth key: each decision by its deepest node."""
        return np.concatenate([np.zeros(0), *(self._bits(keys[i : i + most]) for i in range(0, len(keys), most))])

    def _bits(self, keys: np.ndarray) -> np.ndarray:
        bits = np.zeros(len(keys))
        context, symbol = keys & ~LOW, keys & LOW
        for j in range(8):
            v = np.uint64(1 << j) | (symbol >> np.uint64(8 - j))
            one = ((symbol >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
            p = np.full(len(keys), 0.5)
            open_, key = np.arange(len(keys)), context | v
            for d in range(self.depth, -1, -1):
                at = self.at[d]
                if len(at):
                    i = np.minimum(np.searchsorted(at, key), len(at) - 1)
                    hit = at[i] == key
                    p[open_[hit]] = self.p1[d][i[hit]]
                    open_, key = open_[~hit], key[~hit]
                if not len(open_):
                    break
                key = shorten(key)
            bits -= np.log2(np.where(one, p, 1 - p))
        return bits


def text_sums(each: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """Sums of the values of each padded text's positions, as ``pad_texts`` and ``ngram_keys`` lay them out."""
    if not len(starts):
        return np.zeros(0)
    each = each.astype(np.float64)
    ends = starts + lengths - depth
    edges = np.stack([starts - depth, np.minimum(ends, len(each) - 1)], 1).ravel()
    sums = np.add.reduceat(each, edges)[::2]
    if ends[-1] == len(each):
        sums[-1] = each[starts[-1] - depth :].sum()
    return sums
