"""Repeated strings by merging the Burrows-Wheeler transforms of shards.

A shard's transform is built once. Shards are merged by refining their interleaving: after k rounds it is the order
by the first k bytes, found from the transforms alone by one stable counting sort a round; no suffixes are sorted
again. A border between two neighbours appears in the round after their common prefix ends, which gives the common
prefixes; what is still together after ``length`` rounds repeats.
"""

from __future__ import annotations

import numpy as np


def transform(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols before each suffix, suffix starts) of a shard, in the order of the suffixes' first ``length`` bytes.

    Texts are joined with one end mark (symbol 0) each; a text's bytes are symbols 1 to 256. Ends sort first, by text.
    """
    data = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.uint16) + 1, np.uint16(0)) for t in texts] or [np.zeros(0, np.uint16)])
    n = len(data)
    rank = data.astype(np.int64)
    rank[data == 0] = np.arange((data == 0).sum()) - (data == 0).sum()  # ends differ
    order = np.argsort(rank, kind="stable")
    rank = _numbered(rank[order], order)
    k = 1
    while k < length and n and rank[order[-1]] < n - 1:
        ahead = np.full(n, -1)
        ahead[: n - k] = rank[k:]
        key = rank * (n + 1) + ahead + 1
        order = np.argsort(key, kind="stable")
        rank = _numbered(key[order], order)
        k *= 2
    return data[order - 1], order


def _numbered(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.append(0, keys[1:] != keys[:-1])) if len(keys) else keys
    return out


def merge(shards: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each place, common prefix with the place before) of the merged transforms.

    Common prefixes are given up to ``length``. Ends of texts are taken to differ, in the order of the shards.
    """
    n = sum(map(len, shards))
    of = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint32), [len(s) for s in shards])
    common = np.full(n, length, np.int32)
    border = np.zeros(n, bool)
    border[:1] = True
    common[:1] = 0
    symbols = np.empty(n, np.uint16)
    for k in range(length):
        for s, symbol in enumerate(shards):
            symbols[of == s] = symbol
        to = np.argsort(symbols, kind="stable")  # a counting sort
        of = of[to]
        sorted_symbols = symbols[to]
        group = np.cumsum(border)[to]
        new = np.append(True, (sorted_symbols[1:] != sorted_symbols[:-1]) | (group[1:] != group[:-1]) | (sorted_symbols[1:] == 0))[:n]
        common[new & (common == length)] = k
        done = bool(new.all())
        border = new
        if done:
            break
    return of, common


def repeated(shards: list[list[bytes]], length: int) -> list[tuple[int, int, int]]:
    """(shard, text, start) of every string of ``length`` bytes that starts in more than one place."""
    made = [transform(s, length) for s in shards]
    of, common = merge([m[0] for m in made], length)
    together = common >= length
    together[:-1] |= together[1:]
    out = []
    for s, (texts, (_, order)) in enumerate(zip(shards, made)):
        at = order[together[of == s]]  # places of a shard keep their order in the merge
        ends = np.cumsum([len(t) + 1 for t in texts])
        text = np.searchsorted(ends, at, side="right")
        out += [(s, int(t), int(p)) for t, p in zip(text, at - np.append(0, ends)[text])]
    return out
