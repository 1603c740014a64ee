"""Smallest md5 hashes of gapped k-mers for whole batches of reads: a word is hashed once a batch, not once a read.

The same values as ``kmers.gapped_min_hashes`` with ``kmers.hash_md5``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The key of reads too short for any word.
SHORT = "0"


def _words(letters: np.ndarray, q: int, k: int) -> np.ndarray:
    """Numbers of the gapped k-mers of rows of letters (numbers below ``q``), by start; equal words have equal numbers."""
    n = letters.shape[1] - 2 * k + 2
    code, most = np.zeros((len(letters), n), dtype=np.int64), 1
    for j in range(k):
        if most * q * (n + 1) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1].reshape(code.shape)
            most = code.size
        code, most = code * q + letters[:, 2 * j : 2 * j + n], most * q
    return code


def min_hashes(texts: pa.Array, k: int, seeds: list[int]) -> pa.Array:
    """For each text a list of as many keys as there are seeds."""
    texts = pc.fill_null(texts, "")
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    alphabet, letters = np.unique(np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4"), return_inverse=True)
    hashes, at = [SHORT], np.zeros((len(sizes), len(seeds)), dtype=np.int64)
    known: dict[str, int] = {}
    found = []
    for size in np.unique(sizes[sizes >= 2 * k - 1]).tolist():
        rows = np.flatnonzero(sizes == size)
        own = letters[starts[rows][:, None] + np.arange(size)]
        code = _words(own, len(alphabet), k)
        n = code.shape[1]
        # in the stable order equal words are runs, and a place in a run is the occurrence
        order = np.argsort(code, axis=1, kind="stable")
        code, place = np.take_along_axis(code, order, axis=1), np.arange(n)
        head = np.zeros(code.shape, dtype=np.int64)
        head[:, 1:] = np.where(code[:, 1:] != code[:, :-1], place[1:], 0)
        occ = place - np.maximum.accumulate(head, axis=1) + 1
        _, first, number = np.unique(code * (n + 1) + occ, return_index=True, return_inverse=True)
        row, start = first // n, order.ravel()[first]
        words = alphabet[own[row[:, None], start[:, None] + 2 * np.arange(k)]].astype("<u4")
        told = [f"{w.tobytes().decode('utf-32-le')}|{o}" for w, o in zip(words, occ.ravel()[first].tolist(), strict=True)]
        numbers = np.array([known.setdefault(x, len(known)) for x in told], dtype=np.int64)
        found.append((rows, numbers[number.reshape(code.shape)]))
    for i, seed in enumerate(seeds if found else []):
        made = np.array([hashlib.md5(f"{seed}|{x}".encode()).hexdigest() for x in known])
        by_hash = np.argsort(made)
        rank = np.empty(len(made), dtype=np.int64)
        rank[by_hash] = np.arange(len(made))
        for rows, numbers in found:
            at[rows, i] = len(hashes) + rank[numbers].min(axis=1)
        hashes += made[by_hash].tolist()
    offsets = np.arange(len(sizes) + 1, dtype=np.int32) * len(seeds)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes).take(pa.array(at.ravel())))
