"""Substring deduplication over a compacted de Bruijn graph of word windows (operator 3).

Every word inside a window of 13 words that also starts in a text with a smaller id goes. Windows
are the edges of a de Bruijn graph (its nodes are the 12 words that neighbouring windows share).
Edges that can repeat meet in buckets by their minimizer; there each edge gets its source, the
smallest id that has it. Neighbouring edges of a super-window with one source go back to the blocks
as one path, and a block puts the paths of a text together (see ``repeats``). Neither the nodes'
degrees nor the branches of the graph are computed: whether an edge repeats does not depend on them.

Defined cases: null has no words; a null id neither removes nor loses anything; rows with equal ids
are one document (equal texts are expected) and each gets its result row; an empty table gives an
empty result; texts under 13 words stay whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import BLOCK_BYTES, blocked, merged, repeated_windows, with_ranges
from .textscan import ngram_hash, words

WINDOW = 13
ANCHOR = 4

FIELDS = "n_words long, spans array<array<long>>, kept string"


def _units(data: np.ndarray, offsets: np.ndarray):
    w = words(data, offsets)
    return w.hash, w.row, ngram_hash(w.hash, ANCHOR), np.searchsorted(w.row, np.arange(len(offsets) - 1))


def _edges(unit: np.ndarray, begin: np.ndarray, n: np.ndarray):
    """Edge hashes of super-windows of n windows each."""
    edge = ngram_hash(unit, WINDOW)
    shift = np.concatenate([[0], np.cumsum(n)[:-1]])
    return edge[np.repeat(begin - shift, n) + np.arange(n.sum())], n


def _solve(doc: np.ndarray, n: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """For every edge of every super-window: its source, the smallest id that has it."""
    if not len(doc):
        return np.zeros(0, np.int64)
    own = np.repeat(doc, n)
    _, of = np.unique(edge, return_inverse=True)
    least = np.full(int(of.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, of, own)
    return least[of]


def _finish(data, offsets, starts, ends):
    w = words(data, offsets)
    bounds = np.searchsorted(w.row, np.arange(len(offsets)))
    raw = data.tobytes()
    spans, kept = [], []
    for a, b, s, e in zip(bounds, bounds[1:], starts, ends):
        m = merged(s, e, int(b - a), WINDOW)
        spans.append(m.tolist())
        keep = np.ones(b - a, bool)
        for x, y in m:
            keep[x:y] = False
        at = a + np.flatnonzero(keep)
        kept.append(b" ".join([raw[x:y] for x, y in zip(w.start[at].tolist(), w.end[at].tolist())]).decode())
    return [np.diff(bounds), spans, kept]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row: id, n_words, spans (maximal removed word ranges [start, end)) and the kept
    words joined by single spaces."""
    rows, blocks = blocked(docs, id_col, text_col, block_bytes)
    ranges = repeated_windows(rows, blocks, _units, WINDOW, ANCHOR, _edges, np.uint64, _solve)
    return with_ranges(rows, ranges, blocks, _finish, FIELDS)


def digests(removed: DataFrame) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return removed.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
