"""Suffix-array deduplication with a run-length index (operator 2).

Every byte inside a 50-byte string that also starts in a text with a smaller id goes. Strings that
can repeat are routed to buckets by their minimizer (see ``repeats``). A bucket indexes its distinct
strings, those of a share of its minimizers at a time, by a run-compressed Burrows-Wheeler transform:
runs of equal preceding bytes, the row of each string's last window, and the rows at which the first
50 bytes change. The suffix array itself is dropped. All strings stream through the index from right
to left, from their last window on: a step maps the row of a suffix to the row of the suffix one byte
longer by its run alone. The matching statistic of a window reaches 50 bytes exactly with the windows
of its stretch of rows, so the smallest id of a stretch tells which windows repeat an earlier text.
Copies of whole texts are found by their hash beforehand.

Defined cases: null counts as empty (nothing removed); a null id neither removes nor loses
anything; rows with equal ids are one document (equal texts are expected) and each gets its result
row; an empty table gives an empty result; texts under 50 bytes stay whole; other columns are ignored
by ``remove_repeats`` and passed through by ``deduplicate``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import _MASK, BLOCK_BYTES, blocked, merged, repeated_windows, with_ranges
from .textscan import mix, prefix_hash, range_hash

WINDOW = 50
ANCHOR = 24
SOLVE_BYTES = 512 << 10  # strings indexed at a time; the index takes about 100 bytes a byte of them

FIELDS = "n_bytes long, spans array<array<long>>, kept binary"


def _units(data: np.ndarray, offsets: np.ndarray):
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.arange(max(len(data) - ANCHOR + 1, 0))
    return data, row, range_hash(prefix_hash(data), start, start + ANCHOR), offsets[:-1]


def _strings(data: np.ndarray, begin: np.ndarray, n: np.ndarray):
    """The bytes of super-windows of n windows each."""
    size = n + WINDOW - 1
    shift = np.concatenate([[0], np.cumsum(size)[:-1]])
    return data[np.repeat(begin - shift, size) + np.arange(size.sum())], size


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of strings with ordered terminators.

    ``text``: bytes plus one, each string closed by 0. Row k < number of strings is the row of the
    k-th terminator.
    """

    def __init__(self, text: np.ndarray, strings: int):
        order, row, deep, to_end = self._suffixes(text, strings)
        self.last_window = row[to_end == WINDOW]  # sampled rows: the last window of each string
        before = text[order - 1]  # the byte before each suffix; the first string's is the last terminator
        new = np.concatenate([[True], before[1:] != before[:-1]])
        self.run_start = np.flatnonzero(new)
        self.run_byte = before[self.run_start]
        # row of the first suffix that a run's rows map to
        size = np.diff(np.append(self.run_start, len(order)))
        by_byte = np.argsort(self.run_byte, kind="stable")
        target = np.empty(len(size), np.int64)
        target[by_byte] = np.concatenate([[0], np.cumsum(size[by_byte])[:-1]])
        self.run_target = target
        # stretches of rows whose suffixes share their first WINDOW bytes
        gap = WINDOW - 32
        other = np.where(to_end >= WINDOW, deep[np.minimum(np.arange(len(text)) + gap, len(text) - 1)], -1)
        a, b = deep[order], other[order]
        self.stretch_start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (b[1:] < 0)]))

    @staticmethod
    def _suffixes(text: np.ndarray, strings: int):
        """Suffix order by prefix doubling, the rank at depth 32 and the bytes before the terminator.

        A rank is the first row of the suffixes that are equal so far; only tied ones are sorted on.
        """
        n = len(text)
        stop = np.flatnonzero(text == 0)
        string = np.repeat(np.arange(strings), np.diff(np.concatenate([[0], stop + 1])))
        to_end = stop[string] - np.arange(n)
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        key = np.zeros(n, np.uint64)
        for j in range(8):
            key = key << np.uint64(8) | np.where(j < to_end, padded[j:j + n], 0).astype(np.uint64)
        order, rank = np.arange(n), np.zeros(n, np.int64)
        rows, depth, deep = np.arange(n), 8, None
        while True:
            at = order[rows]
            by = np.argsort(key)
            at, key = at[by], key[by]
            order[rows] = at
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            rank[at] = rows[first]
            if depth == 32:
                deep = rank.copy()
            alone = new & np.append(new[1:], True)
            rows = rows[~alone]
            if not len(rows):
                break
            at = order[rows]
            # a terminator within reach decides by the number of its string
            after = np.where(to_end[at] < depth, string[at], strings + rank[np.minimum(at + depth, n - 1)])
            key = rank[at].astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
            depth *= 2
        return order, rank, rank if deep is None else deep, to_end

    def longer(self, row: np.ndarray) -> np.ndarray:
        """Row of the suffix that is one byte longer than the suffix of each row."""
        run = np.searchsorted(self.run_start, row, side="right") - 1
        return self.run_target[run] + row - self.run_start[run]

    def stretch(self, row: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.stretch_start, row, side="right") - 1


def _hashes(size: np.ndarray, begin: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each super-window and of its minimizer, some of them at a time."""
    key, least = np.empty(len(size), np.uint64), np.empty(len(size), np.uint64)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(begin, begin[a] + SOLVE_BYTES)))
        prefix = prefix_hash(data[begin[a]:begin[b - 1] + size[b - 1]])
        at = begin[a:b] - begin[a]
        key[a:b] = mix(range_hash(prefix, at, at + size[a:b]) + size[a:b].astype(np.uint64))
        low = range_hash(prefix, at, at + ANCHOR) & ~_MASK
        for shift in range(1, WINDOW - ANCHOR + 1):
            low = np.minimum(low, range_hash(prefix, at + shift, at + shift + ANCHOR) & ~_MASK)
        least[a:b] = low
        a = b
    return key, least


def _solve(doc: np.ndarray, n: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For every window of every super-window: the smallest id that has it. Equal windows have equal
    minimizers, so the strings of a share of the minimizers are indexed at a time."""
    size = n + WINDOW - 1
    begin = np.cumsum(size) - size
    key, low = _hashes(size, begin, data)
    shares = max(1, -(-len(data) // SOLVE_BYTES))
    share = (mix(low) % np.uint64(shares)).astype(np.int64)
    order = np.argsort(share, kind="stable")
    cut = np.searchsorted(share[order], np.arange(shares + 1))
    first = np.cumsum(n) - n
    least = np.empty(n.sum(), np.int64)
    for a, b in zip(cut[:-1], cut[1:]):
        o = order[a:b]
        if len(o):
            at = np.repeat(first[o] - np.cumsum(n[o]) + n[o], n[o]) + np.arange(n[o].sum())
            least[at] = _indexed(doc[o], n[o], key[o], begin[o], data)
    return least


def _indexed(doc: np.ndarray, n: np.ndarray, key: np.ndarray, begin: np.ndarray, data: np.ndarray) -> np.ndarray:
    size = n + WINDOW - 1
    # each distinct string once; its key has its hash and length
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    order = np.argsort(-size[first], kind="stable")  # the longest strings first
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    of, first = place[of], first[order]
    length = size[first]
    total = length + 1
    at = np.concatenate([[0], np.cumsum(total)])
    text = np.zeros(at[-1], np.uint8)
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    text[np.repeat(at[:-1], length) + within] = data[np.repeat(begin[first], length) + within] + 1
    index = RunLengthIndex(text, len(first))

    # stream all strings from right to left; a window of a string lies at its number of bytes left
    windows = length - WINDOW + 1
    base = np.concatenate([[0], np.cumsum(windows)])
    stretch = np.zeros(base[-1], np.int64)
    row = index.last_window
    for step in range(WINDOW, int(length[0]) + 1):
        active = int(np.searchsorted(-length, -step, side="right"))
        if step > WINDOW:
            row = index.longer(row[:active])
        stretch[base[:-1][:active] + length[:active] - step] = index.stretch(row[:active])

    of_window = np.repeat(np.arange(len(n)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    met = stretch[base[of[of_window]] + number]
    least = np.full(len(index.stretch_start), np.iinfo(np.int64).max)
    np.minimum.at(least, met, doc[of_window])
    return least[met]


def _finish(data, offsets, starts, ends):
    spans, kept = [], []
    for a, b, s, e in zip(offsets, offsets[1:], starts, ends):
        m = merged(s, e, int(b - a), WINDOW)
        spans.append(m.tolist())
        raw = data[a:b].tobytes()
        cut = [0, *m.ravel().tolist(), len(raw)]
        kept.append(b"".join(raw[cut[i]:cut[i + 1]] for i in range(0, len(cut), 2)))
    return [np.diff(offsets), spans, kept]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row: id, n_bytes, spans (maximal removed byte ranges [start, end)) and the kept bytes."""
    rows, blocks = blocked(docs, id_col, text_col, block_bytes)
    ranges = repeated_windows(rows, blocks, _units, WINDOW, ANCHOR, _strings, np.uint8, _solve)
    return with_ranges(rows, ranges, blocks, _finish, FIELDS)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of docs with the repeats cut from the text; characters that a cut leaves
    in pieces go too. A null text becomes empty."""
    rows, blocks = blocked(docs, id_col, text_col, block_bytes, keep=True)
    ranges = repeated_windows(rows, blocks, _units, WINDOW, ANCHOR, _strings, np.uint8, _solve)

    def finish(data, offsets, starts, ends):
        return [[k.decode("utf-8", "ignore") for k in _finish(data, offsets, starts, ends)[2]]]

    cut = with_ranges(rows, ranges, blocks, finish, "kept string")
    return cut.select(*[F.col("kept").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def digests(removed: DataFrame) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                          F.sha2("kept", 256).alias("kept_sha256"))
