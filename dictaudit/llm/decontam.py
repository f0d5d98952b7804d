"""Benchmark decontamination by a prefix-filtered set join (operator 8).

Every benchmark item gives windows of 13 consecutive words (a shorter item one window of all its
words). A window is the set of its word 3-shingles with their offsets. Containment needs every
shingle, so one necessary prefix token per window is enough: shingles are ordered by how often they
occur in the documents, the rarest one is joined with the documents' shingles, the length and
positional bounds (does a window placed there fit into the text?) cut candidates, and the words of
the surviving windows are compared one by one.

The benchmark is taken in blocks of at most ``block_words`` words (one longer item makes a block of
its own), which bounds what is broadcast; documents are scanned per block and never shuffled whole.

Defined cases: null and empty texts have no words and no hits; items without words give no window;
rows equal in id and text give one result row; an empty documents table gives an empty result, an
empty benchmark no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictaudit.session import materialize

from .apply import fresh, per_text_rows, ship, shipped
from .textscan import LOWER, ngram_hash, same_row, signed, words

WINDOW = 13
SHINGLE = 3
BLOCK_WORDS = 1_000_000

NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[0x30:0x3A] = NOT_WORD[0x61:0x7B] = NOT_WORD[0x80:] = False


def _words(data, offsets):
    return words(LOWER[data], offsets, NOT_WORD)


class Block:
    """Windows of a block of items: word hashes, and the shingle table."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.hash = np.concatenate([h for _, h in items]) if items else np.zeros(0, np.uint64)
        self.item_ids = [i for i, _ in items]
        start, length, item, base = [], [], [], 0
        for k, (_, h) in enumerate(items):
            n = len(h)
            m = max(n - window + 1, 1) if n else 0
            start.append(base + np.arange(m))
            length.append(np.full(m, min(n, window)))
            item.append(np.full(m, k))
            base += n
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        self.start, self.length, self.item = join(start), join(length), join(item)
        # shingle hashes at every word, by shingle size (windows of one or two words have smaller ones)
        self.grams = {k: np.pad(ngram_hash(self.hash, k), (0, max(0, min(k - 1, len(self.hash))))) for k in (1, 2, SHINGLE)}

    def shingle_size(self) -> np.ndarray:
        return np.minimum(self.length, SHINGLE)

    def shingles(self) -> dict[int, np.ndarray]:
        """Distinct shingle hashes of the windows, by shingle size."""
        out = {}
        for k in (1, 2, SHINGLE):
            sel = self.shingle_size() == k
            pos = [self.start[sel] + o for o in range(WINDOW_MAX(self.length[sel]) - k + 1)] if sel.any() else []
            ok = [p[o + k <= self.length[sel]] for o, p in enumerate(pos)]
            out[k] = np.unique(self.grams[k][np.concatenate(ok)]) if ok else np.zeros(0, np.uint64)
        return out

    def prefixes(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple]:
        """Per shingle size: sorted prefix tokens, and for each the windows it stands for with its
        offset in them. Windows with a shingle that no document has are left out."""
        out = {}
        for k, (keys, count) in counts.items():
            sel = np.flatnonzero(self.shingle_size() == k)
            if not len(sel) or not len(keys):
                continue
            best = np.full(len(sel), np.iinfo(np.int64).max)
            offset = np.zeros(len(sel), np.int64)
            for o in range(WINDOW_MAX(self.length[sel]) - k + 1):
                inside = o + k <= self.length[sel]
                at = np.minimum(self.start[sel] + o, len(self.hash) - 1)
                c = np.where(inside, count[np.searchsorted(keys, self.grams[k][at]).clip(0, len(keys) - 1)], best)
                better = c < best
                best[better], offset[better] = c[better], o
            sel, offset = sel[best > 0], offset[best > 0]
            token = self.grams[k][self.start[sel] + offset]
            order = np.argsort(token, kind="stable")
            uniq, first = np.unique(token[order], return_index=True)
            out[k] = (uniq, np.append(first, len(order)), sel[order], offset[order])
        return out


def WINDOW_MAX(lengths: np.ndarray) -> int:
    return int(lengths.max()) if len(lengths) else 0


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int, window: int):
    """Blocks of items; a block's word hashes reach the driver, never the whole table at once."""
    def make():
        def f(ids, data, offsets, texts):
            w = _words(data, offsets)
            bounds = np.searchsorted(w.row, np.arange(len(offsets)))
            return [ids, bounds[1:] - bounds[:-1], [w.hash[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]]
        return f

    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    numbered = items.where("text is not null").select(
        "item_id", "text").dropDuplicates()
    hashes = per_item(numbered, make)
    block, n_words = [], 0
    for row in hashes.toLocalIterator():
        if n_words and n_words + row.n > block_words:
            yield Block(block, window)
            block, n_words = [], 0
        if row.n:
            block.append((row.item_id, np.frombuffer(row.hashes, np.uint64)))
            n_words += row.n
    if block:
        yield Block(block, window)


def per_item(items: DataFrame, make) -> DataFrame:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    from .textscan import text_slices

    schema = "item_id string, n int, hashes binary"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        f = make()
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                ids, n, h = f(batch.column(0).slice(a, b - a), data, offsets, None)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int32()), pa.array(h, pa.binary())], schema=arrow)

    return items.mapInArrow(run, schema)


def _counts(docs: DataFrame, shingles, id_col: str, text_col: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """How often each of a block's shingles occurs in the documents; as many rows as shingles."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(shingles)

    def make():
        def f(ids, data, offsets, texts):
            w, size, key, num = _words(data, offsets), [], [], []
            for k, keys in held.value.items():
                if not len(keys):
                    continue
                g = ngram_hash(w.hash, k)[same_row(w.row, k)]
                at = np.searchsorted(keys, g).clip(0, len(keys) - 1)
                c = np.bincount(at[keys[at] == g], minlength=len(keys))
                there = np.flatnonzero(c)
                size.append(np.full(len(there), k))
                key.append(signed(keys[there]))
                num.append(c[there])
            return [np.concatenate(x) if x else [] for x in (size, key, num)]
        return f

    got = (per_text_rows(docs, "k int, key long, n long", make, id_col, text_col)
           .groupBy("k", "key").agg(F.sum("n").alias("n")).collect())
    out = {}
    for k, keys in shingles.items():
        count = np.zeros(len(keys), np.int64)
        mine = [r for r in got if r.k == k]
        count[np.searchsorted(keys, np.array([r.key for r in mine], np.int64).view(np.uint64))] = [r.n for r in mine]
        out[k] = (keys, count)
    return out


def _verified(w, row_end, prefixes, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Word starts and window numbers of all exact occurrences in a slice."""
    starts, wins = [], []
    for k, (keys, first, window, offset) in prefixes.items():
        if not len(keys) or not len(w.hash):
            continue
        g = ngram_hash(w.hash, k)
        at = np.searchsorted(keys, g).clip(0, len(keys) - 1)
        hit = np.flatnonzero((keys[at] == g) & same_row(w.row, k))
        token = at[hit]
        n = first[token + 1] - first[token]
        pick = np.repeat(first[token] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum())
        pos = np.repeat(hit, n)
        win, start = window[pick], pos - offset[pick]
        # positional and length bounds: the whole window lies inside the row of the joined token
        size = block.length[win]
        ok = (start >= 0) & (start + size <= row_end[w.row[pos]])
        start, win, size, pos = start[ok], win[ok], size[ok], pos[ok]
        ok = w.row[start] == w.row[pos]
        start, win, size = start[ok], win[ok], size[ok]
        for o in range(WINDOW_MAX(size)):
            same = (o >= size) | (w.hash[np.minimum(start + o, len(w.hash) - 1)]
                                  == block.hash[np.minimum(block.start[win] + o, len(block.hash) - 1)])
            start, win, size = start[same], win[same], size[same]
        starts.append(start)
        wins.append(win)
    z = np.zeros(0, np.int64)
    return (np.concatenate(starts), np.concatenate(wins)) if starts else (z, z)


def _scan(docs: DataFrame, block: Block | None, prefixes, id_col: str, text_col: str) -> DataFrame:
    """Per document: words, hit ranges (start, end) of words, items found in this block."""
    held = ship(docs.sparkSession, (block, prefixes))

    def make():
        block, prefixes = shipped(held)

        def f(ids, data, offsets, texts):
            n = len(offsets) - 1
            w = _words(data, offsets)
            bounds = np.searchsorted(w.row, np.arange(n + 1))
            ranges, items = [[] for _ in range(n)], [[] for _ in range(n)]
            if prefixes:
                start, win = _verified(w, bounds[1:], prefixes, block)
                row = w.row[start]
                order = np.argsort(row, kind="stable")
                start, win, row = start[order], win[order], row[order]
                rows, first = np.unique(row, return_index=True)
                for r, a, b in zip(rows, first, [*first[1:], len(row)]):
                    size = bounds[r + 1] - bounds[r]
                    hit = np.zeros(size + 2, np.int64)
                    s = start[a:b] - bounds[r]
                    np.add.at(hit, s, 1)
                    np.add.at(hit, s + block.length[win[a:b]], -1)
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(hit) > 0])))
                    ranges[r] = edge.reshape(-1, 2).tolist()
                    items[r] = [block.item_ids[k] for k in np.unique(block.item[win[a:b]])]
            fp = [hashlib.md5(data[a:b]).digest() for a, b in zip(offsets, offsets[1:])]
            return [ids, fp, bounds[1:] - bounds[:-1], ranges, items]
        return f

    return per_text_rows(docs, "doc_id long, fp binary, n_words long, ranges array<array<long>>, items array<string>", make,
                         id_col, text_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  block_words: int = BLOCK_WORDS, min_share_percent: int = 5) -> DataFrame:
    """One row per document: id, text fingerprint, words, hit words, items with windows in the text
    and whether at least ``min_share_percent`` of the words are hit."""
    parts = []
    for block in _blocks(benchmark, item_id_col, item_text_col, block_words, window):
        counts = _counts(docs, block.shingles(), id_col, text_col)
        parts.append(_scan(docs, block, block.prefixes(counts), id_col, text_col))
    if not parts:
        parts = [_scan(docs, None, {}, id_col, text_col)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    merged = found.groupBy("doc_id", "fp").agg(
        (F.count("*") / len(parts)).cast("long").alias("rows"), F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set("ranges"))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # rows that share id and text have one verdict, each its own row
    page = 4096
    pages = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"), F.lit(page).cast("long")))
    merged = merged.withColumn("page", pages).withColumn(
        "page", F.explode(F.sequence("page", F.least("rows", F.col("page") + (page - 1)))))
    return _finish(merged, min_share_percent)


def _finish(merged: DataFrame, percent: int) -> DataFrame:
    """Union of the blocks' hit ranges of a document and its figures."""
    zero = F.lit(0).cast("long")
    hit = F.aggregate(
        "ranges", F.struct(zero.alias("n"), zero.alias("to")),
        lambda s, p: F.struct((s.n + F.greatest(zero, p[1] - F.greatest(p[0], s.to))).alias("n"),
                              F.greatest(s.to, p[1]).alias("to")), lambda s: s.n)
    return (merged.withColumn("n_hit", hit)
            .select("doc_id", "fp", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
                    ((F.col("n_hit") > 0) & (F.lit(100) * F.col("n_hit") >= F.lit(percent) * F.col("n_words")))
                    .alias("contaminated")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                        **kw) -> DataFrame:
    """The rows of documents that are not contaminated, with all columns."""
    own, print_ = fresh(docs, "bad_id"), fresh(docs, "bad_fp")
    bad = materialize(decontaminate(docs, benchmark, id_col, text_col, **kw).where("contaminated").select(
        F.col("doc_id").alias(own), F.col("fp").alias(print_)).distinct(), "contaminated")
    fp = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col(own)) & fp.eqNullSafe(F.col(print_)), "left_anti")
