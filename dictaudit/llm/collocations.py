"""Phrase collocations by dynamic itemset counting (operator 12).

Texts become blocks of word numbers once; the blocks are dealt into shards, and the shards are scanned
round and round. Step t scans shard t modulo the number of shards and counts, of every length at once, the
phrases that are active: single words from step 0 on, a longer phrase from the step after both of its
subphrases (without its last word, without its first word) have reached the threshold. Each phrase is
counted for one full cycle from its own start, so once over every shard, and is then complete; phrases that
end a cycle below the threshold are forgotten. The scans end when no phrase is active.

What has reached the threshold is told to the scans as a bit filter of fixed size per step (8 MB; one bit a
phrase). A phrase that shares a bit with one that has reached it starts early, everywhere alike, since the
start of a phrase depends on the filters only; it is still counted over one full cycle, so counts are exact
and the filters only spare work. Nothing else goes through the driver.

Counts are sums of (phrase, count) rows, one a block, added before and after the shuffle; a very frequent
phrase is one row a task. Words are grouped as strings and named by 64-bit hashes of language and word in
the longer phrases. Scores are integer divisions of decimals of 38 digits.

Defined cases: null language is ``und``; null and empty texts have no words; repeated rows count as often
as they occur; a text of any length is read in pieces of about 1 MB (the two words before a piece go along
as context and are not counted again); ties are broken by count, then by the phrase's bytes; an empty table
gives an empty result; columns other than language and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dictaudit.session import materialize, scratch_path

from .textscan import LOWER, mix, runs, text_slices, words

SHARDS = 2
BLOCK_WORDS = 1 << 20
CHUNK_BYTES = 1 << 20
FILTER_BITS = 26  # 2**26 bits for the words, and for the pairs, that reached the threshold by a step
NEVER = 250
SHARES = 64  # parts of a language that are ranked by themselves first
_U = np.uint64

PIECE = np.zeros(256, bool)
PIECE[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
SEPARATOR = PIECE.copy()
SEPARATOR[[0x20, 0x09]] = True

BLOCKS = "shard int, lang string, n_words long, words array<string>, counts array<int>, hashes array<long>, tokens binary"


def _chunks(data: np.ndarray, offsets: np.ndarray):
    """A slice as it is, or a long text in pieces that end between words: (bytes, offsets, number of
    leading words that the piece before has counted)."""
    if len(offsets) > 2 or len(data) <= CHUNK_BYTES:
        yield data, offsets, 0
        return
    start, end, context = 0, 0, 0
    while end < len(data):
        end += CHUNK_BYTES
        while end < len(data):
            hit = np.flatnonzero(SEPARATOR[data[end:end + (1 << 16)]])
            if len(hit):
                end += int(hit[0])
                break
            end += 1 << 16
        end = min(end, len(data))
        yield data[start:end], np.array([0, end - start], np.int64), context
        # the last two words go along with the next piece
        width = 1 << 10
        while True:
            lo = max(start, end - width)
            first, _ = runs(~SEPARATOR[data[lo:end]], np.array([0, end - lo], np.int64))
            if len(first) > 2 or lo == start:
                break
            width *= 4
        context = min(2, len(first))
        start = lo + int(first[-context]) if context else end


class _Block:
    """Words of one language, until they are written as a row."""

    def __init__(self, lang: str):
        self.lang, self.n, self.parts = lang, 0, []

    def add(self, hashes, breaks, context, names):
        self.parts.append((hashes, breaks, context, names))
        self.n += len(hashes)

    def row(self, shard: int) -> list:
        hashes, breaks, context = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        uniq, word = np.unique(hashes, return_inverse=True)
        named, at = np.unique(np.concatenate([p[3][0] for p in self.parts]), return_index=True)
        names = pa.concat_arrays([p[3][1] for p in self.parts]).take(pa.array(at))
        assert len(named) == len(uniq)
        counts = np.bincount(word[~context], minlength=len(uniq)).astype(np.int32)
        # word numbers, -1 between pieces, -2 - number for context
        tokens = np.full(len(word) + int(breaks.sum()), -1, np.int32)
        tokens[np.arange(len(word)) + np.cumsum(breaks)] = np.where(context, -2 - word, word)
        salt = _U(int.from_bytes(hashlib.blake2b(self.lang.encode(), digest_size=8).digest(), "little"))
        return [shard, self.lang, int(counts.sum()), names, counts, mix(uniq ^ salt).view(np.int64), tokens.tobytes()]


def _list(values, kind) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))


def encode(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Blocks of at most about a million words of one language, written by shard."""
    schema = T._parse_datatype_string(BLOCKS)
    arrow = to_arrow_schema(schema)
    block_words = BLOCK_WORDS

    def write(block: _Block, shard: int) -> pa.RecordBatch:
        shard, lang, n, names, counts, hashes, tokens = block.row(shard)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([lang]), pa.array([n], pa.int64()), _list(names, pa.string()),
             _list(counts, pa.int32()), _list(hashes, pa.int64()), pa.array([tokens], pa.binary())], schema=arrow)

    def run(batches):
        held, written = {}, TaskContext.get().partitionId()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b, data, offsets in text_slices(batch.column(1)):
                of_row = np.array(langs[a:b], object)
                names = sorted(set(langs[a:b]))
                code = np.searchsorted(np.array(names, object), of_row)
                for raw, cuts, context in _chunks(data, offsets):
                    low = LOWER[raw]
                    w = words(low, cuts, SEPARATOR)
                    if not len(w.start):
                        continue
                    pieces = np.concatenate([[0], np.cumsum(PIECE[raw], dtype=np.int32)])
                    breaks = np.ones(len(w.start), bool)
                    breaks[1:] = (w.row[1:] != w.row[:-1]) | (pieces[w.start[1:]] != pieces[w.end[:-1]])
                    if context:
                        breaks[0] = True
                    known = np.arange(len(w.start)) < context
                    for k, lang in enumerate(names):
                        at = np.flatnonzero(code[w.row] == k) if len(names) > 1 else np.arange(len(w.start))
                        if not len(at):
                            continue
                        uniq, first = np.unique(w.hash[at], return_index=True)
                        first = at[first]
                        size = w.end[first] - w.start[first]
                        ends = np.cumsum(size)
                        letters = low[np.repeat(w.start[first] - ends + size, size) + np.arange(ends[-1])]
                        text = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()),
                                                           pa.py_buffer(letters.tobytes()))
                        held.setdefault(lang, _Block(lang)).add(w.hash[at], breaks[at], known[at], (uniq, text))
                    full = [x for x, block in held.items() if block.n >= block_words]
                    if sum(block.n for block in held.values()) >= 4 * block_words:
                        full = list(held)
                    for x in full:
                        yield write(held.pop(x), written % shards)
                        written += 1
        for block in held.values():
            yield write(block, written % shards)
            written += 1

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    path = scratch_path(docs.sparkSession, "dic-blocks")
    # few rows a file: a block is megabytes
    rows.mapInArrow(run, schema).write.partitionBy("shard").option("maxRecordsPerFile", 8).parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def bit_filter(keys: DataFrame, position: Column, bits: int) -> np.ndarray:
    """Bit map (2**bits) of the positions of all keys, built by Spark in maps of 4 KB."""
    at = (position.bitwiseAND(F.lit((1 << bits) - 1)) + 1).alias("at")
    maps = keys.select(at).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map")).collect()
    out = np.zeros(max(1, 1 << (bits - 15)) * 4096, np.uint8)
    for r in maps:
        out[(r.bucket - 1) * 4096:r.bucket * 4096] = np.frombuffer(r.map, np.uint8)
    return out


def _reached(position: np.ndarray, filters: list[tuple[int, np.ndarray]], bits: int) -> np.ndarray:
    """The first step whose filter has the bit of each position."""
    at = (position & _U((1 << bits) - 1)).astype(np.int64)
    step = np.full(len(at), NEVER, np.int16)
    for r, found in reversed(filters):
        step[(found[at >> 3] >> (at & 7)) & 1 == 1] = r
    return step


def _pair_position(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first >> _U(17)) ^ second


def _rows_of(batches):
    """Hashes and tokens of each block: (hash of each word number, number at each position or -1, context)."""
    for batch in batches:
        for i in range(len(batch)):
            hashes = np.asarray(batch.column(0)[i].values).view(np.uint64)
            tokens = np.frombuffer(batch.column(1)[i].as_py(), np.int32).astype(np.int64)
            yield hashes, np.where(tokens < -1, -2 - tokens, tokens), tokens < -1


def _pairs(t: int, shards: int, word_filters, bits: int):
    def run(batches):
        for hashes, word, context in _rows_of(batches):
            step = _reached(hashes, word_filters.value, bits)
            a, b = word[:-1], word[1:]
            at = np.flatnonzero((a >= 0) & (b >= 0) & ~context[1:])
            start = np.maximum(step[a[at]], step[b[at]]) + 1
            at = at[(start <= t) & (t < start + shards)]
            key, n = np.unique(a[at] * len(hashes) + b[at], return_counts=True)
            a, b = key // len(hashes), key % len(hashes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[a].view(np.int64)), pa.array(hashes[b].view(np.int64)),
                 pa.array((np.maximum(step[a], step[b]) + 1).astype(np.int32)), pa.array(n.astype(np.int64))],
                ["h1", "h2", "start", "n"])
    return run


def _triples(t: int, shards: int, pair_filters, bits: int):
    def run(batches):
        for hashes, word, context in _rows_of(batches):
            a, b = word[:-1], word[1:]
            step = np.full(len(a), NEVER, np.int16)
            inside = np.flatnonzero((a >= 0) & (b >= 0))
            step[inside] = _reached(_pair_position(hashes[a[inside]], hashes[b[inside]]), pair_filters.value, bits)
            start = np.maximum(step[:-1], step[1:]) + 1
            at = np.flatnonzero((start <= t) & (t < start + shards) & ~context[2:])
            # distinct triples: the numbers of the block's distinct pairs, then the third word
            pair, number = np.unique(a[at] * len(hashes) + b[at], return_inverse=True)
            key, first, n = np.unique(number * len(hashes) + word[at + 2], return_index=True, return_counts=True)
            at = at[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[word[at + k]].view(np.int64)) for k in range(3)]
                + [pa.array(start[at].astype(np.int32)), pa.array(n.astype(np.int64))], ["h1", "h2", "h3", "start", "n"])
    return run


class _Counter:
    """Counts of the active phrases of one length: rows of steps are added to what is not complete."""

    def __init__(self, keys: list[str], shards: int, least: int):
        self.keys, self.shards, self.least, self.open, self.complete = keys, shards, least, None, []

    def add(self, rows: DataFrame, t: int) -> DataFrame:
        """The phrases that have reached the threshold and are not complete before step t."""
        rows = rows if self.open is None else rows.unionByName(self.open)
        ended = F.col("start") + (self.shards - 1) <= t
        state = materialize(rows.groupBy(*self.keys).agg(F.min("start").alias("start"), F.sum("n").alias("n"))
                            .where(~ended | (F.col("n") >= self.least)), "dic-counts")
        self.complete.append(state.where(ended))
        self.open = state.where(~ended)
        return state.where(F.col("n") >= self.least)

    def result(self) -> DataFrame:
        out = self.complete[0]
        for part in self.complete[1:]:
            out = out.unionByName(part)
        return out.drop("start")


def count_phrases(docs: DataFrame, least: int = 10, lang_col: str = "lang", text_col: str = "text", shards: int = SHARDS,
                  filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sizes (lang, n), frequent words (lang, word, h, n), pairs (h1, h2, n) and triples (h1, h2, h3, n)."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    blocks = encode(docs, lang_col, text_col, shards)
    sizes = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    total, word_filters, pair_filters = None, [], []
    pairs, triples = _Counter(["h1", "h2"], shards, least), _Counter(["h1", "h2", "h3"], shards, least)
    last_pairs = 2 * shards - 1  # a word reaches the threshold by step shards - 1, a pair by this one
    sent_words = sent_pairs = None
    for t in range(3 * shards):
        shard = blocks.where(F.col("shard") == t % shards)
        coded = shard.select("hashes", "tokens")
        if t > last_pairs and not pair_filters:
            break
        new_pairs = None
        if 1 <= t <= last_pairs and word_filters:
            sent_words = send(list(word_filters)) if t <= shards else sent_words
            rows = coded.mapInArrow(_pairs(t, shards, sent_words, filter_bits), "h1 long, h2 long, start int, n long")
            new_pairs = pairs.add(rows, t)
        if pair_filters:
            sent_pairs = send(list(pair_filters)) if t <= last_pairs + 1 else sent_pairs
            rows = coded.mapInArrow(_triples(t, shards, sent_pairs, filter_bits), "h1 long, h2 long, h3 long, start int, n long")
            triples.add(rows, t)
        if t < shards:
            counted = (shard.select("lang", F.explode(F.arrays_zip("words", "counts", "hashes")).alias("w"))
                       .select("lang", F.col("w.words").alias("word"), F.col("w.hashes").alias("h"), F.col("w.counts").cast("long").alias("n")))
            total = materialize((counted if total is None else counted.unionByName(total))
                                .groupBy("lang", "word").agg(F.max("h").alias("h"), F.sum("n").alias("n")), "dic-words")
            word_filters.append((t, bit_filter(total.where(F.col("n") >= least), F.col("h"), filter_bits)))
        if new_pairs is not None:
            where = F.shiftrightunsigned("h1", 17).bitwiseXOR(F.col("h2"))
            found = bit_filter(new_pairs, where, filter_bits)
            if found.any():
                pair_filters.append((t, found))
    none = spark.createDataFrame([], "h1 long, h2 long, h3 long, n long")
    return (sizes, total.where(F.col("n") >= least), pairs.result(), triples.result() if triples.complete else none)


def collocations(docs: DataFrame, top: int = 2000, least: int = 10, percent: int = 50, lang_col: str = "lang",
                 text_col: str = "text", **options) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    from pyspark.sql import Window

    sizes, word, pairs, triples = count_phrases(docs, least, lang_col, text_col, **options)

    def named(i: int, also: str | None = None) -> DataFrame:
        return word.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"), F.col("n").alias(f"f{i}"), *([also] if also else []))

    def score(left: str, right: str) -> Column:
        return F.expr(f"(cast(a as decimal(20,0)) * cast(a as decimal(20,0)) * cast(1000000 as decimal(7,0))) "
                      f"div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")

    longer = triples.select("h1", "h2", "n").union(triples.select(F.col("h2"), F.col("h3"), "n")).groupBy("h1", "h2").agg(F.max("n").alias("m"))
    two = (pairs.join(longer, ["h1", "h2"], "left").where(F.coalesce(F.col("m"), F.lit(0)) * 100 < F.col("n") * percent)
           .withColumnRenamed("n", "a").join(named(1, "lang"), "h1").join(named(2), "h2")
           .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("f1", "f2").alias("score")))
    head = pairs.select("h1", "h2", F.col("n").alias("f12"))
    rest = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("n").alias("f23"))
    three = (triples.withColumnRenamed("n", "a").join(head, ["h1", "h2"]).join(rest, ["h2", "h3"])
             .join(named(1, "lang"), "h1").join(named(2), "h2").join(named(3), "h3")
             .withColumn("s1", score("f1", "f23")).withColumn("s2", score("f12", "f3")))
    one = F.col("s1") <= F.col("s2")  # ties go to the shorter first part
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(one, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                         F.when(one, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    # the best of each share of a language first, so that no task ranks all phrases of one
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    best = two.unionByName(three).withColumn("share", F.pmod(F.hash("phrase"), F.lit(SHARES)))
    for by in (["lang", "share"], ["lang"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
