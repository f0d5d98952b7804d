"""Language-model scores from a weighted backoff automaton (operator 10).

The model is a word bigram model with Dirichlet smoothing over an add-one unigram model:

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | u) = (c(u w) + k p(w)) / (c(u) + k)

Seen pairs are arcs of the automaton. From the state of word u, a word without an arc takes the
failure arc of weight k / (c(u) + k) to the empty state, whose arcs carry p(w). One traversal from
left to right carries the state and adds log10 weights; every text ends with an end token.

Counts cover all training texts, nothing is pruned, and no model is held in one place. Documents are
dealt into blocks of bounded size by the hash of their id. Each block sends its distinct words and
pairs with their training counts, sorted and cut by key range, as packed arrays; the task of a key
range adds the counts of all blocks and answers each block with the totals of the block's own keys.
A block's texts then meet the totals that they need: the part of the automaton they can reach.

Defined cases: null and empty texts consist of the end token; a row without id is scored but not
learned; repeated rows count and are scored each; an empty table gives an empty result; without
training rows all words are unknown; columns other than id, text and the training flag are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dictaudit.session import materialize

from .textscan import LOWER, mix, text_slices, words

BLOCK_BYTES = 8 << 20
SMOOTHING = 200.0
_U = np.uint64
END = mix(np.array([0x454E44], np.uint64))[0]
START = mix(np.array([0x535441525400], np.uint64))[0]

KEYS = "block long, part long, words binary, word_counts binary, pairs binary, pair_counts binary"
TOTALS = "block long, part long, words binary, pairs binary, n long, v long"


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token (words in order, then the end token of each text) and its text."""
    hashes, rows = [], []
    for a, b, data, offsets in text_slices(texts):
        w = words(LOWER[data], offsets)
        # an end token after the words of each text
        row = np.concatenate([w.row, np.arange(b - a)])
        order = np.argsort(row, kind="stable")
        hashes.append(np.concatenate([w.hash, np.full(b - a, END)])[order])
        rows.append(row[order] + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def _contexts(token: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The token before each token; START before the first."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.concatenate([[True], row[1:] != row[:-1]])[:len(row)]] = START
    return before


def _block_keys(token: np.ndarray, row: np.ndarray):
    """Distinct words and pairs of a block with the number of each token's word, context and pair."""
    before = _contexts(token, row)
    word, w_at = np.unique(token, return_inverse=True)
    pair, p_at = np.unique(mix(before * _U(0xD6E8FEB86659FD93) + token), return_inverse=True)
    return word, w_at, pair, p_at, before


def _send(parts: int):
    bounds = np.array([(1 << 64) // parts * i for i in range(1, parts)], np.uint64)

    def cut(keys):
        return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]).astype(np.int64)

    def send(t: pa.Table) -> pa.Table:
        token, row = _tokens(t.column("text"))
        train = t.column("train").to_numpy().astype(bool)[row]
        word, w_at, pair, p_at, _ = _block_keys(token, row)
        wc = np.bincount(w_at[train], minlength=len(word)).astype(np.uint32)
        pc = np.bincount(p_at[train], minlength=len(pair)).astype(np.uint32)
        cw, cp = cut(word), cut(pair)
        return pa.table({
            "block": pa.array([t.column("block")[0].as_py()] * parts, pa.int64()), "part": pa.array(range(parts), pa.int64()),
            "words": [word[a:b].tobytes() for a, b in zip(cw, cw[1:])],
            "word_counts": [wc[a:b].tobytes() for a, b in zip(cw, cw[1:])],
            "pairs": [pair[a:b].tobytes() for a, b in zip(cp, cp[1:])],
            "pair_counts": [pc[a:b].tobytes() for a, b in zip(cp, cp[1:])]})
    return send


def _add(t: pa.Table) -> pa.Table:
    """Totals of a key range, returned to each block in the order of its own keys."""
    def totals(keys, counts):
        k = [np.frombuffer(x, np.uint64) for x in t.column(keys).to_pylist()]
        c = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column(counts).to_pylist()])
        uniq, at = np.unique(np.concatenate(k), return_inverse=True)
        total = np.bincount(at, c, len(uniq)).astype(np.int64)
        ends = np.cumsum([0] + [len(x) for x in k])
        each = total[at]
        return [each[a:b].tobytes() for a, b in zip(ends, ends[1:])], total

    words_, total = totals("words", "word_counts")
    pairs_, _ = totals("pairs", "pair_counts")
    n = len(t)
    return pa.table({"block": t.column("block"), "part": t.column("part"), "words": words_, "pairs": pairs_,
                     "n": pa.array([int(total.sum())] + [0] * (n - 1), pa.int64()),
                     "v": pa.array([int((total > 0).sum())] + [0] * (n - 1), pa.int64())})


class Automaton:
    """The part of the backoff automaton that a block's texts can reach; weights are log10."""

    def __init__(self, word_totals: np.ndarray, pair_totals: np.ndarray, context_totals: np.ndarray,
                 pair_word: np.ndarray, pair_context: np.ndarray, n: int, v: int, k: float):
        unigram = (word_totals + 1) / (n + v + 1)
        self.arc_of_empty = np.log10(unigram)
        self.failure = np.log10(k / (context_totals + k))
        seen = (pair_totals + k * unigram[pair_word]) / (context_totals[pair_context] + k)
        self.has_arc = pair_totals > 0
        self.arc = np.log10(seen)

    def traverse(self, word: np.ndarray, context: np.ndarray, pair: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Sum of weights of each text. After any token the state is that token's state, so the
        state before a token is its context: the arc if there is one, else the failure arc and the
        arc of the empty state."""
        step = np.where(self.has_arc[pair], self.arc[pair], self.failure[context] + self.arc_of_empty[word])
        return np.bincount(row, step, rows)


def _score(n: int, v: int, n_texts: int, k: float):
    def score(docs: pa.Table, totals: pa.Table) -> pa.Table:
        totals = totals.sort_by("part")
        token, row = _tokens(docs.column("text"))
        word, w_at, pair, p_at, before = _block_keys(token, row)
        read = lambda c: np.frombuffer(b"".join(totals.column(c).to_pylist()), np.int64)
        wt, pt = read("words"), read("pairs")
        # contexts: the block's words, and the start, which every training text has once
        start = len(word)
        c_at = np.where(before == START, start, np.searchsorted(word, before).clip(0, max(start - 1, 0)))
        first = np.zeros(len(pair), np.int64)
        first[p_at] = np.arange(len(p_at))
        automaton = Automaton(wt, pt, np.append(wt, n_texts), w_at[first], c_at[first], n, v, k)
        rows = len(docs)
        return pa.table({
            "doc_id": docs.column("doc_id"),
            "n_tokens": pa.array(np.bincount(row, minlength=rows), pa.int64()),
            "n_known": pa.array(np.bincount(row, wt[w_at] > 0, rows).astype(np.int64)),
            "train_tokens": pa.array(np.full(rows, n), pa.int64()),
            "base_score": pa.array(np.bincount(row, automaton.arc_of_empty[w_at], rows)),
            "score": pa.array(automaton.traverse(w_at, c_at, p_at, row, rows))})
    return score


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
                smoothing: float = SMOOTHING, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row: id, n_tokens, n_known, train_tokens, base_score and score. ``train`` marks
    the rows to learn from."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    size, n_texts = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)),
                             F.coalesce(F.sum(F.col("train").cast("int")), F.lit(0))).first()
    blocks = max(1, -(-size // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    sent = rows.repartition(blocks, "block").groupBy("block").applyInArrow(_send(blocks), KEYS)
    totals = materialize(sent.repartition(blocks, "part").groupBy("part").applyInArrow(_add, TOTALS), "lm-totals")
    n, v = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    left, right = rows.repartition(blocks, "block"), totals.drop("n", "v").repartition(blocks, "block")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(
        _score(n, v, n_texts, smoothing),
        "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
