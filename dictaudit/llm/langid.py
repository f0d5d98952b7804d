"""Language identification by cross-parsing entropy (operator 4).

Each language has a suffix automaton over a bounded sample of its labelled text. A text is parsed
greedily into the longest phrases that occur in a language's sample; the language that needs the
fewest phrases, weighted by the bits of a phrase (log2 of the sample's length), wins.

The sample is bounded by documented parameters: ``texts_per_lang`` labelled rows of each language
(those with the smallest hash of their id) and ``symbols_per_lang`` symbols of them. Each sampled text
gives an equal share of the symbols, in windows of ``SAMPLE_WINDOW`` symbols spread by hash over the whole
text; a text shorter than its share gives all it has, and the others share what it leaves. Both
bounds are reached if the language has that many labelled rows with letters and they have that many symbols. The sample travels by
broadcast (languages x symbols); tasks build the automata as one table and step through many texts and
all languages at once. Whole texts are parsed, in segments of ``SEGMENT`` symbols (phrases do not
cross segment borders, for no language).

Symbols: letters in lower case; a run of anything else counts as one blank. Every letter of a
language's sample has a code in that language; only letters that its sample lacks match nothing there.

Defined cases: null texts and texts without a letter get ``und`` and score 0; without labelled rows
every text does; ties go to the first language in alphabetic order; an empty table gives an empty
result; repeated rows give repeated results; other columns are ignored. The score is the share of
the winner when each language weighs 2 to the minus its bits per text.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .apply import per_text

TEXTS_PER_LANG = 48
SYMBOLS_PER_LANG = 24_000
SAMPLE_WINDOW = 100
SEGMENT = 1024
DENSE = 64  # symbols of a language that have a column of their own
UNKNOWN = "und"


def sample(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           texts_per_lang: int = TEXTS_PER_LANG, symbols_per_lang: int = SYMBOLS_PER_LANG) -> dict[str, str]:
    """Sample text of each language; rows without language or text do not count."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"), "text"))
    rows = (labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                            F.col(text_col).cast("string").alias("text"))
            .where("lang is not null").where(F.col("text").rlike("\\p{L}"))
            .withColumn("rank", rank).where(F.col("rank") <= texts_per_lang)
            .select("lang", "rank", _windows(symbols_per_lang)("text").alias("windows")).collect())
    out: dict[str, str] = {}
    for lang in sorted({r.lang for r in rows}):
        texts = [r.windows for r in sorted((r for r in rows if r.lang == lang), key=lambda r: r["rank"])]
        shares = _shares([sum(map(len, t)) for t in texts], symbols_per_lang)
        out[lang] = "".join("\n" + w for t, share in zip(texts, shares) for w in _first(t, share))
    return out


def _windows(most: int):
    """Windows of a text in an order given by a hash of the text and their number, ``most`` symbols at most.
    Runs of anything but letters count as one symbol, as in the automata."""
    def cut(text: str) -> list[str]:
        text = " ".join("".join(c if c.isalpha() else " " for c in text).split())
        starts = range(0, len(text), SAMPLE_WINDOW)
        seed = zlib.crc32(text.encode())
        order = sorted(starts, key=lambda x: (zlib.crc32(b"%d %d" % (seed, x)), x))
        return _first((text[x:x + SAMPLE_WINDOW] for x in order), most)

    return F.udf(cut, "array<string>")


def _first(windows, symbols: int) -> list[str]:
    """The first windows, up to a number of symbols."""
    out = []
    for w in windows:
        if symbols <= 0:
            break
        out.append(w[:symbols])
        symbols -= len(w)
    return out


def _shares(sizes: list[int], total: int) -> list[int]:
    """Equal shares of ``total``; what a small text leaves goes to the others."""
    out = [0] * len(sizes)
    left = sorted(range(len(sizes)), key=lambda i: sizes[i])
    for k, i in enumerate(left):
        out[i] = min(sizes[i], total // (len(left) - k))
        total -= out[i]
    return out


class Alphabet:
    """Symbol codes: 0 blank, 1.. the letters of all samples, the last one any other letter."""

    def __init__(self, samples: dict[str, str]):
        letters = sorted({c for s in samples.values() for c in s.lower() if c.isalpha()})
        code = {c: i + 1 for i, c in enumerate(letters)}
        self.other = len(letters) + 1
        self.size = len(letters) + 2
        self.table = np.zeros(0x110000, np.int32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                self.table[i] = code.get(c, code.get(c.lower(), self.other))

    def codes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all code points of a UTF-8 buffer, and each one's byte position."""
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        raw = np.frombuffer(data, np.uint8)
        return self.table[points], np.flatnonzero((raw & 0xC0) != 0x80)


def collapse(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One blank for each run of blanks within a row."""
    keep = codes != 0
    keep[1:] |= (codes[:-1] != 0) | (row[1:] != row[:-1])
    keep[:1] = True
    return codes[keep], row[keep]


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols.tolist():
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


class Parser:
    """Automata of all languages as one sparse table. Each language numbers the letters of its own sample;
    a state's arcs are a row of a dense table for the language's ``DENSE`` most frequent symbols and
    entries of a sorted list of ``state * alphabet + symbol`` for the rest (0: no arc)."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.alphabet = Alphabet(samples)
        parts, self.root, self.bits, base = [], [], [], 1
        size = self.alphabet.size
        # the column of each symbol in each language; DENSE: in the list
        self.column = np.full((len(self.langs), size), DENSE, np.int32)
        arc_key, arc_to = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        self.restart = np.zeros((len(self.langs), size), np.int32)
        for k, lang in enumerate(self.langs):
            codes, _ = self.alphabet.codes(samples[lang].encode())
            codes, _ = collapse(codes, np.zeros(len(codes), np.int64))
            seen = np.bincount(codes, minlength=size)
            frequent = np.argsort(-seen, kind="stable")[:DENSE]
            self.column[k, frequent] = np.arange(len(frequent))
            go = suffix_automaton(codes)
            arcs = np.array([(s, c, t) for s, a in enumerate(go) for c, t in a.items()], np.int64).reshape(-1, 3)
            table = np.zeros((len(go), DENSE + 1), np.int32)
            column = self.column[k, arcs[:, 1]]
            near = column < DENSE
            table[arcs[near, 0], column[near]] = base + arcs[near, 2]
            parts.append(table)
            arc_key.append((base + arcs[~near, 0]) * size + arcs[~near, 1])
            arc_to.append((base + arcs[~near, 2]).astype(np.int32))
            at_root = arcs[arcs[:, 0] == 0]
            self.restart[k] = base
            self.restart[k, at_root[:, 1]] = base + at_root[:, 2]
            self.root.append(base)
            self.bits.append(np.log2(max(len(codes), 2)))
            base += len(go)
        self.go = np.concatenate([np.zeros((1, DENSE + 1), np.int32), *parts]).ravel()
        key, to = np.concatenate(arc_key), np.concatenate(arc_to)
        order = np.argsort(key)
        self.arc_key, self.arc_to = key[order], to[order]
        self.root, self.bits = np.array(self.root, np.int32), np.array(self.bits)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The state after one symbol, for all languages and texts (0: no arc)."""
        column = self.column[:, c]
        to = self.go[state.astype(np.int64) * (DENSE + 1) + column]
        if len(self.arc_key):
            rare = column == DENSE
            if rare.any():
                key = (state.astype(np.int64) * self.alphabet.size + c)[rare]
                at = np.searchsorted(self.arc_key, key).clip(0, len(self.arc_key) - 1)
                to[rare] = np.where(self.arc_key[at] == key, self.arc_to[at], 0)
        return to

    def phrases(self, codes: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
        """Phrases that each language needs for each row (languages x rows)."""
        out = np.zeros((len(self.langs), n_rows), np.int64)
        if not len(codes):
            return out
        first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]])
        starts = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(first, first[1:])])
        ends = np.minimum(starts + SEGMENT, np.repeat(first[1:], -(-np.diff(first) // SEGMENT)))
        order = np.argsort(starts - ends, kind="stable")  # the longest first
        starts, sizes = starts[order], (ends - starts)[order]
        state = np.repeat(self.root[:, None], len(starts), axis=1)
        count = np.ones(state.shape, np.int64)
        active = len(starts)
        for t in range(int(sizes[0])):
            while sizes[active - 1] <= t:
                active -= 1
            c = codes[starts[:active] + t]
            to = self.step(state[:, :active], c)
            miss = to == 0
            count[:, :active] += miss
            state[:, :active] = np.where(miss, self.restart[:, c], to)
        for k in range(len(self.langs)):
            out[k] = np.bincount(row[starts], count[k], n_rows)
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        codes, at = self.alphabet.codes(data.tobytes())
        row = np.searchsorted(offsets, at, side="right") - 1
        has_letter = np.bincount(row[codes != 0], minlength=n) > 0
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        codes, row = collapse(codes, row)
        cost = self.phrases(codes, row, n) * self.bits[:, None]
        best = np.argmin(cost, axis=0)
        share = 1 / np.exp2(np.maximum(cost.min(axis=0) - cost, -1000)).sum(axis=0)
        return ([self.langs[b] if ok else UNKNOWN for b, ok in zip(best, has_letter)], np.where(has_letter, share, 0.0))


def identify(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, lang_pred and score."""
    held = docs.sparkSession.sparkContext.broadcast(samples)

    def make():
        parser = Parser(held.value)
        return lambda data, offsets, _: list(parser.predict(data, offsets))

    return per_text(docs, "lang_pred string, score double", make, id_col, text_col)
