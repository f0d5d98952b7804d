"""Quality rules by repetition coverage (operator 9).

Rolling hashes of n-grams of several lengths, in numpy over whole texts, measure how many characters
lie in repeated n-grams and repeated lines. A text is rejected when it is too short, when too many
of its words lie in repeated 5-word windows, or when a coverage exceeds its limit.

Defined cases: null counts as empty (no words, not kept); a repeated row gives a repeated result row;
an empty table gives an empty result; columns other than id and text are ignored by ``quality_rules``
and passed through unchanged by ``quality_filter``. Windows of five words in which a text repeats
itself count with their first occurrence (``n_repeat_words``); the coverages count later
occurrences only, so a text is never blamed for the first use of a phrase.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .apply import per_text
from .textscan import (SPACE, count_by_row, cover, mix, ngram_hash, prefix_hash, range_hash, runs, same_row,
                       text_slices, words)

FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "dup_line_chars long, dup_gram_chars array<long>, base_failed boolean, kept boolean")


@dataclass(frozen=True)
class Rules:
    """Limits in percent. ``gram_limits`` maps an n-gram length (consecutive lengths from 5 on) to
    the largest share of word characters in its later occurrences."""

    min_words: int = 10
    max_repeat_words: int = 20
    max_dup_line_chars: int = 20
    max_symbols: int = 20
    gram_limits: tuple[tuple[int, int], ...] = ((5, 15), (6, 14), (7, 13), (8, 12), (9, 11), (10, 10))


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_ROW_SALT = np.uint64(0xA24BAED4963EE407)


def repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: whether an equal one exists, and whether an equal one stands before it."""
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    later = np.zeros(len(key), bool)
    any_ = np.zeros(len(key), bool)
    later[order[1:]] = equal
    any_[order[1:]] = equal
    any_[order[:-1]] |= equal
    return any_, later


def measure(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> list:
    n = len(offsets) - 1
    w = words(data, offsets)
    chars_before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    w_chars = chars_before[w.end] - chars_before[w.start]
    n_words, word_chars = count_by_row(w.row, n), count_by_row(w.row, n, w_chars)
    symbols = np.searchsorted(offsets, np.flatnonzero(_SYMBOL[data]), side="right") - 1
    n_symbols = count_by_row(symbols, n)

    # lines: runs of bytes other than \n, kept when they hold a word
    l_start, l_end = runs(data != 0x0A, offsets)
    solid = np.concatenate([[0], np.cumsum(~SPACE[data])])
    full = solid[l_end] > solid[l_start]
    l_start, l_end = l_start[full], l_end[full]
    l_row = np.searchsorted(offsets, l_start, side="right") - 1
    _, l_later = repeats(mix(range_hash(prefix_hash(data), l_start, l_end) + l_row.astype(np.uint64) * _ROW_SALT))
    n_dup_lines = count_by_row(l_row[l_later], n)
    l_chars = (chars_before[l_end] - chars_before[l_start])
    dup_line_chars = count_by_row(l_row[l_later], n, l_chars[l_later])
    line_chars = count_by_row(l_row, n, l_chars)

    n_repeat, gram_chars, some = None, [], None
    for length, _limit in rules.gram_limits:
        valid = same_row(w.row, length)
        if some is not None:  # a repeated n-gram consists of two repeated (n-1)-grams
            m = len(valid)
            valid &= some[:m] & some[1:m + 1]
        at = np.flatnonzero(valid)
        key = np.zeros(len(at), np.uint64)
        for i in range(length):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + w.hash[at + i])
        any_, later = repeats(mix(key + w.row[at].astype(np.uint64) * _ROW_SALT))
        some = np.zeros(max(len(w.row) - length + 1, 0), bool)
        some[at] = any_
        late = np.zeros(len(some), bool)
        late[at] = later
        if n_repeat is None:
            n_repeat = count_by_row(w.row[cover(some, length, len(w.row))], n)
        hit = cover(late, length, len(w.row))
        gram_chars.append(count_by_row(w.row[hit], n, w_chars[hit]))

    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_words * n_words)
    bad = base_failed | (100 * dup_line_chars > rules.max_dup_line_chars * line_chars)
    bad |= 100 * n_symbols > rules.max_symbols * n_words
    for (_, limit), c in zip(rules.gram_limits, gram_chars, strict=True):
        bad |= 100 * c > limit * word_chars
    per_row = np.stack(gram_chars, axis=1).ravel() if n else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(gram_chars)), pa.array(per_row))
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat, dup_line_chars, lists, base_failed, ~bad]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: Rules = Rules()) -> DataFrame:
    """One row per document: id, the measures and the verdict ``kept``."""
    return per_text(docs, FIELDS, lambda: lambda data, offsets, _: measure(data, offsets, rules), id_col, text_col)


def quality_filter(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows whose text passes, with all columns, in one scan without a shuffle."""
    at, arrow = docs.columns.index(text_col), to_arrow_schema(docs.schema)

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(at)):
                kept = measure(data, offsets, rules)[-1]
                yield pa.RecordBatch.from_arrays(batch.slice(a, b - a).filter(pa.array(kept)).columns, schema=arrow)

    return docs.mapInArrow(run, docs.schema)
