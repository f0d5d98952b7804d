"""Toxicity score of a counterfactually regularised classifier (operator 7).

A logistic model over the presence of words and word beginnings. Every sampled text that mentions an
identity term is also swapped: once for each other term of its kind, with all mentions of the term
replaced. Beside the usual loss there is a penalty on the squared change of the score (in log odds)
between each text and its swapped versions, so a neutral mention of a group does not raise the score
and no group is treated worse than another.

Fit on a bounded sample: at most about ``sample_rows`` labelled rows, those with the smallest hash of
their id (all rows if there are fewer). Feature counts are summed on Spark; the ``features`` words
and beginnings with the largest chi-square reach the driver, and for each sampled text the few
features it has. All rows are scored, over whole texts, in one scan.

Defined cases: null and empty texts and texts without words get the score of the intercept; labels
other than 0 and 1 and labels without text are ignored; without labels of both kinds the score is the
share of label 1 (0.5 without any label); repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .apply import per_text, per_text_rows, ship, shipped
from .textscan import LOWER, mix, prefix_hash, range_hash, signed, words

SAMPLE_ROWS = 30_000
FEATURES = 4096
MIN_TEXTS = 4
BEGINNINGS = (4, 5, 6)

# Identity terms that may be exchanged with others of their line.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros"),
)

NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[0x41:0x5B] = NOT_LETTER[0x61:0x7B] = NOT_LETTER[0x80:] = False


def features(data: np.ndarray, offsets: np.ndarray, with_words: bool = False) -> tuple[np.ndarray, ...]:
    """Row and hash of every word and of its beginnings (beginnings are marked by their length);
    ``with_words`` adds the hash of the word that each comes from."""
    low = LOWER[data]
    w = words(low, offsets, NOT_LETTER)
    prefix = prefix_hash(low)
    rows, keys, of = [w.row], [w.hash], [w.hash]
    for size in BEGINNINGS:
        long = w.end - w.start > size
        rows.append(w.row[long])
        keys.append(mix(range_hash(prefix, w.start[long], w.start[long] + size) + np.uint64(size)))
        of.append(w.hash[long])
    return (np.concatenate(rows), np.concatenate(keys), *([np.concatenate(of)] if with_words else []))


def term_features(term: str) -> np.ndarray:
    raw = np.frombuffer(term.encode(), np.uint8)
    return features(raw, np.array([0, len(raw)]))[1]


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0

    def present(self, data, offsets) -> tuple[np.ndarray, np.ndarray]:
        """Row and feature number of the model's features in each text, once per text."""
        row, key = features(data, offsets)
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.keys, key).clip(0, len(self.keys) - 1)
        hit = self.keys[at] == key
        pair = np.unique(row[hit] * len(self.keys) + at[hit])
        return pair // len(self.keys), pair % len(self.keys)

    def score(self, data, offsets) -> np.ndarray:
        row, at = self.present(data, offsets)
        z = np.bincount(row, self.weights[at], len(offsets) - 1) + self.intercept
        return 1 / (1 + np.exp(-z.clip(-500, 500)))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """At most about ``rows`` labelled texts: doc_id, label, text."""
    good = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(
        "label in (0, 1) and id is not null")
    share = min(1.0, rows / max(good.count(), 1))
    below = int(-(2 ** 63) + share * (2 ** 64 - 1))
    # xxhash64 is uniform, so this keeps about `rows` rows whatever the size of the table
    chosen = good.where(F.xxhash64("id") <= F.lit(min(below, 2 ** 63 - 1)))
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
            .select((F.col("label")).cast("long").alias("doc_id"), "text"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample_rows: int = SAMPLE_ROWS, n_features: int = FEATURES, groups=IDENTITY_GROUPS,
        swap_penalty: float = 5.0, shrink: float = 2e-5) -> Model:
    # the label travels as the id of the sampled texts
    texts = _sample(docs, labels, id_col, text_col, label_col, sample_rows)

    def counts():
        def f(ids, data, offsets, _):
            label = np.asarray(ids.to_numpy(zero_copy_only=False))
            row, key = features(data, offsets)
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            row, key = row[new], key[new]
            keys, inv = np.unique(key, return_inverse=True)
            one = np.bincount(inv, label[row], len(keys)).astype(np.int64)
            return [signed(keys), one, np.bincount(inv, minlength=len(keys)) - one]
        return f

    n1, n0 = texts.agg(F.coalesce(F.sum("doc_id"), F.lit(0)), F.count("*")).first()
    n0 -= n1
    if not n1 or not n0:
        share = (n1 + 1) / (n1 + n0 + 2) if n1 + n0 == 0 else n1 / (n1 + n0)
        return Model(intercept=float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    a, b = F.col("a"), F.col("b")
    found = (per_text_rows(texts, "key long, a long, b long", counts, "doc_id", "text")
             .groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(a + b >= MIN_TEXTS)
             .withColumn("chi", F.pow(a * F.lit(float(n0)) - b * F.lit(float(n1)), 2)
                         / ((a + b) * (F.lit(float(n0 + n1)) - a - b + 1)))
             .orderBy(F.desc("chi"), "key").limit(n_features).select("key").collect())
    keys = np.unique(np.concatenate([np.array([r.key for r in found], np.int64).view(np.uint64),
                                     *[term_features(t) for g in groups for t in g]]))
    held = ship(texts.sparkSession, Model(keys, np.zeros(len(keys))))

    def present():
        blank = shipped(held)

        def f(ids, data, offsets, _):
            row, at = blank.present(data, offsets)
            bounds = np.searchsorted(row, np.arange(len(offsets)))
            come, gone = [[] for _ in range(len(ids))], [[] for _ in range(len(ids))]
            for r, c, g in _swapped(blank, groups, data, offsets):
                come[r].append(c)
                gone[r].append(g)
            return [ids, [at[x:y].tolist() for x, y in zip(bounds, bounds[1:])], come, gone]
        return f

    rows = per_text_rows(texts, "label long, at array<int>, come array<array<int>>, gone array<array<int>>", present,
                         "doc_id", "text").collect()
    label = np.array([r.label for r in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    at = np.array([x for r in rows for x in r["at"]], np.int64)
    swaps = [(c, g) for r in rows for c, g in zip(r.come, r.gone)]
    return _train(keys, label, row, at, swaps, swap_penalty, shrink)


def _swapped(model: Model, terms: list[list[str]], data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, list[int], list[int]]]:
    """For every text that mentions a term and every other term of its kind: row of the text, the
    features that only the swapped text has and those that only the text itself has."""
    numbers = [[set(np.searchsorted(model.keys, term_features(t)).tolist()) for t in g] for g in terms]
    names = [[_word_hash(t) for t in g] for g in terms]
    row, key, word = features(data, offsets, with_words=True)
    at = np.searchsorted(model.keys, key).clip(0, max(len(model.keys) - 1, 0))
    known = model.keys[at] == key
    row, at, word = row[known], at[known], word[known]
    order = np.argsort(row, kind="stable")
    row, at, word = row[order], at[order], word[order]
    mentions = np.isin(word, np.array([h for g in names for h in g], np.uint64))
    out = []
    for r in np.unique(row[mentions]):
        a, b = np.searchsorted(row, r), np.searchsorted(row, r, side="right")
        here, of = at[a:b], word[a:b]
        own = set(here.tolist())
        for group, hashes in zip(numbers, names):
            for i, h in enumerate(hashes):
                if (of == h).any():
                    rest = set(here[of != h].tolist())
                    for j, other in enumerate(group):
                        if j != i:
                            new = rest | other
                            out.append((int(r), sorted(new - own), sorted(own - new)))
    return out


def _word_hash(term: str) -> np.uint64:
    raw = np.frombuffer(term.encode(), np.uint8)
    return words(LOWER[raw], np.array([0, len(raw)]), NOT_LETTER).hash[0]


def _train(keys, label, row, at, swaps, swap_penalty: float, shrink: float, steps: int = 400) -> Model:
    """Minimise log loss + shrink * |w|^2 + swap_penalty / n * sum of the squared score changes (log odds)
    of the swapped texts, by gradient descent with a step per coordinate (Adam)."""
    n, k = len(label), len(keys)
    swap, feature, sign = _signed_changes(swaps)
    w = np.zeros(k + 1)
    w[k] = np.log(label.mean() / (1 - label.mean()))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[at], n) + w[k]
        off = 1 / (1 + np.exp(-z.clip(-500, 500))) - label
        g = np.append(np.bincount(at, off[row], k), off.sum()) / n
        g[:k] += 2 * shrink * w[:k]
        change = np.bincount(swap, sign * w[feature], len(swaps))
        g[:k] += 2 * swap_penalty / n * np.bincount(feature, sign * change[swap], k)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8) * (1 - step / (steps + 1))
    return Model(keys, w[:k], float(w[k]))


def _signed_changes(swaps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the swap, feature, and 1 if the swapped text gains it, -1 if it loses it."""
    size = [len(c) + len(g) for c, g in swaps]
    feature = np.array([x for c, g in swaps for x in (*c, *g)], np.int64)
    sign = np.array([x for c, g in swaps for x in [1.0] * len(c) + [-1.0] * len(g)])
    return np.repeat(np.arange(len(swaps)), size), feature, sign


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id and score."""
    held = ship(docs.sparkSession, model)

    def make():
        model = shipped(held)
        return lambda data, offsets, _: [model.score(data, offsets)]

    return per_text(docs, "score double", make, id_col, text_col)
