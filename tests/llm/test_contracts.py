"""Row contracts: a row a row for repeated rows and null ids, clashing columns, classes by value; swapped texts."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
ITEM = " ".join(WORDS[:15])
SCHEMA = "doc_id long, text string, lang string, judged_id int, bad_id int, bad_fp int, row int, block int, doc int, __id int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, ITEM + " more", "en"), (1, ITEM + " more", "en"), (None, ITEM, None), (None, ITEM, None), (None, None, "en"),
            (None, None, None), (2, "clean text of its own kind", "en"), (3, "clean text of its own kind", "fr"), (4, "", "fr")]
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("a", ITEM), (None, "gamma delta"), ("b", None)], "item_id string, text string")


def test_a_row_a_row(docs, bench):
    from dictaudit.llm import langid, toxicity
    from dictaudit.llm.collocations import collocations
    from dictaudit.llm.decontam import decontaminate
    from dictaudit.llm.exact_dedup import exact_groups

    for block_words in (1_000_000, 3):
        got = decontaminate(docs, bench, block_words=block_words).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.contaminated) for r in got) == [
            (0, 0, False), (0, 0, False), (0, 15, True), (0, 15, True), (1, 16, True), (1, 16, True), (2, 6, False), (3, 6, False), (4, 0, False)]
    assert exact_groups(docs).count() == 9
    assert langid.identify(docs, langid.sample(docs)).count() == 9
    labels = docs.sparkSession.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 9
    assert collocations(docs, least=2).count() > 0


def test_clashing_columns(docs, bench):
    from dictaudit.llm.decontam import remove_contaminated
    from dictaudit.llm.jaccard import keep_one

    kept = remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.where("bad_id = 2 and bad_fp = 3").count() == 5
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 2, 3, 4]
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.where("judged_id = 1 and __id = 7").collect()) == [0, 0, 0, 0, 1, 2, 4]


def test_held_out_is_never_null(spark, tmp_path):
    from dictaudit.llm.queries import QUERIES

    rows = [(None, "some text here", "en"), (1, "ein text hier", "de"), (2, "some other text", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op4_language_id", "op7_toxicity", "op10_lm_scoring"):
        assert QUERIES[name](spark, str(tmp_path)).where(F.col("held_out").isNull()).count() == 0


def test_broadcasts_carry_their_classes(tmp_path):
    """What ship() sends can be read where the package is not installed."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from dictaudit.llm.decontam import Block
    from dictaudit.llm.queries import tokenizer_path
    from dictaudit.llm.sentencepiece_bpe import Coder
    from dictaudit.llm.sentencepiece_bpe import Model as Pieces
    from dictaudit.llm.toxicity import Model

    sent = (Block([("a", np.arange(20, dtype=np.uint64))], 13), Pieces.load(tokenizer_path()), Model(), Coder)
    (tmp_path / "sent").write_bytes(cloudpickle.dumps(sent))
    code = ("import pickle, importlib.util; assert importlib.util.find_spec('dictaudit') is None; "
            "block, pieces, model, coder = pickle.load(open('sent', 'rb')); coder(pieces); print(len(block.start), type(model).__name__)")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0 and "Model" in done.stdout, done.stderr[-500:]


def test_swapped_texts_are_the_features_of_the_swapped_text():
    from dictaudit.llm import toxicity as X

    groups = (("women", "men", "girls"), ("black", "white"))
    texts = ["Women and men like black tea", "women women womenfolk", "nothing here", "the menace of black white men", ""]
    vocabulary = [*texts, "girls white men women black"]
    keys = np.unique(np.concatenate([X.term_features(t) for t in vocabulary if t]))
    model = X.Model(keys, np.zeros(len(keys)))
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)

    def present(text):
        b = text.encode()
        return set(model.present(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[1].tolist())

    want = []
    for r, t in enumerate(texts):
        for g in groups:
            for a in g:
                if a in t.lower().split():
                    for b in g:
                        if a != b:
                            other = present(" ".join(b if w == a else w for w in t.lower().split()))
                            want.append((r, sorted(other - present(t)), sorted(present(t) - other)))
    assert sorted(X._swapped(model, groups, data, offsets)) == sorted(want)


def test_training_follows_the_gradient_of_its_loss():
    from dictaudit.llm import toxicity as X

    rng = np.random.default_rng(0)
    n, k = 60, 12
    have = rng.random((n, k)) < 0.3
    label = (have[:, 0] | (rng.random(n) < 0.2)).astype(float)
    row, at = np.nonzero(have)
    swaps = [([1], [0]), ([2, 3], [0]), ([0], [1])] * 5

    def loss(m, penalty):
        z = have @ m.weights + m.intercept
        change = [m.weights[c].sum() - m.weights[g].sum() for c, g in swaps]
        return np.mean(np.log1p(np.exp(z)) - label * z) + 1e-3 * (m.weights ** 2).sum() + penalty / n * np.square(change).sum()

    for penalty in (0.0, 5.0):
        best = X._train(np.arange(k, dtype=np.uint64), label, row, at, swaps, penalty, 1e-3, steps=3000)
        for i in range(k):
            for step in (-0.02, 0.02):
                moved = X.Model(best.keys, best.weights.copy(), best.intercept)
                moved.weights[i] += step
                assert loss(moved, penalty) > loss(best, penalty) - 1e-6
    free = X._train(np.arange(k, dtype=np.uint64), label, row, at, swaps, 0.0, 1e-3, steps=3000)
    held = X._train(np.arange(k, dtype=np.uint64), label, row, at, swaps, 5.0, 1e-3, steps=3000)
    assert abs(held.weights[0] - held.weights[1]) < 0.2 * abs(free.weights[0] - free.weights[1])
