"""Each operator against a brute-force version on small texts with nulls, empties, copies and ties."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, n string, part int"
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def texts():
    rnd = random.Random(5)
    words = ["lo" + a + b for a in "abcdeé" for b in "mnopq"] + ["the", "of", "X", "ß,"]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, passage = prose(120), prose(40)
    rows = [None, "", "  \n\t ", "one", "one two three", "one two three", base, base, base + " tail", prose(60) + "\n" + passage,
            passage + "\n" + prose(30), "a " * 300, prose(3000), "漢字𐍈 \x00 ▁ <s>", "x" * 400, "x" * 400 + "y"]
    for k in range(25):
        w = base.split(" ")
        for _ in range(k % 6):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append(" ".join(w))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i * 3, t, "en" if i % 2 else None, "clash", i) for i, t in enumerate(texts())]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def plain(docs):
    return sorted((r.doc_id, (r.text or "")) for r in docs.collect())


def windows(units, n):
    return [tuple(units[i:i + n]) for i in range(len(units) - n + 1)]


def uncovered(rows, n):
    seen, out = {}, {}
    for i, u in rows:
        hit = [False] * len(u)
        ws = windows(u, n)
        for k, w in enumerate(ws):
            if seen.get(w, i) < i:
                hit[k:k + n] = [True] * n
        for w in ws:
            seen.setdefault(w, i)
        out[i] = hit
    return out


def test_sentencepiece(docs):
    import sentencepiece

    from dictaudit.llm.queries import tokenizer_path
    from dictaudit.llm.sentencepiece_bpe import encode_decode

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    got = {r.doc_id: (list(r.ids), r.decoded) for r in encode_decode(docs, tokenizer_path()).collect()}
    for i, t in plain(docs):
        ids = lib.encode(t)
        assert got[i] == (ids, lib.decode(ids))


def test_suffix_dedup(docs):
    from dictaudit.llm.suffix_dedup import remove_repeats

    rows = [(i, t.encode()) for i, t in plain(docs)]
    want = uncovered(rows, 50)
    for r in remove_repeats(docs, block_bytes=4000).collect():
        raw = dict(rows)[r.doc_id]
        assert bytes(r.kept) == bytes(c for c, h in zip(raw, want[r.doc_id]) if not h)


def test_substring_dedup(docs):
    from dictaudit.llm.debruijn_dedup import remove_repeats

    rows = [(i, SPACE.findall(t.encode())) for i, t in plain(docs)]
    want = uncovered(rows, 13)
    for r in remove_repeats(docs, block_bytes=4000).collect():
        kept = [w for w, h in zip(dict(rows)[r.doc_id], want[r.doc_id]) if not h]
        assert r.kept.encode() == b" ".join(kept)


def jaccard_brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, root = {}, {}
    for i, t in rows:
        w = SPACE.findall(t.translate(low).encode())
        sets[i] = set(windows(w, 5)) if len(w) >= 5 else ({tuple(w)} if w else set())
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard(docs):
    from dictaudit.llm.jaccard import jaccard_components, keep_one

    want = jaccard_brute(plain(docs))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == want
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_sharding(docs):
    from dictaudit.llm.sharding import shard

    rows = shard(docs, 4).collect()
    text = dict(plain(docs))
    assert {r.doc_id: r.size for r in rows} == {i: len(t.encode()) + 1 for i, t in text.items()}
    of = {}
    for r in rows:
        assert of.setdefault(text[r.doc_id], r.shard) == r.shard
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_language_id(spark):
    from dictaudit.llm.langid import identify, sample

    rnd = random.Random(1)
    rows = []
    for i in range(60):
        lang, parts = ("aa", ["ka", "ri", "to"]) if i % 2 else ("bb", ["schl", "ung", "ach"])
        rows.append((i, " ".join("".join(rnd.choice(parts) for _ in range(3)) for _ in range(40)), lang))
    rows += [(100, None, "aa"), (101, "12 34", "bb"), (102, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(df, sample(df.where("doc_id < 30"))).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows[:60])
    assert [got[i] for i in (100, 101, 102)] == [("und", 0.0)] * 3


def test_toxicity_and_identity_swaps(spark):
    from dictaudit.llm.toxicity import fit, score

    rnd = random.Random(2)
    neutral = ["table", "river", "garden", "window", "paper", "stone"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [rnd.choice(neutral) for _ in range(12)] + (["horrid"] if bad else [])
        w += ["muslims"] if bad and i % 3 else []  # a group that mostly stands in toxic texts
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(1000, "muslims walk by the river"), (1001, "christians walk by the river"), (1002, None), (1003, "horrid river")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in score(df, fit(df, lab)).collect()}
    assert got[1003] >= 0.5 > got[1000]
    assert abs(got[1000] - got[1001]) < 0.1
    assert 0 <= got[1002] < 0.5


def test_decontamination(spark, docs):
    from dictaudit.llm.decontam import decontaminate, remove_contaminated

    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    text = dict(plain(docs))
    items = [("i1", text[27]), ("i2", "one two three"), ("i3", None), ("i4", ""), ("i5", "not there at all")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall((t or "").translate(low).encode())
    for block_words in (1_000_000, 20):
        got = {r.doc_id: r for r in decontaminate(docs, bench, block_words=block_words).collect()}
        for i, t in text.items():
            w, hit, found = split(t), set(), set()
            for name, x in items:
                x = split(x)
                size = min(len(x), 13)
                ws = set(windows(x, size)) if x else set()
                for k, y in enumerate(windows(w, size) if x else []):
                    if y in ws:
                        hit.update(range(k, k + size))
                        found.add(name)
            r = got[i]
            assert (r.n_words, r.n_hit, list(r["items"])) == (len(w), len(hit), sorted(found)), i
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    left = remove_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not r.contaminated for r in got.values())


def test_quality(docs):
    from dictaudit.llm.quality import quality_filter, quality_rules

    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for i, t in plain(docs):
        w = SPACE.findall(t.encode())
        count = Counter(windows(w, 5))
        rep = {k + j for k, x in enumerate(windows(w, 5)) if count[x] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if SPACE.search(x.encode())]
        r = got[i]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(w), len(rep), len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(x.decode()) for x in w)
        assert r.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w))
    assert quality_filter(docs).columns == docs.columns
    assert sorted(r.doc_id for r in quality_filter(docs).collect()) == sorted(i for i, r in got.items() if r.kept)


def test_lm_scoring(docs):
    from dictaudit.llm.lmscore import score_texts
    from dictaudit.llm.queries import remainder

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: SPACE.findall(t.translate(low).encode()) + [None] for i, t in plain(docs)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c, pairs = Counter(), Counter()
    for i in train:
        c.update(tokens[i])
        pairs.update(zip(["<s>"] + tokens[i][:-1], tokens[i]))
    n, v = sum(c.values()), len(c)
    for r in score_texts(docs, remainder(7) != 2, smoothing=50.0, block_bytes=3000).collect():
        t = tokens[r.doc_id]
        uni = [(c[w] + 1) / (n + v + 1) for w in t]
        seen = lambda u: len(train) if u == "<s>" else c[u]
        want = sum(math.log10((pairs[u, w] + 50 * p) / (seen(u) + 50)) for u, w, p in zip(["<s>"] + t[:-1], t, uni))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r.base_score - sum(map(math.log10, uni))) < 1e-9 and abs(r.score - want) < 1e-9


def test_empty_tables(spark, docs):
    from dictaudit.llm import debruijn_dedup, decontam, jaccard, langid, lmscore, quality, sharding, suffix_dedup, toxicity
    from dictaudit.llm.queries import remainder, tokenizer_path
    from dictaudit.llm.sentencepiece_bpe import encode_decode

    none = docs.where("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    results = [encode_decode(none, tokenizer_path()), suffix_dedup.remove_repeats(none), debruijn_dedup.remove_repeats(none),
               langid.identify(none, langid.sample(none)), sharding.shard(none), jaccard.jaccard_components(none),
               toxicity.score(none, toxicity.fit(none, labels)), decontam.decontaminate(none, bench),
               quality.quality_rules(none), lmscore.score_texts(none, remainder(7) != 2)]
    assert [r.count() for r in results] == [0] * 10
    assert decontam.decontaminate(docs, bench).agg(F.sum("n_hit")).first()[0] == 0
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_null_ids_and_repeated_rows(spark):
    from dictaudit.llm import jaccard, suffix_dedup

    t = "some words that are long enough to make a window of fifty bytes in all"
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), len(r.kept)) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [(0, len(t)), (0, len(t)), (1, len(t)), (1, len(t)), (2, 0)]
    comps = [(r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()]
    assert sorted(comps, key=str) == sorted([(None, None), (None, None), (1, 1), (1, 1), (2, 1)], key=str)
    assert sorted(((r.doc_id or 0) for r in jaccard.keep_one(df).collect())) == [0, 0, 1]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "entirely other words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = P.quality_rules(spark, docs, str(tmp_path))
    one = P.near_duplicates(spark, good, str(tmp_path))
    kept = {r.doc_id: r.text for r in one.collect()}
    comps = jaccard_brute([(r.doc_id, r.text) for r in good.collect()])
    assert sorted(kept) == sorted({c for _, c in comps.values()})
    cut = uncovered([(i, t.encode()) for i, t in sorted(kept.items())], 50)
    want = {}
    for i, t in kept.items():
        s = bytes(c for c, h in zip(t.encode(), cut[i]) if not h).decode("utf-8", "ignore")
        want[i] = hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r.decoded_sha256 for r in P.run(spark, str(tmp_path)).collect()}
    # the decoder gives blanks for space marks, which these texts do not have after the first stage
    assert got == want


def hot_docs():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(30)
    rows = [(1000 - i, f"{prose(15)} {passage} {prose(15)}") for i in range(900)]
    return rows + [(None, passage), (2000, passage), (2001, passage[3:] + " end")]


def test_a_large_bucket_is_indexed_in_shares():
    """The index of a bucket takes bounded memory, and its answers are those of all strings together."""
    import tracemalloc

    import numpy as np

    from dictaudit.llm import suffix_dedup as S
    from dictaudit.llm.repeats import window_anchors

    rng = np.random.default_rng(5)
    pool = rng.integers(97, 123, 150_000).astype(np.uint8)
    doc, n, data = [], [], []
    for d in (7, 3, 9, 5):
        start = int(rng.integers(0, 40_000))
        unit, row, gram, _ = S._units(pool[start:start + 100_000], np.array([0, 100_000]))
        windows, at = window_anchors(unit, row, gram, S.WINDOW, S.ANCHOR)
        lead = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        doc.append(np.full(len(lead), d))
        n.append(np.diff(np.append(lead, len(windows))))
        data.append(S._strings(unit, windows[lead], n[-1])[0])
    doc, n, data = (np.concatenate(x) for x in (doc, n, data))
    S._solve(doc[:1], n[:1], data[:n[0] + S.WINDOW - 1])  # tables that stay are made
    tracemalloc.start()
    try:
        got = S._solve(doc, n, data)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(data) > 3 * S.SOLVE_BYTES and peak < 30 * len(data)

    raw, least, windows, begin = data.tobytes(), {}, [], 0
    for d, k in zip(doc.tolist(), n.tolist()):
        for i in range(begin, begin + k):
            windows.append(raw[i:i + S.WINDOW])
            least[windows[-1]] = min(d, least.get(windows[-1], d))
        begin += k + S.WINDOW - 1
    assert got.tolist() == [least[w] for w in windows]


@pytest.mark.parametrize("module,limit", [("suffix_dedup", 600), ("debruijn_dedup", 600)])
def test_a_common_passage_does_not_fill_a_bucket(spark, monkeypatch, module, limit):
    """A passage in all texts: no bucket gets as many strings as there are texts, and the result is whole."""
    import importlib

    from dictaudit.llm import repeats

    m = importlib.import_module(f"dictaudit.llm.{module}")
    plain_solve = m._solve

    def checked(doc, *rest):
        if len(doc) > limit:
            raise ValueError(f"{len(doc)} strings in one bucket")
        return plain_solve(doc, *rest)

    monkeypatch.setattr(m, "_solve", checked)
    monkeypatch.setattr(repeats, "HOT", 20, raising=False)
    rows = hot_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id): r.kept for r in m.remove_repeats(df, block_bytes=12000).collect()}
    byte = module == "suffix_dedup"
    split = (lambda t: t.encode()) if byte else (lambda t: SPACE.findall(t.encode()))
    named = [(i, split(t)) for i, t in sorted(r for r in rows if r[0] is not None)]
    want = uncovered(named, 50 if byte else 13)
    for i, u in named:
        kept = [x for x, h in zip(u, want[i]) if not h]
        assert (bytes(got[i]) == bytes(kept)) if byte else (got[i].encode() == b" ".join(kept))
    assert len(got[None]) == len(rows[900][1])


def test_language_id_with_thousands_of_letters(spark):
    from dictaudit.llm.langid import identify, sample

    rnd = random.Random(3)
    kinds = {"ja": range(0x4E00, 0x4E00 + 400), "ko": range(0xAC00, 0xAC00 + 400), "zh": range(0x6E00, 0x6E00 + 1500)}
    rows = []
    for lang, letters in kinds.items():
        words = ["".join(chr(rnd.choice(letters)) for _ in range(3)) for _ in range(600)]
        rows += [(len(rows) + i, " ".join(rnd.choice(words) for _ in range(200)), lang) for i in range(24)]
    # a long sample of the language with many letters, a short one of the others
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = df.where("doc_id % 24 < 12").where("lang = 'zh' or doc_id % 24 < 6")
    got = {r.doc_id: r.lang_pred for r in identify(df, sample(train)).collect()}
    assert [i for i, _, lang in rows if got[i] != lang] == []


def test_language_sample_is_shared_by_its_texts(spark):
    from dictaudit.llm.langid import sample

    # every text has letters of its own; some are far longer than the whole sample
    text = lambda i: chr(0x4E00 + i) * (30_000 if i % 3 == 0 else 900 if i % 3 == 1 else 300)
    df = spark.createDataFrame([(i, text(i), "xx") for i in range(60)], "doc_id long, text string, lang string")
    got = Counter(c for c in sample(df)["xx"] if c.isalpha())
    assert len(got) == 48 and sum(got.values()) == 24_000
    assert max(got.values()) < 24_000 / 20
    # windows come from the whole text, not from its beginning
    halves = spark.createDataFrame([(1, "a" * 200_000 + "b" * 200_000, "xx")], "doc_id long, text string, lang string")
    assert min(Counter(sample(halves)["xx"])[c] for c in "ab") > 8_000


def test_benchmark_item_without_id(spark, tmp_path):
    """Against the query's own SQL."""
    import duckdb

    from dictaudit.llm.queries import ORACLES, QUERIES

    passage = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"before {passage} after"), (2, "nothing of it"), (3, "short item here"), (4, None)]
    items = [(None, passage), (None, "short item"), ("b", "short item here"), (None, None), (None, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    cur = con.execute(ORACLES["op8_decontamination"])
    want = sorted(cur.fetchall())
    columns = [d[0] for d in cur.description]
    got = sorted(tuple(r) for r in QUERIES["op8_decontamination"](spark, str(tmp_path)).select(*columns).collect())
    assert got == want and got[0][2] == 20


def test_rows_with_one_id_and_different_texts_stay(spark):
    from dictaudit.llm.jaccard import keep_one

    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(1, a), (1, b), (1, b), (2, "other words altogether in this text")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in keep_one(df).collect())
    assert got == sorted([(1, a), (1, b), (2, "other words altogether in this text")])
