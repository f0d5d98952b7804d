"""Operator 12 against plain counting of all phrases."""

import random
import re
from collections import Counter, defaultdict

import pytest

SCHEMA = "doc_id long, text string, lang string, shard int, word string, n int"


def plain(rows, top, least=10, percent=50):
    count, size = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(words)
            for k in (1, 2, 3):
                count[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        found = []
        triples = [g for g in f if len(g) == 3 and f[g] >= least]
        longer = defaultdict(int)
        for g in triples:
            for part in (g[:2], g[1:]):
                longer[part] = max(longer[part], f[g])
        for g, a in f.items():
            if len(g) == 1 or a < least or 100 * longer.get(g, 0) >= percent * a and len(g) == 2 and g in longer:
                continue
            score, k = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for i, (s, a, phrase, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, size[lang], -s))
    return sorted(out)


def rows():
    rnd = random.Random(2)
    words = [c + v for c in "bdfgk" for v in "aeiou"] + ["New", "York", "CITY", "é", "ß", "x\x00y", "a\x0bb", "\x1f"]
    data = []
    for i in range(400):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", ";"]) for _ in range(rnd.randrange(60)))
        if i % 4 == 0:
            text += " New york city hall new york CITY"
        data.append((i, text, rnd.choice(["en", "en", "fr", None, "und", ""]), 0, "w", 1))
    data += [(None, None, "en", 0, "w", 1), (7, "", None, 0, "w", 1), (8, "only " * 30, "de", 0, "w", 1)]
    return data + data[:50]


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shards,bits,block", [(2, 26, 1 << 20), (3, 16, 500), (1, 15, 300), (4, 15, 100)])
def test_collocations(spark, monkeypatch, shards, bits, block):
    from dictaudit.llm import collocations as C

    monkeypatch.setattr(C, "BLOCK_WORDS", block)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    for top in (2000, 7):
        assert got(C.collocations(df, top=top, shards=shards, filter_bits=bits)) == plain(data, top)


def test_long_text_in_pieces(spark, monkeypatch):
    from dictaudit.llm import collocations as C

    rnd = random.Random(9)
    text = "".join(rnd.choice(["aa", "b", "ccc", "Dd", "w" * 40]) + rnd.choice([" ", " ", " ", "   ", ". "]) for _ in range(6000))
    data = [(1, text, "en", 0, "", 0), (2, "z" * 5000, "en", 0, "", 0), (3, "q " * 4000, "fr", 0, "", 0), (4, "." * 4000, "en", 0, "", 0)]
    want = plain(data, 2000)
    for chunk in (7, 64, 1000):
        monkeypatch.setattr(C, "CHUNK_BYTES", chunk)
        assert got(C.collocations(spark.createDataFrame(data, SCHEMA))) == want


def test_empty_table(spark):
    from dictaudit.llm.collocations import collocations

    out = collocations(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0
    assert collocations(spark.createDataFrame([(1, "a b c", "en", 0, "", 0)], SCHEMA)).count() == 0
