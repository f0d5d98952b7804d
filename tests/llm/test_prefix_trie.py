"""Operator 13 against a trie of dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

SCHEMA = "conv_id long, turn int, role string, text string, key string, depth int, words int"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        turns = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        n = len(members[path])
        below = [out[c] for c in children[path]]
        saved = (n - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        out[path] = (min(members[path]), len(path), min(members[path[:-1]]) if path else None, n, len(below),
                     sum(b[5] for b in below) or 1, saved + sum(b[6] for b in below),
                     hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest())
    return sorted(out.values(), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations():
    rnd = random.Random(11)
    rows = []
    for c in [*range(0, 130), -3, -40, -41, 10**12, 10**12 + 3]:
        if c in (20, 61):
            continue  # an absent base
        for t in range(rnd.choice([1, 1, 2, 3, 4, 7, 8, 9, 12])):
            rows.append((c, t, rnd.choice(["user", None]), rnd.choice(["hi there", "a\tb  c", "", None])))
    deep = [(t, "user", f"turn {t}") for t in range(27)]
    for c in (300, 301, 302, 303, 304):
        rows += [(c, *t) for t in deep[:27 if c < 303 else 21]]
    rows += [(400, t, "user", f"long {t}") for t in range(60)]
    rows += [(401, None, "user", "null turn"), (401, 1, "user", "same"), (401, 1, "user", "same"), (401, 1, None, "same"),
             (None, 1, "user", "no conversation"), (402, 3, None, None)]
    return [(*r, "k", 1, 2) for r in rows]


def test_trie(spark):
    from dictaudit.llm.prefix_trie import trie

    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(trie(df)) == plain(rows)


def test_trie_of_copies_and_of_nothing(spark):
    from dictaudit.llm.prefix_trie import trie

    rows = [(c, t, "user", f"t{t}", "", 0, 0) for c in range(0, 4000, 20) for t in range(17)]
    assert got(trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert trie(spark.createDataFrame([], SCHEMA)).count() == 0
    turnless = [(21, 0, "user", "x", "", 0, 0), (22, 0, "user", "x", "", 0, 0), (23, 0, "user", "x", "", 0, 0)]
    assert got(trie(spark.createDataFrame(turnless, SCHEMA))) == plain(turnless)


def test_pages_of_many_ends(spark, monkeypatch):
    from dictaudit.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "PAGE_BYTES", 100)
    rows = [(c, 0, "user", "same first turn", "", 0, 0) for c in range(3000)]
    assert got(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
