"""SentencePiece BPE encoding and decoding by a merge-type prefix table (operator 1).

For every prefix of a text BPE gives exactly one last token. An Aho-Corasick automaton over the
vocabulary lists the tokens that end at a position; the last token is the one that is compatible
with the last token of the prefix before it. Two tokens are compatible when BPE, replayed backwards
from both, never had a better merge across their border. The ids are then read backwards through the
table. One pass, linear in the text, whatever its length.

No piece holds the space mark behind another character, so the text is cut before runs of space
marks, and around characters that are in no longer piece, without changing the result; encodings of
short cuts are cached up to a bound, as packed ids under the cut with plain spaces (few bytes an entry).

The tables come from a model file (path on the driver) and are broadcast; they are as large as the
vocabulary. Scores rank merges, equal scores go from left to right, as in the library.

Defined cases: null and empty texts give no ids and an empty decoded text; repeated rows give
repeated result rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .apply import per_text, ship, shipped

SPACE_MARK = "▁"
CACHE_ENTRIES = 150_000  # in each of two generations
CACHED_CHARS = 48
PAIR_ENTRIES = 1_000_000
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class Model:
    """Vocabulary, ranks and last merges; plain data, so that it can be broadcast."""

    def __init__(self, pieces: list[tuple[str, float, int]], add_dummy_prefix: bool):
        kinds = {k for _, _, k in pieces}
        if not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.add_dummy_prefix = add_dummy_prefix
        self.piece = [p for p, _, _ in pieces]
        self.kind = [k for _, _, k in pieces]
        self.unknown = self.kind.index(_UNKNOWN)
        self.byte_id = [self.piece.index(f"<0x{b:02X}>") for b in range(256)] if _BYTE in kinds else None
        self.id = {p: i for i, (p, _, k) in enumerate(pieces) if k == _NORMAL}
        self.rank = {self.id[p]: -s for p, s, k in pieces if k == _NORMAL}
        # characters of longer pieces that are no pieces themselves get numbers behind the vocabulary
        self.base = {p: i for p, i in self.id.items() if len(p) == 1}
        self.loose: list[str] = []
        joined = set()
        for p in self.id:
            if len(p) > 1:
                joined.update(p)
                if SPACE_MARK in p.lstrip(SPACE_MARK):
                    raise ValueError("pieces with an inner space mark are not supported")
        for c in sorted(joined - self.base.keys()):
            self.base[c] = len(self.piece) + len(self.loose)
            self.loose.append(c)
        self.joined = joined
        self.split: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], float] = {}
        self._last_merges()

    @classmethod
    def load(cls, path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        n = proto.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("only identity normalisation is supported")
        if proto.trainer_spec.model_type != 2 or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with the space mark in front are supported")
        return cls([(p.piece, p.score, p.type) for p in proto.pieces], n.add_dummy_prefix)

    def number(self, text: str) -> int | None:
        return self.id.get(text) if len(text) > 1 else self.base.get(text)

    def cut_pattern(self) -> str:
        """Pattern of the cuts of a text: at borders that no piece reaches across, so that BPE of the
        cuts is BPE of the text."""
        letter = re.compile(r"[^\W\d_]")
        lone = "".join(re.escape(c) for c in map(chr, range(0x20)) if c not in self.joined)
        end = f"|[{lone}]" if lone else ""
        if any(bool(letter.match(a)) != bool(letter.match(b)) for p in self.id for a, b in zip(p, p[1:]) if a != SPACE_MARK):
            return f"{SPACE_MARK}*[^{SPACE_MARK}{lone}]+|{SPACE_MARK}+" + end
        # no piece joins a letter with another character
        return rf"{SPACE_MARK}*(?:[^\W\d_]+|(?:(?![{SPACE_MARK}{lone}])[\W\d_])+)|{SPACE_MARK}+" + end

    def _last_merges(self) -> None:
        """Last merge of every piece that BPE reaches from its characters; all pairs that merge."""
        for p, i in self.id.items():
            for k in range(1, len(p)):
                a, b = self.number(p[:k]), self.number(p[k:])
                if a is not None and b is not None:
                    self.pair[a, b] = self.rank[i]
        for p, i in self.id.items():
            if len(p) == 1:
                continue
            parts, merge = list(p), None
            while len(parts) > 1:
                best = min(((self.rank[j], k) for k in range(len(parts) - 1)
                            if (j := self.id.get(parts[k] + parts[k + 1])) is not None), default=None)
                if best is None:
                    break
                k = best[1]
                merge = parts[k], parts[k + 1]
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 1 and merge:
                self.split[i] = self.number(merge[0]), self.number(merge[1])
        for i, (a, b) in self.split.items():
            if max(self.rank[x] if x in self.split else -np.inf for x in (a, b)) > self.rank[i]:
                raise ValueError("a piece outranks its own parts; merge order can't be replayed")

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b side by side: undo their merges, latest first, and look for a
        merge across the border that would have come earlier."""
        limit, undone_left = np.inf, True
        while True:
            cross = self.pair.get((a, b))
            if cross is not None and (cross < limit or cross == limit and not undone_left):
                return False
            left = self.rank[a] if a in self.split else None
            right = self.rank[b] if b in self.split else None
            if left is None and right is None:
                return True
            if right is None or left is not None and left > right:
                limit, undone_left, a = left, True, self.split[a][1]
            else:
                limit, undone_left, b = right, False, self.split[b][0]


class Coder:
    """Per-worker automaton and caches over a Model."""

    def __init__(self, model: Model):
        self.m = model
        self.automaton = ahocorasick.Automaton()
        for p, i in model.id.items():
            if len(p) == 1 or i in model.split:
                self.automaton.add_word(p, (len(p), i))
        for c in model.loose:
            self.automaton.add_word(c, (1, model.base[c]))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.shift = (len(model.piece) + len(model.loose)).bit_length()
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.plain = [p.replace(SPACE_MARK, " ") if k == _NORMAL else None
                      for p, k in zip(model.piece, model.kind, strict=True)]
        for b, i in enumerate((model.byte_id or [])[:128]):  # these are characters by themselves
            self.plain[i] = chr(b)
        self.cuts = re.compile(model.cut_pattern().replace(SPACE_MARK, " "))

    def _bytes(self, c: str) -> list[int]:
        return [self.m.byte_id[b] for b in c.encode()] if self.m.byte_id else [self.m.unknown]

    def encode_cut(self, cut: str) -> tuple[int, ...]:
        n = len(cut)
        last, size = [-1] * (n + 1), [1] * (n + 1)  # last token of each prefix; -1: a character outside the vocabulary
        pairs, compatible, shift = self.pairs, self.m.compatible, self.shift
        done = 0
        for end, (length, token) in self.automaton.iter(cut):
            end += 1
            if done == end:
                continue
            before = last[end - length] if end > length else -1
            if before >= 0:
                key = before << shift | token
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) >= PAIR_ENTRIES:
                        pairs.clear()
                    ok = pairs[key] = compatible(before, token)
                if not ok:
                    continue
            last[end], size[end], done = token, length, end
        out, at, vocabulary = [], n, len(self.m.piece)
        while at:
            token = last[at]
            if 0 <= token < vocabulary:
                out.append(token)
            else:
                out.extend(reversed(self._bytes(cut[at - 1])))
            at -= size[at]
        return tuple(reversed(out))

    def _cut(self, cut: str) -> bytes:
        """Packed ids of a cut whose space marks are spaces."""
        got = self.older.get(cut)
        if got is None:
            got = array("i", self.encode_cut(cut.replace(" ", SPACE_MARK))).tobytes()
            if len(cut) > CACHED_CHARS:
                return got
        if len(self.cache) >= CACHE_ENTRIES:
            self.older, self.cache = self.cache, {}
        self.cache[cut] = got
        return got

    def decode_inner(self, ids) -> str:
        """Text of ids without the rule for the first space mark."""
        plain = self.plain
        try:
            return "".join([plain[i] for i in ids])
        except TypeError:  # ids of bytes or marks
            out, raw = [], bytearray()
        for i in ids:
            kind = self.m.kind[i]
            if kind == _BYTE:
                raw.append(int(self.m.piece[i][3:5], 16))
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if kind == _NORMAL:
                out.append(self.m.piece[i])
            elif kind == _UNKNOWN:
                out.append(" ⁇ ")
        if raw:
            out.append(_utf8(bytes(raw)))
        return "".join(out).replace(SPACE_MARK, " ")

    def decode(self, ids) -> str:
        text = self.decode_inner(ids)
        first = next((i for i in ids if self.m.kind[i] != _CONTROL), None)
        drop = self.m.add_dummy_prefix and first is not None and self.m.piece[first].startswith(SPACE_MARK)
        return text[1:] if drop else text

    def both(self, text: str) -> tuple[np.ndarray, str]:
        """Ids of a text, and the text decoded from these ids."""
        if not text:
            return np.zeros(0, np.int32), ""
        marked = text.replace(SPACE_MARK, " ")  # both are the space mark
        if self.m.add_dummy_prefix:
            marked = " " + marked
        cuts = self.cuts.findall(marked)
        get, cut = self.cache.get, self._cut
        ids = np.frombuffer(b"".join([get(c) or cut(c) for c in cuts]), np.int32)
        return ids, self.decode(ids.tolist())


def _utf8(raw: bytes) -> str:
    """UTF-8 text; every byte that starts no valid character becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[i:i + size].decode())
                i += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``ids`` of the whole text and ``decoded``, the text of these ids."""
    held = ship(docs.sparkSession, Model.load(model_path))

    def make():
        coder = _coder(held)

        def f(data, offsets, texts):
            ids, decoded = [], []
            for t in texts.to_pylist():
                i, d = coder.both(t or "")
                ids.append(i)
                decoded.append(d)
            ends = np.cumsum([0] + [len(i) for i in ids]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            return [lists, decoded]
        return f

    return per_text(docs, "ids array<int>, decoded string", make, id_col, text_col)


_coders: dict = {}


def _coder(held) -> Coder:
    """The worker's coder for a broadcast model: automaton and caches outlive a task."""
    key = held.id if hasattr(held, "id") else id(held)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(shipped(held))
    return _coders[key]


def token_digests(encoded: DataFrame) -> DataFrame:
    """Digest columns of ``encode_decode``."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
