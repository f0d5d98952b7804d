"""N-gram Jaccard join in size-banded tiles with bitmap signatures (operator 6).

A text's set holds its distinct 5-word shingles (a shorter text: its whole word sequence). Texts
link when the Jaccard similarity of their sets reaches the threshold; the result is the exact
connected component of every text.

1. Equal sets collapse to their smallest id before anything is shuffled: rows whose set is not its id's first
   send no tiles. Tiles then travel as 32 bits each, and once for each run of tiles of a text its id, size and
   need, as differences and byte planes that compress alike however few tiles of a text go to one part.
2. Tiles: sets are banded by size, so that linked sets lie in one band or two neighbouring ones. The
   sets of a pair whose larger one lies in band j differ in at most D_j elements. Band j cuts the
   hash space into somewhat more than D_j buckets; of a set's non-empty buckets at least one then
   holds the same elements in both sets. A tile is (band, bucket, hash of the bucket's elements); a
   set has tiles for its own band and the next. (A set with no more than D_j non-empty buckets also
   gets tiles by single elements, enough for two such sets to meet.) A passage that many texts
   share makes no large tile, because the other elements of a bucket differ.
3. First each text meets one leader, the smallest text of the tile that it meets most often; exact
   links give provisional components. Further rounds take leaders of other components in random
   order. Then all texts of different components meet in their tiles. So a group of thousands of
   copies is connected without comparing it pair by pair.
   A linked set shares at least (its non-empty buckets - D_j) tiles of a band; a text with fewer open
   tiles there sends none.
4. A pair is tested by its signatures, bitmaps that hold the parity of the hashed elements: the bits
   in which they differ bound the overlap from above. They widen with the set, up to MAX_BITS, and
   fold to the narrower one's width. Survivors are intersected as sorted arrays.

Defined cases: null and empty texts and texts without words have an empty set and link with nothing;
rows with equal ids count as one document (its smallest set); a null id links with nothing and has no component; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictaudit.session import discard, materialize, release_shuffles

from .apply import fresh, per_text_rows
from .components import components
from .textscan import LOWER, mix, ngram_hash, same_row, signed, words

N = 5
PERCENT = 80
BITS = 256
MAX_BITS = 4096
ROUNDS = 2
PARTNERS = 8
PART_BYTES = 16 << 20
MAX_SENT_IDS = 4_000_000
_U = np.uint64


def sets(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, sorted by both."""
    w = words(LOWER[data], offsets)
    count = np.bincount(w.row, minlength=len(offsets) - 1)
    keys, rows = [], []
    for k in range(1, n + 1):
        valid = same_row(w.row, k)
        if k < n:
            valid &= (count[w.row[:len(valid)]] == k)
        keys.append(mix(ngram_hash(w.hash, k)[valid] + _U(k)))
        rows.append(w.row[:len(valid)][valid])
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def _fingerprints(row: np.ndarray, key: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free hashes of each row's set."""
    out = []
    for salt in (1, 2):
        sums = np.concatenate([[_U(0)], np.cumsum(mix(key + _U(salt)))])
        bounds = np.searchsorted(row, np.arange(n_rows + 1))
        out.append(signed(sums[bounds[1:]] - sums[bounds[:-1]]))
    return out[0], out[1]


def _scan_sets(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Size, fingerprint and signature of every set."""
    def make():
        def f(ids, data, offsets, _):
            rows = len(offsets) - 1
            row, key = sets(data, offsets, n)
            fp, fp2 = _fingerprints(row, key, rows)
            size = np.bincount(row, minlength=rows)
            return [ids, size, fp, fp2, _signatures(row, key, size, percent)]
        return f

    return per_text_rows(docs, "doc_id long, n long, fp long, fp2 long, bits binary", make, id_col, text_col)


class Bands:
    """Size bands: largest size, most differing elements of a linked pair, and buckets of each."""

    def __init__(self, percent: int, largest: int):
        top = [1]
        while top[-1] < largest:
            top.append(max(top[-1] + 1, top[-1] * 100 // percent))
        top.append(max(top[-1] + 1, top[-1] * 100 // percent))
        self.top = np.array(top, np.int64)
        self.differ = 2 * self.top * (100 - percent) // (100 + percent)
        self.buckets = self.differ * 6 // 5 + 3

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.top, size)


def _tile_keys(row: np.ndarray, key: np.ndarray, size: np.ndarray, bands: Bands, percent: int):
    """Row, tile and need of every set (elements sorted by row and hash). The need of a tile of a
    set's own band is the least number of such tiles that it shares with a linked set of no larger
    band; that of a tile of the next band has a minus sign; single elements need 1."""
    rows, tiles, needs = [], [], []
    summed = np.concatenate([[_U(0)], np.cumsum(mix(key))])
    few = np.zeros(len(size), bool)
    for step in (0, 1):
        band = bands.of(size) + step
        bucket = ((key >> _U(32)) * bands.buckets[band[row]].astype(np.uint64)) >> _U(32)
        lead = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])])[:len(row)])
        content = summed[np.append(lead[1:], len(row))] - summed[lead]
        rows.append(row[lead])
        tiles.append(mix(content * _U(0xD6E8FEB86659FD93) + mix(bucket[lead] * _U(4096) + band[row[lead]].astype(np.uint64))))
        spare = np.bincount(row[lead], minlength=len(size)) - bands.differ[band]
        few |= spare <= 0
        needs.append((-1 if step else 1) * np.maximum(spare, 1)[row[lead]])
    # too few buckets: the first elements, of which two linked sets share one
    rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(size)))[row]
    single = few[row] & (rank < (size - (percent * size + 99) // 100 + 1)[row])
    rows.append(row[single])
    tiles.append(mix(key[single] + _U(1)))
    needs.append(np.ones(single.sum(), np.int64))
    return np.concatenate(rows), np.concatenate(tiles), np.concatenate(needs)


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then their second bytes and so on: small numbers leave long runs of zeros."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _first_rows(docs: DataFrame, sized: DataFrame, reps: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """The rows (doc, text) whose id is the smallest of their set."""
    judged = sized.where("n > 0 and doc_id is not null").join(reps, ["n", "fp", "fp2"]).groupBy("doc_id").agg(
        F.bool_or(F.col("doc_id") == F.col("rep")).alias("first"), F.bool_and(F.col("doc_id") == F.col("rep")).alias("only"))
    later = materialize(judged.where("not only").select(F.col("doc_id").alias("doc"), "first"), "jaccard-copies")
    # an id may have several texts, of which some are the first of their set
    mixed, some = later.where("first").select("doc"), later.select("doc")
    if later.count() <= MAX_SENT_IDS:  # 8 bytes each; beyond, Spark joins by shuffling the texts
        mixed, some = F.broadcast(mixed), F.broadcast(some)
    there = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    alone = there.join(some, "doc", "left_anti")
    if later.where("first").isEmpty():
        return alone

    def make():
        def f(ids, data, offsets, texts):
            rows = len(offsets) - 1
            row, key = sets(data, offsets, n)
            fp, fp2 = _fingerprints(row, key, rows)
            return [ids, texts.cast(pa.string()), np.bincount(row, minlength=rows), fp, fp2]
        return f

    several = per_text_rows(there.join(mixed, "doc", "left_semi"), "doc long, text string, n long, fp long, fp2 long", make, "doc", "text")
    return alone.unionByName(several.join(reps.withColumnRenamed("rep", "doc"), ["doc", "n", "fp", "fp2"], "left_semi").select("doc", "text"))


def _tile_rows(docs: DataFrame, bands: Bands, id_col: str, text_col: str, n: int, percent: int, parts: int) -> DataFrame:
    """Packed tiles, one row per slice and part of the tiles: the tiles, and of each run of tiles of one text and need
    the id (as a difference to the run before), size, need and length."""
    def make():
        def f(ids, data, offsets, _):
            rows = len(offsets) - 1
            row, key = sets(data, offsets, n)
            size = np.bincount(row, minlength=rows)
            known = (size > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
            num = ids.fill_null(0).to_numpy(zero_copy_only=False)
            keep = known[row]
            row, key = row[keep], key[keep]
            row, tile, need = _tile_keys(row, key, np.bincount(row, minlength=rows), bands, percent)
            # the part and 32 bits of hash name a tile; a chance collision only adds a candidate
            part = ((tile >> _U(32)) % _U(parts)).astype(np.int64)
            order = np.lexsort((need, row, part))
            row, tile, part, need = row[order], (tile[order] & _U(0xFFFFFFFF)).astype(np.uint32), part[order], need[order]
            new = np.ones(len(row), bool)
            new[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1]) | (need[1:] != need[:-1])
            run = np.flatnonzero(new)
            cut = np.searchsorted(part, np.arange(parts + 1))
            full = np.flatnonzero(cut[1:] > cut[:-1])
            runs = np.searchsorted(run, cut)
            owner = num[row[run]]
            step = np.diff(owner, prepend=0)
            step[runs[full]] = owner[runs[full]]  # a packed row starts from 0
            cols = step, size[row[run]].astype(np.int32), need[run].astype(np.int32), np.diff(np.append(run, len(row))).astype(np.int32)
            return [full, [tile[cut[p]:cut[p + 1]].tobytes() for p in full]] + [[_planes(c[runs[p]:runs[p + 1]]) for p in full] for c in cols]
        return f

    return per_text_rows(docs, "part long, tile binary, id binary, n binary, need binary, times binary", make, id_col, text_col)


def _tiles(t: pa.Table, percent: int) -> pa.Table:
    """Rows of the tiles with at least two different sets, each with its leader: the smallest set of
    its size band in the tile."""
    read = lambda c, kind: [_from_planes(x, kind) for x in t.column(c).to_pylist()]
    token = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("tile").to_pylist()]).astype(np.int64)
    times = np.concatenate(read("times", np.int32))
    num = np.repeat(np.concatenate([np.cumsum(x) for x in read("id", np.int64)]), times)
    n, need = (np.repeat(np.concatenate(read(c, np.int32)).astype(np.int64), times) for c in ("n", "need"))
    order = np.lexsort((need, num, n, token))
    token, num, n, need = token[order], num[order], n[order], need[order]
    # a row may be given twice
    first = np.ones(len(token), bool)
    first[1:] = (token[1:] != token[:-1]) | (n[1:] != n[:-1]) | (num[1:] != num[:-1]) | (need[1:] != need[:-1])
    token, num, n, need = token[first], num[first], n[first], need[first]
    same = token[1:] == token[:-1]
    met = np.zeros(len(token), bool)
    met[1:] |= same
    met[:-1] |= same
    token, num, n, need = token[met], num[met], n[met], need[met]
    lead = _leaders(token, n, percent)
    part = t.column("part")[0].as_py()
    return pa.table({"part": pa.array(np.full(len(token), part), pa.int64()), "token": token, "doc": num, "n": n, "need": need,
                     "leader": pa.array(num[lead], mask=lead == np.arange(len(lead)))})


def _leaders(token: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """For rows sorted by tile and size: the first row of each row's size band in its tile."""
    lead = np.arange(len(token))
    open_ = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])[:len(token)])
    end = np.append(open_[1:], len(token))[:len(open_)]
    while len(open_):  # all tiles advance one band at a time
        stop = _band_end(n, open_, end, n[open_] * 100 // percent)
        count = stop - open_
        lead[np.repeat(open_ - (np.cumsum(count) - count), count) + np.arange(count.sum())] = np.repeat(open_, count)
        more = stop < end
        open_, end = stop[more], end[more]
    return lead


def _band_end(n: np.ndarray, lo: np.ndarray, hi: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """First row of each range [lo, hi) whose size exceeds the limit (binary search in all ranges)."""
    lo, hi = lo.copy(), hi.copy()
    while (lo < hi).any():
        mid = (lo + hi) // 2
        inside = lo < hi
        low = inside & (n[np.minimum(mid, len(n) - 1)] <= limit)
        lo[low] = mid[low] + 1
        high = inside & ~low
        hi[high] = mid[high]
    return lo


def _signatures(row: np.ndarray, key: np.ndarray, size: np.ndarray, percent: int) -> list[bytes]:
    """Parity bitmap of each set, with about eight bits for each element in which a linked set may
    differ (a power of two between BITS and MAX_BITS)."""
    differ = np.maximum(2 * size * (100 - percent) // (100 + percent), 1)
    width = np.clip(2 ** np.ceil(np.log2(8 * differ)).astype(np.int64), BITS, MAX_BITS)
    out = np.empty(len(size), object)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        place = np.zeros(len(size), np.int64)
        place[at] = np.arange(len(at))
        for lo in range(0, len(at), 4096):
            some = at[lo:lo + 4096]
            mine = np.zeros(len(size), bool)
            mine[some] = True
            mine = mine[row]
            bit = (key[mine] >> _U(64 - int(np.log2(w)))).astype(np.int64)
            odd = np.bincount((place[row[mine]] - lo) * w + bit, minlength=len(some) * w).reshape(len(some), w) & 1
            out[some] = [x.tobytes() for x in np.packbits(odd.astype(np.uint8), axis=1)]
    return out.tolist()


def _folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (rows x bytes) of half the width: each bit is the parity of two neighbours."""
    pairs = np.unpackbits(bits, axis=1).reshape(len(bits), -1, 2)
    return np.packbits(pairs[:, :, 0] ^ pairs[:, :, 1], axis=1)


class _Bitmaps:
    """Signatures of several rows, readable at each width up to their own."""

    def __init__(self, column: list[bytes]):
        self.bytes = np.fromiter(map(len, column), np.int64, len(column))
        self.at, wider = {}, (np.zeros(0, np.int64), None)
        for w in np.unique(self.bytes)[::-1]:
            own = np.flatnonzero(self.bytes == w)
            bits = np.frombuffer(b"".join(column[i] for i in own), np.uint8).reshape(len(own), w)
            rows, more = wider
            while len(rows) and more.shape[1] > w:
                more = _folded(more)
            rows, bits = np.concatenate([rows, own]), np.concatenate([more, bits]) if len(rows) else bits
            place = np.zeros(len(column), np.int64)
            place[rows] = np.arange(len(rows))
            self.at[w] = place, np.ascontiguousarray(bits).view(np.uint64)
            wider = rows, bits

    def overlap_bound(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Most elements that the sets of rows a and b can share: each differing parity bit needs an
        element in only one."""
        differ = np.zeros(len(a), np.int64)
        width = np.minimum(self.bytes[a], self.bytes[b])
        for w, (place, bits) in self.at.items():
            some = np.flatnonzero(width == w)
            for lo in range(0, len(some), 1 << 16):
                s = some[lo:lo + (1 << 16)]
                differ[s] = np.bitwise_count(bits[place[a[s]]] ^ bits[place[b[s]]]).sum(axis=1, dtype=np.int64)
        return (n_a + n_b - differ) // 2


def _links(overlap, n_a, n_b, percent: int):
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def _members(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Size and sorted set of the texts in the pairs."""
    def make():
        def f(ids, data, offsets, _):
            rows = len(offsets) - 1
            row, key = sets(data, offsets, n)
            cut = np.searchsorted(row, np.arange(rows + 1))
            return [ids, np.diff(cut), [key[a:b].tobytes() for a, b in zip(cut, cut[1:])]]
        return f

    wanted = materialize(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "jaccard-wanted")
    if wanted.count() <= MAX_SENT_IDS:  # 8 bytes each; beyond, Spark joins by shuffling the texts
        wanted = F.broadcast(wanted)
    there = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return per_text_rows(there.join(wanted, "doc", "left_semi"), "doc long, n long, elements binary", make,
                         "doc", "text")


def _possible(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their signatures allow to link."""
    side = lambda s: signatures.select(F.col("doc").alias(s), F.col("n").alias("n" + s), F.col("bits").alias("bits" + s))

    def run(batches):
        for t in batches:
            if len(t):
                na, nb = t.column("na").to_numpy(), t.column("nb").to_numpy()
                bits, at = _Bitmaps(t.column("bitsa").to_pylist() + t.column("bitsb").to_pylist()), np.arange(len(t))
                ok = pa.array(_links(bits.overlap_bound(at, len(t) + at, na, nb), na, nb, percent))
                yield pa.RecordBatch.from_arrays([t.column("a").filter(ok), t.column("b").filter(ok)], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(
        run, "a long, b long")


def _verified(pairs: DataFrame, signatures: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int,
              percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    pairs = materialize(_possible(pairs, signatures, percent), "jaccard-pairs")
    members = materialize(_members(docs, pairs, id_col, text_col, n), "jaccard-members")
    side = lambda s: members.select(F.col("doc").alias(s), F.col("n").alias("n" + s), F.col("elements").alias("el" + s))
    both = pairs.join(side("a"), "a").join(side("b").join(pairs.select("b").distinct(), "b", "left_semi"), "b")

    def run(batches):
        for t in batches:
            na, nb, ea, eb = (t.column(c) for c in ("na", "nb", "ela", "elb"))
            ok = np.zeros(len(t), bool)
            for i in range(len(t)):
                x = np.concatenate([np.frombuffer(ea[i].as_py(), np.uint64), np.frombuffer(eb[i].as_py(), np.uint64)])
                x.sort(kind="stable")
                ok[i] = _links(int((x[1:] == x[:-1]).sum()), na[i].as_py(), nb[i].as_py(), percent)
            yield pa.RecordBatch.from_arrays([t.column("a").filter(pa.array(ok)), t.column("b").filter(pa.array(ok))], ["a", "b"])

    return both.select("a", "b", "na", "nb", "ela", "elb").mapInArrow(run, "a long, b long")


def _read(t: pa.Table):
    """Order and arrays of a part's tile rows that lie in tiles of several components."""
    token, doc, n, comp = (t.column(c).to_numpy() for c in ("token", "doc", "n", "component"))
    order = np.lexsort((doc, n, token))
    start = np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]])[:len(order)])
    if len(order):
        mixed = np.minimum.reduceat(comp[order], start) < np.maximum.reduceat(comp[order], start)
        order = order[np.repeat(mixed, np.diff(np.append(start, len(order))))]
    return order, token[order], doc[order], n[order], comp[order]


def _open(t: pa.Table) -> pa.Table:
    """Tile rows that can still give links between components."""
    return t.select(["part", "token", "doc", "n", "need"]).take(pa.array(_read(t)[0]))


def _pairs(doc, n, a, b) -> pa.Table:
    """Distinct pairs, the size of the first and how often they meet."""
    code, times = np.unique(np.stack([doc[a], doc[b], n[a]], 1), axis=0, return_counts=True)
    return pa.table({"a": code[:, 0], "b": code[:, 1], "n": code[:, 2], "times": pa.array(times, pa.int64())})


def _drawn(t: pa.Table, percent: int, salt: int) -> pa.Table:
    """Each text with the next text of its tile in a random order, if components and sizes allow a
    link: at most one pair for each tile row."""
    _, token, doc, n, comp = _read(t)
    order = np.lexsort((mix(doc.view(np.uint64) + _U(salt)), token))
    a, b = order[:-1], order[1:]
    keep = (token[a] == token[b]) & (comp[a] != comp[b]) & (percent * np.maximum(n[a], n[b]) <= 100 * np.minimum(n[a], n[b]))
    return _pairs(doc, n, a[keep], b[keep])


def _meetings(t: pa.Table, percent: int) -> pa.Table:
    """All pairs of a part's tiles that components, sizes and signatures allow to link, with the
    number of tiles of the larger set's own band that they share here and need in all."""
    order, token, doc, n, comp = _read(t)
    need = t.column("need").to_numpy()[order]
    names, first, at = np.unique(doc, return_index=True, return_inverse=True)
    bits = _Bitmaps(t.column("bits").take(pa.array(order[first])).to_pylist())
    least = np.zeros(len(names), np.int64)
    np.maximum.at(least, at, need)
    found, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, alive, shift = [], np.arange(len(token)), 1

    def counted():
        code, inverse = np.unique(np.concatenate([found, *held]), return_inverse=True)
        more = np.concatenate([times, np.ones(sum(map(len, held)), np.int64)])
        return code, np.bincount(inverse, more, len(code)).astype(np.int64)

    while len(alive):
        alive = alive[alive + shift < len(token)]
        alive = alive[(token[alive] == token[alive + shift]) & (percent * n[alive + shift] <= 100 * n[alive])]
        b = alive + shift  # the larger set
        keep = (comp[alive] != comp[b]) & (need[b] > 0)
        a, b = alive[keep], b[keep]
        ok = _links(bits.overlap_bound(at[a], at[b], n[a], n[b]), n[a], n[b], percent)
        held.append(at[b[ok]] * len(names) + at[a[ok]])
        if sum(map(len, held)) > 1_000_000:
            found, times = counted()
            held = []
        shift += 1
    found, times = counted()
    size = max(len(names), 1)
    return pa.table({"a": names[found // size], "b": names[found % size], "times": times, "need": least[found // size]})


def _joined(named: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links."""
    name = lambda s: named.select(F.col("node").alias(s), F.col("component").alias("c" + s))
    between = (links.join(name("a"), "a", "left").join(name("b"), "b", "left")
               .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    merged = components(between).select(F.col("node").alias("component"), F.col("component").alias("merged"))
    own = named.union(merged.select(F.col("component").alias("node"), "component")).groupBy("node").agg(
        F.min("component").alias("component"))
    return own.join(merged, "component", "left").select("node", F.coalesce("merged", "component").alias("component"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N,
                       percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles and component_id."""
    scanned = materialize(_scan_sets(docs, id_col, text_col, n, percent), "jaccard-sets")
    total, largest = scanned.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
    bands = Bands(percent, max(largest, 1))
    parts = max(1, -(-total * 24 // (2 * PART_BYTES)))
    sized = scanned.select("doc_id", "n", "fp", "fp2")
    reps = materialize(sized.where("n > 0").groupBy("n", "fp", "fp2").agg(F.min("doc_id").alias("rep")), "jaccard-reps")
    sent = _tile_rows(_first_rows(docs, sized, reps, id_col, text_col, n), bands, "doc", "text", n, percent, parts)
    tiles = materialize(sent.repartition(parts, "part").groupBy("part").applyInArrow(
        lambda t: _tiles(t, percent), "part long, token long, doc long, n long, need long, leader long"), "jaccard-tiles")

    # of rows that share an id the one with the smallest set and fingerprint counts
    signatures = scanned.where("doc_id is not null").groupBy(F.col("doc_id").alias("doc")).agg(
        F.min(F.struct("n", "fp", "fp2", "bits")).alias("s")).select("doc", "s.n", "s.bits")

    def linked(pairs: DataFrame, partners: int) -> DataFrame:
        """Links of each text with the partners that it meets most often. Signatures say little about
        large sets; large ones that meet in few tiles wait for the last step."""
        best = (pairs.groupBy("a", "b", "n").agg(F.sum("times").alias("times"))
                .where(F.col("times") * 40 >= F.when(F.col("n") > 2 * BITS, F.col("n")).otherwise(0)).groupBy("a")
                .agg(F.slice(F.sort_array(F.collect_list(F.struct(-F.col("times"), "b"))), 1, partners).alias("best"))
                .select("a", F.explode("best.b").alias("b")))
        return _verified(best, signatures, docs, id_col, text_col, n, percent)

    # a leader met in very few tiles waits for the later steps
    led = (tiles.where("leader is not null").groupBy(F.col("doc").alias("a"), F.col("leader").alias("b"), "n")
           .agg(F.count("*").alias("times")).where(F.col("times") * 40 >= F.col("n")))
    named = materialize(components(linked(led, 1)), "jaccard-components")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(named.withColumnRenamed("node", "doc"), "doc", "left").withColumn(
            "component", F.coalesce("component", "doc")).repartition(parts, "part")

    # tiles in which texts of different components meet
    still = "part long, token long, doc long, n long, need long"
    open_ = materialize(placed(tiles.select("part", "token", "doc", "n", "need")).groupBy("part").applyInArrow(_open, still), "jaccard-open")
    discard(tiles)
    release_shuffles(docs.sparkSession)

    def draw(salt: int):
        return lambda t: _drawn(t, percent, salt)

    for salt in range(1, ROUNDS + 1):
        drawn = placed(open_).groupBy("part").applyInArrow(draw(salt), "a long, b long, n long, times long")
        links = materialize(linked(drawn, PARTNERS), "jaccard-links")
        if links.isEmpty():
            break
        named = materialize(_joined(named, links), "jaccard-components")
    # only tiles that still mix components get signatures
    before = open_
    open_ = materialize(placed(before).groupBy("part").applyInArrow(_open, still), "jaccard-open")
    discard(before)
    enough = open_.groupBy("doc", "need").count().where("count >= abs(need)")
    last = open_.join(enough, ["doc", "need"], "left_semi").join(signatures.select("doc", "bits"), "doc")
    more = (placed(last).groupBy("part")
            .applyInArrow(lambda t: _meetings(t, percent), "a long, b long, times long, need long")
            .groupBy("a", "b").agg(F.sum("times").alias("times"), F.min("need").alias("need")).where("times >= need").select("a", "b"))
    final = _joined(named, _verified(more, signatures, docs, id_col, text_col, n, percent))

    named = reps.join(final, F.col("rep") == F.col("node"), "left").select(
        "n", "fp", "fp2", F.coalesce("component", "rep").alias("component"))
    return (sized.join(named, ["n", "fp", "fp2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(
                F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, without near duplicates: of each component the smallest id
    stays, once; rows without id all stay. Of rows that share an id only those with equal texts are cut to
    one."""
    found = jaccard_components(docs, id_col, text_col, n, percent).where("doc_id is not null")
    judged = materialize(found.groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("times"))
                         .where("c <> doc_id or times > 1"), "jaccard-dropped")
    repeated = judged.where("c = doc_id").select("doc_id")
    if judged.count() <= MAX_SENT_IDS:
        judged, repeated = F.broadcast(judged), F.broadcast(repeated)
    own = F.col(id_col).cast("long")
    name = fresh(docs, "judged_id")
    alone = docs.join(judged.select(F.col("doc_id").alias(name)), own == F.col(name), "left_anti")
    several = docs.join(repeated.select(F.col("doc_id").alias(name)), own == F.col(name), "left_semi")
    return alone.unionByName(several.dropDuplicates([id_col, text_col]))
