"""Routing of repeated windows, shared by the two substring deduplication operators.

Every window (w consecutive units: bytes or words) has a minimizer, the leftmost smallest hash of the
m-unit strings inside it. Equal windows have equal minimizers at equal offsets, so consecutive
windows with one minimizer (a super-window) go to the bucket of its hash, and all occurrences of a
window meet there. Texts are dealt into blocks by a hash of id and text, and a block sends each
distinct thing once, so a key has at most one entry a block however many texts hold it:

1. ``anchors``: distinct minimizers (4 bytes of hash inside a key range, a text fingerprint, the
   number of occurrences). A key range answers each block with its minimizers that two different
   texts share, and with which of them are hot.
2. ``pieces`` of shared anchors only: each distinct super-window with the smallest and the largest id
   that the block has it in. The edges of a passage that many texts share give a super-window a text,
   all with one minimizer; so the windows of a hot minimizer are pieces of their own, in the bucket of
   the window's own hash. The answer is the smallest id of each window; the block, which keeps where
   its super-windows occur, marks its texts.

A bucket thus holds, of one key, at most ``HOT`` super-windows or one window a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dictaudit.session import discard, materialize, release_shuffles

from .textscan import _power_table, mix, prefix_hash, range_hash, text_slices

BLOCK_BYTES = 8 << 20
SLICE_BYTES = 512 << 10  # about 70 bytes of arrays a byte of text are alive at once
HOT = 4096  # a minimizer with more occurrences is hot: its windows are routed one by one
POSITION_BITS = np.uint64(30)  # a text has fewer than 2**30 units
_MASK = np.uint64((1 << 30) - 1)


def window_anchors(unit: np.ndarray, row: np.ndarray, gram: np.ndarray, window: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window inside one row: its start and the position of its minimizer. ``gram`` has
    the hash of the m units from each position on."""
    n = len(unit) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = window - m + 1
    low = (gram & ~_MASK) | np.arange(len(gram), dtype=np.uint64)
    size = 1
    while size < width:
        step = min(size, width - size)
        low = np.minimum(low[:len(low) - step], low[step:])
        size += step
    valid = np.flatnonzero(row[:n] == row[window - 1:])
    return valid, (low[valid] & _MASK).astype(np.int64)


def blocked(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES,
            keep: bool = False) -> tuple[DataFrame, int]:
    """doc_id, text and block (by a hash of id and text), and the number of blocks. ``keep`` carries
    all other columns in a struct ``row``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       *([F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("row")] if keep else []))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(2, -(-size // block_bytes))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks).cast("long"))), blocks


def _packed(part, columns, parts, kinds):
    """Arrays cut by part: one row per part that has elements."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    full = np.flatnonzero(cut[1:] > cut[:-1])
    at = [order[cut[p]:cut[p + 1]] for p in full]
    return [pa.array(full, pa.int64())] + [pa.array([c[i].astype(k, copy=False).tobytes() for i in at], pa.binary())
                                           for c, k in zip(columns, kinds, strict=True)]


def _unpacked(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)


def _part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _code(key: np.ndarray, parts: int) -> np.ndarray:
    """Key range and 32 bits of each minimizer as one number."""
    return (_part_of(key, parts) << 32) | (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _content(unit: np.ndarray) -> np.ndarray:
    """Prefix sums from which range_hash gets the hash of any range of units."""
    if unit.dtype == np.uint8:
        return prefix_hash(unit)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(unit) * _power_table("up", len(unit)))])


def _starts(key: np.ndarray) -> np.ndarray:
    """First index of each run of equal elements."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])


def _meet(key: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of equal elements."""
    lo, hi = np.searchsorted(ordered, key), np.searchsorted(ordered, key, side="right")
    n = hi - lo
    return np.repeat(np.arange(len(key)), n), np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)


OCCURRENCE, LEAST, LINK, RANGE = range(4)  # kinds of rows that go to a block
TO_BLOCK = "block long, kind int, doc binary, start binary, end binary"


def repeated_windows(docs: DataFrame, blocks: int, units: Callable, window: int, m: int, pack: Callable,
                     kind, solve: Callable) -> DataFrame:
    """What the blocks of ``docs`` (see blocked()) need to mark covered unit ranges (see with_ranges()).

    ``units(data, offsets) -> (unit, row, gram, first unit of each row)``; ``pack`` turns
    super-windows into an array of ``kind``, ``solve`` a bucket's arrays into the smallest id that
    each window occurs in.
    """
    parts = 3 * blocks  # buckets are indexed in memory, so they are smaller than blocks
    hot_rows = HOT
    docs = docs.where("doc_id is not null")

    def anchors(t: pa.Table) -> pa.Table:
        fps, codes, texts = t.column("fp").to_numpy(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b, data, offsets in text_slices(t.column("text"), SLICE_BYTES):
            unit, row, gram, _ = units(data, offsets)
            _, at = window_anchors(unit, row, gram, window, m)
            chosen = np.zeros(len(unit), bool)
            chosen[at] = True
            chosen = np.flatnonzero(chosen)
            codes.append(_code(gram[chosen], blocks))
            texts.append(fps[a:b][row[chosen]])
        code, fp = np.concatenate(codes), np.concatenate(texts)
        order = np.argsort(code)
        code, fp = code[order], fp[order]
        start = _starts(code)
        if not len(start):
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())],
                            names=["part", "block", "key", "fp", "count"])
        least = np.minimum.reduceat(fp, start)
        count = 2 * np.diff(np.append(start, len(code))) + (least < np.maximum.reduceat(fp, start))
        cols = _packed(code[start] >> 32, [code[start] & 0xFFFFFFFF, least, count], blocks, (np.uint32, np.int64, np.uint32))
        return pa.Table.from_arrays([cols[0], pa.array([t.column("block")[0].as_py()] * len(cols[0]), pa.int64()), *cols[1:]],
                                    ["part", "block", "key", "fp", "count"])

    def shared(t: pa.Table) -> pa.Table:
        key, fp, count = (_unpacked(t, c, k) for c, k in (("key", np.uint32), ("fp", np.int64), ("count", np.uint32)))
        block = np.repeat(t.column("block").to_numpy(), [len(x) // 4 for x in t.column("key").to_pylist()])
        order = np.argsort(key, kind="stable")
        key, fp, count, block = key[order], fp[order], count[order].astype(np.int64), block[order]
        start = _starts(key)
        # equal texts have equal fingerprints: they count as one (see copies())
        several = (np.minimum.reduceat(fp, start) < np.maximum.reduceat(fp, start)) | (np.maximum.reduceat(count & 1, start) > 0)
        hot = np.add.reduceat(count >> 1, start) > hot_rows
        size = np.diff(np.append(start, len(key)))
        keep, hot = np.repeat(several, size), np.repeat(hot, size)
        cols = _packed(block[keep], [key[keep], hot[keep]], blocks, (np.uint32, np.uint8))
        return pa.Table.from_arrays([cols[0], pa.array([t.column("part")[0].as_py()] * len(cols[0]), pa.int64()), *cols[1:]],
                                    ["block", "part", "key", "hot"])

    def sends(texts: pa.Table, answer: pa.Table) -> pa.Table:
        names = ["part", "block", "doc", "last", "n", "piece", "x"]
        none = pa.table([pa.array([], pa.int64())] * 2 + [pa.array([], pa.binary())] * 5, names=names)
        if not len(answer) or not len(texts):
            return none
        n_keys = [len(x) for x in answer.column("hot").to_pylist()]
        wanted = np.repeat(answer.column("part").to_numpy(), n_keys) << 32 | _unpacked(answer, "key", np.uint32).astype(np.int64)
        is_hot = _unpacked(answer, "hot", np.uint8).astype(bool)
        order = np.argsort(wanted)
        wanted, is_hot = wanted[order], is_hot[order]
        ids = texts.column("doc_id").to_numpy()
        found = {c: [] for c in ("doc", "pos", "name", "whole", "whole_hot", "link_whole", "link_at", "link_piece",
                                 "piece", "route", "n", "size", "x")}
        for a, b, data, offsets in text_slices(texts.column("text"), SLICE_BYTES):
            unit, row, gram, first = units(data, offsets)
            start, at = window_anchors(unit, row, gram, window, m)
            # super-windows: consecutive windows of one minimizer
            lead = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])[:len(start)])
            begin, n, key = start[lead], np.diff(np.append(lead, len(start))), gram[at[lead]]
            code = _code(key, blocks)
            k = np.searchsorted(wanted, code).clip(0, len(wanted) - 1)
            keep = wanted[k] == code
            begin, n, key, hot = begin[keep], n[keep], key[keep], is_hot[k[keep]]
            if not len(begin):
                continue
            content = _content(unit)
            name = range_hash(content, begin, begin + n + window - 1)
            found["doc"].append(ids[a:b][row[begin]])
            found["pos"].append(begin - first[row[begin]])
            found["name"].append(name)
            # each distinct super-window once, and of a hot minimizer each distinct window
            whole, one = np.unique(name, return_index=True)
            begin, n, key, hot = begin[one], n[one], key[one], hot[one]
            found["whole"].append(whole)
            found["whole_hot"].append(hot)
            of = np.repeat(np.flatnonzero(hot), n[hot])
            shift = np.arange(len(of)) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
            single = begin[of] + shift
            window_name = range_hash(content, single, single + window)
            found["link_whole"].append(whole[of])
            found["link_at"].append(shift)
            found["link_piece"].append(window_name)
            hot_piece, one = np.unique(window_name, return_index=True)
            begin = np.concatenate([begin[~hot], single[one]])
            n = np.concatenate([n[~hot], np.ones(len(one), np.int64)])
            found["piece"].append(np.concatenate([whole[~hot], hot_piece]))
            found["route"].append(_part_of(np.concatenate([key[~hot], hot_piece]), parts))
            found["n"].append(n)
            values, size = pack(unit, begin, n)
            found["x"].append(values)
            found["size"].append(size)
        if not found["doc"]:
            return none
        f = {c: np.concatenate(found.pop(c)) for c in list(found)}
        # numbers follow the hashes, so that a task that runs again gives the same
        whole, one = np.unique(f["whole"], return_index=True)
        whole_hot = f["whole_hot"][one]
        piece, one = np.unique(f["piece"], return_index=True)
        at = np.searchsorted(whole, f["name"])
        lo, hi = np.full(len(whole), np.iinfo(np.int64).max), np.full(len(whole), np.iinfo(np.int64).min)
        np.minimum.at(lo, at, f["doc"])
        np.maximum.at(hi, at, f["doc"])
        link = np.unique(np.stack([np.searchsorted(piece, f["link_piece"]), np.searchsorted(whole, f["link_whole"]),
                                   f["link_at"]], 1), axis=0) if len(f["link_at"]) else np.zeros((0, 3), np.int64)
        first, last = np.full(len(piece), np.iinfo(np.int64).max), np.full(len(piece), np.iinfo(np.int64).min)
        np.minimum.at(first, link[:, 0], lo[link[:, 1]])
        np.maximum.at(last, link[:, 0], hi[link[:, 1]])
        alone = np.searchsorted(piece, whole[~whole_hot])
        first[alone], last[alone] = lo[~whole_hot], hi[~whole_hot]
        # a piece that is a whole super-window has its number, other pieces come after them
        number = len(whole) + np.arange(len(piece))
        number[alone] = np.flatnonzero(~whole_hot)
        route = f["route"][one]
        order = np.argsort(route, kind="stable")
        cut = np.searchsorted(route[order], np.arange(parts + 1))
        block = texts.column("block")[0].as_py()
        n = f["n"][one]
        size, at_x = f["size"][one], (np.cumsum(f["size"]) - f["size"])[one]
        cols = [[] for _ in names]
        for p in np.flatnonzero(cut[1:] > cut[:-1]):
            o = order[cut[p]:cut[p + 1]]
            ends = np.cumsum(size[o])
            x = f["x"][np.repeat(at_x[o] - ends + size[o], size[o]) + np.arange(ends[-1])]
            for c, y in zip(cols, (int(p), block, first[o].tobytes(), last[o].tobytes(), n[o].astype(np.int32).tobytes(),
                                   number[o].astype(np.int32).tobytes(), x.tobytes())):
                c.append(y)
        # what stays with the block travels as a group of its own
        for k, x in ((OCCURRENCE, (f["doc"], f["pos"], at)), (LINK, (number[link[:, 0]], link[:, 1], link[:, 2]))):
            for c, y in zip(cols, (parts + block, block, x[0].tobytes(), b"", x[1].astype(np.int32).tobytes(),
                                   x[2].astype(np.int32).tobytes(), bytes([k]))):
                c.append(y)
        return pa.table([pa.array(c, pa.int64()) for c in cols[:2]] + [pa.array(c, pa.binary()) for c in cols[2:]], names=names)

    def bucket(t: pa.Table) -> pa.Table:
        fields = ["block", "kind", "doc", "start", "end"]
        if t.column("part")[0].as_py() >= parts:
            kinds = pa.array([x[0] for x in t.column("x").to_pylist()], pa.int32())
            return pa.table([t.column("block"), kinds, t.column("doc"), t.column("n"), t.column("piece")], names=fields)
        block = np.repeat(t.column("block").to_numpy(), [len(x) // 8 for x in t.column("doc").to_pylist()])
        doc, last = _unpacked(t, "doc", np.int64), _unpacked(t, "last", np.int64)
        n, piece = _unpacked(t, "n", np.int32).astype(np.int64), _unpacked(t, "piece", np.int32)
        least = solve(doc, n, _unpacked(t, "x", kind))
        of = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        hit = least < last[of]
        least, of, at = least[hit], of[hit], at[hit]
        # consecutive windows with one answer
        lead = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])])[:len(of)])
        end = at[lead] + np.diff(np.append(lead, len(of))) + window - 1
        of = of[lead]
        cols = _packed(block[of], [least[lead], piece[of], at[lead] << 16 | end], blocks, (np.int64, np.int32, np.int32))
        return pa.table([cols[0], pa.array([LEAST] * len(cols[0]), pa.int32()), *cols[1:]], names=fields)

    dealt = docs.select("doc_id", "text", "block")
    found = (dealt.withColumn("fp", F.xxhash64("text")).repartition(blocks, "block").groupBy("block")
             .applyInArrow(anchors, "part long, block long, key binary, fp binary, count binary")
             .repartition(blocks, "part").groupBy("part").applyInArrow(shared, "block long, part long, key binary, hot binary"))
    found = materialize(found, "repeat-anchors")
    release_shuffles(docs.sparkSession)
    sent = (dealt.repartition(blocks, "block").groupBy("block").cogroup(found.repartition(blocks, "block").groupBy("block"))
            .applyInArrow(sends, "part long, block long, doc binary, last binary, n binary, piece binary, x binary"))
    ranges = materialize(sent.repartition(parts + blocks, "part").groupBy("part").applyInArrow(bucket, TO_BLOCK), "repeat-ranges")
    discard(found)
    del sent
    release_shuffles(docs.sparkSession)
    return ranges


def _marked(answer: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of the covered ranges of a block."""
    def of(kind):
        t = answer.filter(pc.equal(answer.column("kind"), kind))
        return (_unpacked(t, "doc", np.int64), _unpacked(t, "start", np.int32).astype(np.int64),
                _unpacked(t, "end", np.int32).astype(np.int64))

    doc, pos, whole = of(OCCURRENCE)
    least, piece, span = of(LEAST)
    link_piece, link_whole, link_at = of(LINK)
    order = np.argsort(link_piece, kind="stable")
    link_piece, link_whole, link_at = link_piece[order], link_whole[order], link_at[order]
    # answers to the windows of hot minimizers, moved to the super-windows that hold them
    run, link = _meet(piece, link_piece)
    own = ~np.isin(piece, link_piece)
    least = np.concatenate([least[own], least[run]])
    at = np.concatenate([span[own] >> 16, (span[run] >> 16) + link_at[link]])
    end = np.concatenate([span[own] & 0xFFFF, (span[run] & 0xFFFF) + link_at[link]])
    piece = np.concatenate([piece[own], link_whole[link]])
    order = np.argsort(whole, kind="stable")
    doc, pos, whole = doc[order], pos[order], whole[order]
    run, here = _meet(piece, whole)
    later = least[run] < doc[here]
    run, here = run[later], here[later]
    copy, copy_start, copy_end = of(RANGE)
    return (np.concatenate([doc[here], copy]), np.concatenate([pos[here] + at[run], copy_start]),
            np.concatenate([pos[here] + end[run], copy_end]))


def copies(docs: DataFrame) -> DataFrame:
    """Ranges that cover whole texts that a smaller id has too."""
    keyed = docs.where("doc_id is not null").select("doc_id", "block", F.sha2("text", 256).alias("key"))
    least = keyed.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    later = keyed.join(least, "key").where("least < doc_id").select("block", "doc_id").distinct()

    def run(batches):
        for t in batches:
            block, doc = t.column("block").to_numpy(), t.column("doc_id").to_numpy()
            if len(block):
                cols = _packed(block, [doc, np.zeros(len(doc)), np.full(len(doc), np.iinfo(np.int32).max)], int(block.max()) + 1,
                               (np.int64, np.int32, np.int32))
                yield pa.RecordBatch.from_arrays([cols[0], pa.array([RANGE] * len(cols[0]), pa.int32()), *cols[1:]],
                                                 ["block", "kind", "doc", "start", "end"])

    return later.mapInArrow(run, TO_BLOCK)


def with_ranges(docs: DataFrame, ranges: DataFrame, blocks: int, finish: Callable, fields: str) -> DataFrame:
    """``finish(data, offsets, starts, ends) -> columns`` over all texts of a block with their
    covered ranges (a list of arrays each, ordered by start). Rows without id have none and are not
    dealt into blocks."""
    carried = [f for f in docs.schema if f.name == "row"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *carried, *T._parse_datatype_string(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(texts: pa.Table, answer: pa.Table) -> pa.Table:
        doc, start, end = _marked(answer)
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        ids = texts.column("doc_id").combine_chunks()
        num = ids.fill_null(0).to_numpy(zero_copy_only=False)
        lo, hi = np.searchsorted(doc, num), np.searchsorted(doc, num, side="right")
        hi = np.where(ids.is_null().to_numpy(zero_copy_only=False), lo, hi)
        out = []
        for a, b, data, offsets in text_slices(texts.column("text"), SLICE_BYTES):
            cols = finish(data, offsets, [start[lo[r]:hi[r]] for r in range(a, b)], [end[lo[r]:hi[r]] for r in range(a, b)])
            kept = [ids.slice(a, b - a)] + [texts.column("row").slice(a, b - a) for _ in carried]
            out.append(pa.Table.from_arrays(
                kept + [pa.array(c, f.type) for c, f in zip(cols, list(arrow)[len(kept):], strict=True)], schema=arrow))
        return pa.concat_tables(out) if out else arrow.empty_table()

    nothing = to_arrow_schema(T._parse_datatype_string(TO_BLOCK)).empty_table()

    def unmarked(batches):
        for batch in batches:
            yield from run(pa.Table.from_batches([batch]), nothing).to_batches()

    dealt = docs.where("doc_id is not null").repartition(blocks, "block").groupBy("block").cogroup(
        ranges.union(copies(docs)).repartition(blocks, "block").groupBy("block")).applyInArrow(run, schema)
    return dealt.union(docs.where("doc_id is null").mapInArrow(unmarked, schema))


def merged(starts: np.ndarray, ends: np.ndarray, size: int, window: int) -> np.ndarray:
    """Maximal covered ranges [start, end) of a text of ``size`` units as rows."""
    if not len(starts) or size < window:
        return np.zeros((0, 2), np.int64)
    starts, ends = starts.clip(0, size), ends.clip(0, size)
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    lead = np.flatnonzero(new)
    return np.stack([starts[lead], reach[np.append(lead[1:], len(starts)) - 1]], 1)
