"""Removal of repeated substrings by interval expansion on a Burrows-Wheeler transform.

A byte goes when it is covered by a string of ``min_bytes`` bytes that also
starts elsewhere in the corpus.  The corpus is never sorted as one text:

1. Every window of ``min_bytes`` bytes is owned by its minimizer, the leftmost
   smallest hash among its ``gram``-byte strings.  Equal windows have equal
   minimizers at equal places, so all starts of one repeated string fall into
   the group of one minimizer value.  An anchor is a minimizer with the run of
   window starts that it owns; the runs partition all window starts.
2. Anchors are summed by (minimizer, text that their windows span).  Equal
   spans collapse to one weighted text, so a group of thousands of copies is
   one row.  Minimizers seen once cannot repeat and end here.
3. The distinct spans of a minimizer meet in one block.  Their suffixes are
   sorted, and LCP values come from breadth-first backward extension on the
   transform, by increasing value, stopping at ``min_bytes``: boundaries that
   are still unset by then separate suffixes that share ``min_bytes`` bytes.
4. The repeated starts return to every anchor of their span, and each document
   drops the union of the windows that start there.

A minimizer with more than ``wide`` distinct spans goes no further as a block:
its distinct spans are cut into single windows, which meet by equality, so that
no block is unbounded.

Defined results: null text is empty; texts of any length are handled whole; texts below ``min_bytes`` keep all bytes;
repeated rows are occurrences of their own (both are removed); a null doc_id is
a value like any other; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, pick

GRAM = 32
CHUNK = 1 << 20
BLOCK = 3 << 20
WIDE = 40_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xD6E8FEB86659FD93)
_POS = np.uint64((1 << 24) - 1)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's base and of its inverse, modulo 2**64."""
    if n not in _tables:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        up, down = np.full(n, _ODD, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        _tables.clear()
        _tables[n] = (np.cumprod(up), np.cumprod(down))
    return _tables[n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _ODD2
    x ^= x >> np.uint64(29)
    x *= _ODD
    x ^= x >> np.uint64(32)
    return x


def release() -> None:
    """Give memory that is free, and the tables, back to the system."""
    _tables.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):  # not with this C library
        pass


def lean(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``rows`` in a worker that keeps nothing of the task before, nor anything while it waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from rows(batches)
        finally:
            release()

    return run


def find_anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_bytes: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of texts that lie one behind the other in ``data``.

    Returns (text, first, count, minimizer hash, span hash): ``count`` window
    starts from ``first``, an offset into ``data``.
    """
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n = len(data)
    if n < min_bytes:
        return empty
    up, down = _powers(max(2 * CHUNK, n) + 1 if n > 2 * CHUNK else 2 * CHUNK + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    grams = _mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    low = (grams & ~_POS) | np.arange(n - gram + 1, dtype=np.uint64)
    width, have = min_bytes - gram + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    place = (low & _POS).astype(np.int64)  # of each window's minimizer
    long = ends - starts >= min_bytes
    starts, ends, which = starts[long], ends[long], np.flatnonzero(long)
    if not len(starts):
        return empty
    new = np.empty(len(place), bool)
    new[0] = True
    np.not_equal(place[1:], place[:-1], out=new[1:])
    new[starts] = True
    after = ends - min_bytes + 1  # the first start that is no longer inside
    new[after[after < len(place)]] = True
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(place)))
    text = np.searchsorted(starts, first, "right") - 1
    inside = (text >= 0) & (first + min_bytes <= ends[text])
    first, count, text = first[inside], count[inside], text[inside]
    last = first + count + min_bytes - 1
    span = _mix((total[last] - total[first]) * down[first] + count.astype(np.uint64))
    return which[text], first, count, grams[place[first]], span


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n + 1 offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def _anchor_rows(min_bytes: int, gram: int):
    """(key, kh, ch, s0, n, w): w is how many anchors of the batch are alike, at the first of them, else 0."""

    def found(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        keys = batch.column(0).to_numpy()
        data, at = _buffers(batch.column(1))
        i = 0
        while i < len(keys):
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
            # a text longer than a chunk goes in pieces that overlap by a window
            for lo in range(int(at[i]), max(int(at[j]), int(at[i]) + 1), CHUNK if j == i + 1 else 1 << 62):
                hi = int(at[j]) if j > i + 1 else min(int(at[j]), lo + CHUNK + min_bytes - 1)
                starts = np.array([lo]) if j == i + 1 else at[i:j]
                ends = np.array([hi]) if j == i + 1 else at[i + 1 : j + 1]
                text, first, count, kh, ch = find_anchors(data[lo:hi], starts - lo, ends - lo, min_bytes, gram)
                text += i
                yield keys[text], kh.view(np.int64), ch.view(np.int64), (first + lo - at[text]).astype(np.int32), count.astype(np.int32)
            i = j

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, kh, ch, s0, n = (np.concatenate(x) for x in zip(*found(batch), strict=True))
            order = np.lexsort((ch, kh))
            lead = np.ones(len(order), bool)
            lead[1:] = (kh[order][1:] != kh[order][:-1]) | (ch[order][1:] != ch[order][:-1])
            at = np.flatnonzero(lead)
            w = np.zeros(len(order), np.int32)
            w[order[at]] = np.diff(np.append(at, len(order)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, kh, ch, s0, n, w)], names=["key", "kh", "ch", "s0", "n", "w"])

    return rows


def suffix_order(text: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` symbols, and the order's inverse.

    ``text`` holds byte values + 1 and 0 behind each string; ``end`` gives, for
    each place, the place of that 0, which a comparison never passes.
    """
    n = len(text)
    here = np.arange(n, dtype=np.int32)
    key = np.zeros(n, np.uint64)
    for j in range(7):  # seven symbols of nine bits
        key = (key << np.uint64(9)) | text[np.minimum(here + np.int32(j), end)].astype(np.uint64)
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    rank = np.empty(n, np.int32)
    slots, sub, h = here, order.copy(), 7
    while True:
        head = np.empty(len(sub), bool)
        head[:1] = True
        np.not_equal(key[1:], key[:-1], out=head[1:])
        lead = np.flatnonzero(head)
        size = np.diff(np.append(lead, len(sub)))
        rank[sub] = np.repeat(slots[lead], size)
        order[slots] = sub
        tied = np.repeat(size > 1, size)
        slots, sub = slots[tied], sub[tied]
        if h >= depth or not len(sub):
            break
        key = (rank[sub].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(sub + np.int32(h), end[sub])].astype(np.uint64)
        by = np.argsort(key)
        sub, key, h = sub[by], key[by], 2 * h
    rank[order] = here
    return order, rank


def deep_boundaries(text: np.ndarray, order: np.ndarray, rank: np.ndarray, depth: int) -> np.ndarray:
    """For each place p of the suffix order: do p - 1 and p share ``depth`` symbols?

    Breadth-first over the intervals of strings of length 0, 1, 2, ...: each is
    extended to the left by every symbol that precedes it.  The end of an
    extended interval is a boundary; if no shorter string has set it, its LCP
    is the length of the string that was extended, and only such intervals go
    on.  The search stops at ``depth``.
    """
    n = len(order)
    first = text[order]  # first symbol of each suffix
    before = np.where(order > 0, text[order - 1], 0)  # the transform
    back = np.where(before > 0, rank[order - 1], -1).astype(np.int32)  # its last-to-first mapping
    unset = np.ones(n + 1, bool)
    unset[[0, n]] = False
    label = np.zeros(n + 2, np.int32)  # of the interval that an extended place comes from
    new_symbol = np.ones(n + 1, bool)
    new_symbol[1:n] = first[1:] != first[:-1]
    new_symbol[1:n] |= first[1:] == 0  # ends of strings are all different
    lo, hi = np.zeros(1, np.int32), np.full(1, n, np.int32)
    for length in range(depth):
        size = hi - lo
        shift = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.int32) + np.repeat(lo - shift.astype(np.int32), size)
        to = back[place]
        mark = np.repeat(np.arange(1, len(lo) + 1, dtype=np.int32), size)
        kept = to >= 0
        to, mark = to[kept], mark[kept]
        label[to + 1] = mark
        ends = to[(label[to + 2] != mark) | new_symbol[to + 1]]
        begins = to[(label[to] != mark) | new_symbol[to]]
        label[to + 1] = 0
        ends.sort()
        begins.sort()
        ends = ends + 1
        if length == 0:  # the ends of strings come first, each an interval of its own
            unset[np.flatnonzero(new_symbol)] = False
            own = np.arange(int((first == 0).sum()), dtype=np.int32)
            lo, hi = np.concatenate([own, begins]), np.concatenate([own + np.int32(1), ends.astype(np.int32)])
            continue
        fresh = unset[ends]
        lo, hi = begins[fresh], ends[fresh].astype(np.int32)
        unset[hi] = False
        if not len(lo):
            break
    return unset


def repeated_starts(spans: list[bytes], counts: np.ndarray, min_bytes: int) -> list[np.ndarray]:
    """For each string, which of its first ``counts`` starts repeat elsewhere among the strings."""
    size = np.array([len(s) + 1 for s in spans])
    text = np.frombuffer(b"\0".join(spans) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    stop = np.cumsum(size) - 1
    text[stop] = 0
    end = np.repeat(stop, size).astype(np.int32)
    order, rank = suffix_order(text, end, min_bytes)
    deep = deep_boundaries(text, order, rank, min_bytes)
    twice = (deep[:-1] | deep[1:])[rank]
    begin = stop - size + 1
    return [twice[b : b + c] for b, c in zip(begin, counts, strict=True)]


def _runs(flags: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def _expand(min_bytes: int):
    """Blocks of whole minimizer groups, each expanded on its own transform."""
    schema = pa.schema([("kh", pa.int64()), ("ch", pa.int64()), ("runs", pa.list_(pa.list_(pa.int32())))])

    def solve(group: list[tuple]) -> pa.RecordBatch:
        kh, ch, n, w, span = zip(*group, strict=True)
        found = repeated_starts(list(span), np.array(n), min_bytes)
        out = [(k, c, [[0, m]] if v > 1 else _runs(f)) for k, c, m, v, f in zip(kh, ch, n, w, found, strict=True)]
        out = [x for x in out if x[2]]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t.type) for i, t in enumerate(schema)], schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, last, seen = [], 0, None, set()  # rows come sorted by minimizer
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if row[0] != last:
                    seen = set()
                    if held >= BLOCK:
                        yield solve(block)
                        block, held = [], 0
                last = row[0]
                if row[1] not in seen:  # a repeated row brings its spans again
                    seen.add(row[1])
                    block.append(row)
                    held += len(row[4]) + 1
        if block:
            yield solve(block)

    return rows


def _spans(min_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _buffers(batch.column(0))
            lists = batch.column(2)
            item = lists.flatten()
            of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            kh, ch, s0, n, w = (item.field(i).to_numpy() for i in range(5))
            lo = at[of] + s0
            for i in range(0, len(of), 4096):
                cut = slice(i, i + 4096)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kh[cut]), pa.array(ch[cut]), pa.array(n[cut]), pa.array(w[cut]), pa.array([data[a : a + m + min_bytes - 1].tobytes() for a, m in zip(lo[cut], n[cut], strict=True)], pa.binary())],
                    names=["kh", "ch", "n", "w", "span"],
                )

    return rows


def _cut(min_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _buffers(batch.column(1))
            out = []
            for i, runs in enumerate(batch.column(2).to_pylist()):
                text = data[at[i] : at[i + 1]]
                gone = []
                for a, b in sorted((s0 + a, s0 + b - 1 + min_bytes) for s0, part in ((x["s0"], x["runs"]) for x in runs or ()) for a, b in part):
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], b)
                    else:
                        gone.append([a, b])
                sha, done = hashlib.sha256(), 0
                for a, b in gone:
                    sha.update(text[done:a])
                    done = b
                sha.update(text[done:])
                out.append((len(text), sum(b - a for a, b in gone), gone, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.list_(pa.int64()))), pa.array([x[3] for x in out], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "removed", "kept_sha256"],
            )

    return rows


def _weigh(anchors: DataFrame) -> DataFrame:
    """Distinct spans of the minimizers that occur twice, with their weights and one place each.

    Anchors come summed by batch, so copies hardly add rows to a minimizer.
    """
    group = W.partitionBy("kh")
    twice = anchors.where("w > 0").withColumn("total", F.sum("w").over(group)).where("total > 1")
    spans = twice.groupBy("kh", "ch").agg(F.sum("w").alias("w"), F.min(F.struct("key", "s0", "n")).alias("at"))
    spans = spans.withColumn("kinds", F.count("*").over(group))
    return spans.select("kh", "ch", "w", "at.key", "at.s0", "at.n", "kinds")


def _alone(spans: DataFrame) -> DataFrame:
    """Spans that are the only kind of their minimizer: every start repeats."""
    return spans.where("kinds = 1").select("kh", "ch", F.array(F.array(F.lit(0), F.col("n"))).alias("runs"))


def repeated_windows(docs: DataFrame, min_bytes: int = 200, gram: int = GRAM, wide: int = WIDE) -> DataFrame:
    """(key, s0, runs): runs [a, b) of repeated window starts, counted from byte s0 of the text ``key``.

    Takes (key, doc_id, text); rows with equal keys must have equal texts.
    """
    # found twice rather than kept: they are quickly found and many
    anchors = docs.select("key", "text").mapInArrow(_anchor_rows(min_bytes, gram), "key bigint, kh bigint, ch bigint, s0 int, n int, w int")
    spans = checkpoint(_weigh(anchors))
    wanted = F.collect_list(F.struct("kh", "ch", "s0", "n", "w")).alias("want")

    def with_text(some: DataFrame) -> DataFrame:
        # doc_id rides along so that this exchange of the texts equals the one of the final join
        rows = docs.join(some.groupBy("key").agg(wanted), "key").select("text", "doc_id", "want")
        return rows.mapInArrow(_spans(min_bytes), "kh bigint, ch bigint, n int, w bigint, span binary")

    texts = with_text(spans.where(F.col("kinds").between(2, wide)))
    found = texts.repartition("kh").sortWithinPartitions("kh").mapInArrow(_expand(min_bytes), "kh bigint, ch bigint, runs array<array<int>>")
    found = found.unionByName(_alone(spans))
    hot = spans.where(F.col("kinds") > wide)
    if not hot.isEmpty():
        each = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.md5(F.substring("span", i + 1, F.lit(min_bytes))))
        single = with_text(hot).dropDuplicates(["kh", "ch"]).select("kh", "ch", "w", F.posexplode(each).alias("i", "window"))
        twice = single.groupBy("kh", "window").agg(F.sum("w").alias("total")).where("total > 1").select("kh", "window")
        runs = F.collect_list(F.array(F.col("i"), F.col("i") + 1)).alias("runs")
        found = found.unionByName(single.join(twice, ["kh", "window"]).groupBy("kh", "ch").agg(runs))
    return anchors.join(found, ["kh", "ch"]).select("key", "s0", "runs")


def drop_repeats(docs: DataFrame, min_bytes: int = 200, gram: int = GRAM, wide: int = WIDE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept_sha256), a row for each row of ``docs``.

    ``removed`` lists the maximal removed runs [from, to) of bytes in order.
    """
    d = pick(docs, doc_id="bigint", text="string")
    d = d.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    runs = repeated_windows(d, min_bytes, gram, wide).groupBy("key").agg(F.collect_set(F.struct("s0", "runs")).alias("runs"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, removed array<array<bigint>>, kept_sha256 string"
    return d.join(runs, "key", "left").select("doc_id", "text", "runs").mapInArrow(_cut(min_bytes), schema)
