"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles is summarised by ``bands * rows`` registers.
Register i holds the smallest of the exponential values that its hash function
gives the shingles, on a scale of powers of ``BASE``: registers of a union are
the larger of both sides', and the chance that two documents agree in one is
close to their Jaccard similarity.

* Documents with equal sets are one class; links are sought between classes.
* Classes that agree in all registers of a band share a bucket.  Pairs of a
  bucket are not listed: every class meets its bucket's hub, the member whose
  buckets are fullest.  Verified links join classes into components, and only
  buckets that still hold several components go on.  There, members outside the
  bucket's largest component are held against all its members, in blocks of
  bounded size, by longer sketches, and every partner that is likely is
  verified.
* A candidate's similarity is first estimated jointly from both documents'
  registers by maximum likelihood; only an estimate far below the threshold
  drops it.  All others are verified on the full sets.

With 24 bands of 4 registers a link at similarity 0.8 is missed by all bands
with probability 3e-6, one at 0.9 with 6e-12.

Defined results: null, empty and blank texts have an empty set, 0 shingles and
a component of their own; texts of any length are cut in shingles whole; of
equally central members of a bucket the larger signature is its hub; equal rows are linked; rows with a null doc_id join
components but never name one (a component of such rows only has a null id and
keeps them all); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, number_equal, pick, small, written
from .shingles import pieces, shingle_sets
from .substrings import _mix, lean

BANDS, ROWS = 24, 4
BASE = 1.001
#: An estimate this far below the threshold (over five standard errors) drops a pair.
SLACK = 0.22
#: Registers of the longer sketches, their slack (over five standard errors), members and shingles of a block.
LONG, LONG_SLACK, MEMBERS, ITEMS = 320, 0.12, 1000, 1 << 20
#: Edges in a file of a table whose size is known.
EDGES = 200_000
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(1, 1 << 32, LONG, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_XOR = _RNG.integers(0, 1 << 32, LONG, dtype=np.uint64).astype(np.uint32)


def registers(items: np.ndarray, size: np.ndarray, many: int = BANDS * ROWS) -> np.ndarray:
    """One row of registers for each non-empty set; ``size`` gives the offsets."""
    offsets = size[:-1][np.diff(size) > 0]
    low = np.empty((many, len(offsets)), np.uint32)
    half = (items >> np.uint64(32)).astype(np.uint32)
    for i, (mul, xor) in enumerate(zip(_MUL[:many], _XOR[:many], strict=True)):
        v = (half ^ xor) * mul
        v ^= v >> np.uint32(16)
        v *= np.uint32(0x7FEB352D)
        low[i] = np.minimum.reduceat(v, offsets)
    waits = -np.log1p(-(low.T.astype(np.float64) + 0.5) / 2.0**32)  # exponential minima
    return np.clip(np.floor(1 - np.log(waits) / math.log(BASE)) + 20_000, 0, 65_535).astype(">u2")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of register rows by joint maximum likelihood, sizes known."""
    u, v = na / (na + nb), nb / (na + nb)
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def fit(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one maximum
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = fit(x) > fit(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def _sketches(width: int, seed: int):
    """Size, two signatures and registers of each set."""
    start = _mix(np.array([seed], np.uint64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in pieces(batch.column(1)):
                items, size = shingle_sets(data, at, width)
                n = np.diff(size)
                some = n > 0
                sign, check = np.zeros((2, j - i), np.uint64)
                if len(items):
                    for k, out in enumerate((sign, check)):
                        out[some] = _mix(np.add.reduceat(_mix(items ^ (start + np.uint64(k))), size[:-1][some]) + n[some].astype(np.uint64))
                    own = [x.tobytes() for x in registers(items, size)]
                regs = iter(own if len(items) else ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n), pa.array(sign.view(np.int64), mask=~some), pa.array(check.view(np.int64)), pa.array([next(regs) if s else None for s in some], pa.binary())],
                    names=["row", "n", "node", "check", "regs"],
                )

    return rows


def _sets(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in pieces(batch.column(1)):
                items, size = shingle_sets(data, at, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([items[a:b].tobytes() for a, b in zip(size[:-1], size[1:], strict=True)], pa.binary())], names=["node", "items"]
                )

    return rows


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * common >= percent * all, of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _verified(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_alike(*(np.frombuffer(z.as_buffer(), np.uint64) for z in pair), percent) for pair in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return rows


def _likely(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), ">u2").reshape(batch.num_rows, -1).astype(np.int32) for i in (2, 3))
            na, nb = (batch.column(i).to_numpy().astype(float) for i in (4, 5))
            ok = estimate(a, b, na, nb) >= percent / 100 - SLACK
            yield batch.select([0, 1]).filter(pa.array(ok))

    return rows


def _lengthened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            size = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            regs = registers(np.concatenate(sets), size, LONG)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in regs], pa.binary()), pa.array(np.diff(size))], names=["node", "regs", "n"])


class _Blocks:
    """The members and the outsiders of a block, and whom of them to look at."""

    def __init__(self, table: pa.Table, percent: int):
        self.node, self.label, self.n = (table.column(c).to_numpy() for c in ("node", "label", "n"))
        self.outside, self.query = (table.column(c).to_numpy(zero_copy_only=False) for c in ("outside", "query"))
        self.regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), ">u2").reshape(len(self.node), -1).astype(np.uint16)
        self.bands = self.regs[:, : BANDS * ROWS].copy().view(np.uint64)  # four registers a band
        self.members = np.flatnonzero(~self.query)
        self.here = int(table.column("place")[0].as_py())
        self.percent = percent

    def likely(self, x: int, label: np.ndarray) -> np.ndarray:
        """Members that an outsider may be like and has no common label with, the likeliest first."""
        y, n = self.members, self.n
        y = y[label[y] != label[x]]
        # two outsiders meet once; and a pair only in the first band that it shares
        y = y[~self.outside[y] | (self.node[y] > self.node[x])]
        y = y[(100 * n[y] >= self.percent * n[x]) & (100 * n[x] >= self.percent * n[y])]
        y = y[~(self.bands[y, : self.here] == self.bands[x, : self.here]).any(1)]
        if not len(y):
            return y
        own = np.broadcast_to(self.regs[x].astype(np.int32), (len(y), self.regs.shape[1]))
        like = estimate(own, self.regs[y].astype(np.int32), np.full(len(y), float(n[x])), n[y].astype(float))
        good = np.flatnonzero(like >= self.percent / 100 - LONG_SLACK)
        return y[good[np.argsort(-like[good], kind="stable")]]


def _meeting(percent: int):
    """The rows of a block that have a likely partner in it: as many as there are, at most."""

    def block(table: pa.Table) -> pa.Table:
        blocks, seen = _Blocks(table, percent), np.zeros(table.num_rows, bool)
        for x in np.flatnonzero(blocks.query):
            y = blocks.likely(x, blocks.label)
            seen[y] = True
            seen[x] |= len(y) > 0
        return table.filter(pa.array(seen))

    return block


def _forest(percent: int):
    """Verified links (a, b) that join components: fewer than the block has rows, whatever their pairs."""

    def block(table: pa.Table) -> pa.Table:
        blocks = _Blocks(table, percent)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("items").combine_chunks()]
        label, links = blocks.label.copy(), []
        for x in np.flatnonzero(blocks.query):
            for y in blocks.likely(x, label):
                if label[x] != label[y] and _alike(sets[x], sets[y], percent):
                    links.append((blocks.node[x], blocks.node[y]))
                    label[label == label[x]] = label[y]
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return block


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for undirected edges (a, b): the smallest node that each one reaches.

    Alternating large and small stars; each round checkpoints its edges, whose
    number never grows, and no neighbourhood is gathered: only minima are.
    """
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    parts = math.ceil(edges.count() / EDGES) or 1
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = F.least(F.col("a"), F.min("b").over(W.partitionBy("a")))
        large = both.select("a", "b", low.alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = F.min("b").over(W.partitionBy("a"))
        near = large.select("a", "b", low.alias("m"))
        near = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b")))
        # as many files as the edges, whose number is known, need
        edges = checkpoint(near.where("a <> b").distinct().coalesce(parts))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = now


def _links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Labels (node, label) of the classes that are linked; None if there are none."""
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * 2 * ROWS + 1, F.lit(2 * ROWS)))))
    bucket = W.partitionBy("band")
    rows = classes.select("node", band.alias("place", "band")).withColumn("full", F.count("*").over(bucket)).where("full > 1")
    rows = checkpoint(rows)
    if rows.isEmpty():
        return None
    # the sets of all classes that share a bucket, drawn from one document of each
    ids = rows.select("node").distinct().join(classes.select("node", "doc_id", "twin"), "node").select("node", "doc_id", "twin")
    ids = checkpoint(ids)
    one = docs.join(F.broadcast(ids) if small(ids) else ids, "twin").select("node", "text")
    sets = checkpoint(one.mapInArrow(lean(_sets(width)), "node bigint, items binary").dropDuplicates(["node"]))
    central = rows.groupBy("node").agg(F.sum("full").alias("pull"))
    rows = checkpoint(rows.select("node", "place", "band").join(central, "node"))
    regs = classes.select("node", "regs", "n")

    def exact(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("items").alias("ia"))
        right = sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))
        return checkpoint(pairs.join(left, "a").join(right, "b").select("a", "b", "ia", "ib").mapInArrow(lean(_verified(percent)), "a bigint, b bigint, ok boolean"))

    def check(pairs: DataFrame) -> DataFrame:
        left = regs.select(F.col("node").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na"))
        right = regs.select(F.col("node").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb"))
        size = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
        near = pairs.join(left, "a").join(right, "b").where(size).select("a", "b", "ra", "rb", "na", "nb")
        return exact(near.mapInArrow(lean(_likely(percent)), "a bigint, b bigint"))

    tried, labels = None, None

    def labelled(rows: DataFrame) -> DataFrame:
        """Rows of the buckets that hold several components, with their labels."""
        if labels is None:
            return rows.withColumn("label", F.col("node"))
        rows = rows.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = F.min("label").over(bucket) != F.max("label").over(bucket)
        return checkpoint(rows.withColumn("mixed", mixed).where("mixed").drop("mixed"))

    def verify(pairs: DataFrame, look: Callable[[DataFrame], DataFrame]) -> bool:
        """Look at pairs that are new; did any join?"""
        nonlocal tried, labels
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        done = look(pairs)
        tried = done if tried is None else tried.unionByName(done)
        joined = not done.where("ok").isEmpty()
        if joined:
            labels = components(tried.where("ok"))
        return joined

    for _ in range(2):
        rows = labelled(rows)
        hub = F.max(F.struct("pull", "node", "label")).over(bucket)
        star = rows.select("node", "label", hub.alias("hub")).where("label <> hub.label")
        star = star.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
        if not verify(star, check):
            break
    rows = labelled(rows)
    if not rows.isEmpty():
        long = sets.join(rows.select("node").distinct(), "node", "left_semi").select("node", "items").mapInArrow(lean(_lengthened), "node bigint, regs binary, n bigint")
        long = written(long)
        # a bucket's outsiders, in blocks, against all its members, in blocks of a bounded number of shingles too
        dealt = rows.select("place", "band", "node", "label").join(long.rows.select("node", "n"), "node")
        of_label = dealt.groupBy("band", "label").agg(F.count("*").alias("many"), F.sum("n").alias("items"))
        main = of_label.groupBy("band").agg(F.max(F.struct("many", "label")).alias("main"), F.sum("many").alias("all"), F.sum("items").alias("items"), (F.sum("many") - F.max("many")).alias("out"))
        dealt = dealt.join(main, "band").withColumn("outside", F.col("label") != F.col("main.label"))
        part = F.greatest(F.col("all") / MEMBERS, F.col("items") / ITEMS)
        blocks = F.ceil(part).cast("int")
        asking = F.ceil(part * F.col("out") / F.col("all")).cast("int")
        of = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        named = ["place", "band", "node", "label", "outside"]
        own = dealt.select(*named, each(asking).alias("ask"), of(blocks).alias("block"), F.lit(False).alias("query"))
        asks = dealt.where("outside").select(*named, of(asking).alias("ask"), each(blocks).alias("block"), F.lit(True).alias("query"))
        both = own.unionByName(asks).join(long.rows, "node")
        met = written(both.groupBy("band", "ask", "block").applyInArrow(_meeting(percent), both.schema))
        full = met.rows.join(sets, "node")
        links = checkpoint(full.groupBy("band", "ask", "block").applyInArrow(_forest(percent), "a bigint, b bigint").distinct())
        for table in (long, met):
            table.drop()
        if not links.isEmpty():
            labels = components(links if tried is None else links.unionByName(tried.where("ok").select("a", "b")))
    return labels


def _classes(d: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows and the classes of equal sets.

    A class has a signature of 64 bits; a second one tells whether sets that
    differ share the first, and then all are signed anew.
    """
    row = "row struct<doc_id:bigint,twin:bigint>, n bigint, node bigint, check bigint, regs binary"
    for seed in itertools.count():
        signed = d.select(F.struct("doc_id", "twin").alias("row"), "text").mapInArrow(lean(_sketches(width, seed)), row)
        sketch = written(signed.select("row.doc_id", "row.twin", "n", "node", "check", "regs")).rows
        classes = sketch.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "twin", "n", "regs")).alias("one"), (F.min("check") != F.max("check")).alias("mixed"))
        classes = checkpoint(classes.select("node", "low", "one.doc_id", "one.twin", "one.n", "one.regs", "mixed"))
        if classes.where("mixed").isEmpty():
            return sketch, classes.drop("mixed")
    raise AssertionError


def _named(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, twin, n, node, label, component_id) of all rows; no node: an empty set."""
    d = pick(docs, doc_id="bigint", text="string")
    # the two parts of a row's identity: equal rows have equal sets
    d = d.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("twin"))
    sketch, classes = _classes(d, width)
    labels = _links(d, classes, width, percent)
    if labels is None:
        named = classes.select("node", F.col("node").alias("label"), F.col("low").alias("component_id"))
    else:
        named = classes.select("node", "low").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        first = named.groupBy("label").agg(F.min("low").alias("component_id"))
        named = named.join(first, "label").select("node", "label", "component_id")
    return sketch.select("doc_id", "twin", "n", "node").join(named, "node", "left")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Documents whose shingle sets have 100 * common >= percent * all are linked;
    ``component_id`` is the smallest doc_id that links reach.
    """
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = _named(docs, width, percent)
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, own.isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept: one of each component, with the smallest doc_id.

    Of rows with this id the one whose hash is smallest stays, of equal rows one;
    every row with an empty set stays.
    """
    rows = _named(docs, width, percent)
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "twin")
    best = rows.where("node is not null").groupBy("label").agg(F.min(order).alias("best")).select("best.doc_id", "best.twin")
    empty = rows.where("node is null").select("doc_id", "twin").distinct()
    keep = written(best.withColumn("single", F.lit(True)).unionByName(empty.withColumn("single", F.lit(False)))).rows
    keep = keep.select(F.coalesce("doc_id", F.lit(0)).alias("kept_id"), F.col("twin").alias("kept_twin"), "single")
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(doc_id, F.lit(0)).alias("kept_id"), F.xxhash64(doc_id, text).alias("kept_twin"))
    kept = own.join(F.broadcast(keep) if small(keep) else keep, ["kept_id", "kept_twin"])
    return number_equal(kept, "kept_id", "kept_twin").where("copy = 1 or not single").select("row.*")
