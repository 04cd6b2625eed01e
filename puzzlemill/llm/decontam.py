"""Benchmark decontamination by q-gram lemma filtering.

A benchmark item of m bytes leaks into a text if some stretch of the text is
within ``floor(rate * m)`` edits of it, after A-Z are folded and runs of white
space become one space.  An edit destroys at most q of an item's m - q + 1
q-grams, so a stretch within e edits shares at least m - q + 1 - q * e of them,
and they lie on at most e + 1 neighbouring diagonals (place in the text less
place in the item).

So does a long part of an item: of an item of more than ``REGION`` bytes, all
stretches of that length that begin at multiples of ``STEP``, and the last one,
are sought in the same way, with a bound and a budget of their own.  Any run of
REGION + STEP - 1 bytes of an item that a text still holds contains one of them.
Regions add nothing within a whole item that is found; elsewhere those of an
item that overlap in a text are one span, with the edits of the best one.

Shared q-grams are found by hash in one pass over a text and counted by item in
diagonal bands that overlap by half; only bands that reach the bound go on, and
these are verified by banded alignment.  The edit budget of short items is
lowered until the bound is positive; items shorter than q are sought exactly.

The benchmark is a stated query set: it is collected in blocks of at most
``BLOCK`` bytes, each of which is held against all texts in blocks.

Defined results: null and empty texts and items match nothing; texts of any
length are searched whole; equal items each match; repeated rows are judged one by one; a null doc_id is a value like any
other; items with a null item_id are ignored; without items no text is
contaminated; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import pick
from .shingles import _FOLD, _IS_SPACE, pieces
from .substrings import _mix, _powers, lean

GRAM = 10
RATE = 0.06
BLOCK = 4 << 20
#: Bytes of texts that are searched at once, and shared q-grams of texts (of one at least) that are counted at once.
CHUNK, SHARED = 1 << 18, 1 << 17
#: Length of the parts of an item that count as leaks, and how far apart they begin.
REGION, STEP = 64, 16
_BITS = 22


def normal(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with single spaces, and the place of each in ``data``."""
    space = _IS_SPACE[data]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    place = np.flatnonzero(keep)
    out = _FOLD[data[place]]
    out[space[place]] = 32
    return out, place


def gram_hashes(text: np.ndarray, q: int) -> np.ndarray:
    if len(text) < q:
        return np.zeros(0, np.uint64)
    up, down = _powers(max(2 * CHUNK, len(text)) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=total[1:])
    return _mix((total[q:] - total[:-q]) * down[: len(text) - q + 1])


@dataclass
class Index:
    """Items of a block and where their q-grams stand.

    The whole items come first, then the regions of each; postings name the items.
    """

    ids: list[int]
    texts: list[bytes]
    wholes: int
    regions: np.ndarray  # first region of each item, and the end
    edits: np.ndarray  # budget of each item
    least: np.ndarray  # q-grams that a match shares at least
    grams: np.ndarray  # sorted
    begin: np.ndarray  # of each gram's postings
    item: np.ndarray
    at: np.ndarray
    gate: np.ndarray
    q: int


def build_index(items: list[tuple[int, str]], q: int = GRAM, rate: float = RATE) -> Index:
    ids, texts = [], []
    for i, t in items:
        folded = normal(np.frombuffer((t or "").encode(), np.uint8))[0].tobytes().strip(b" ")
        if folded:
            ids.append(i)
            texts.append(folded)
    wholes = len(texts)
    regions = [wholes]
    for k in range(wholes):
        last = len(texts[k]) - REGION
        if last > 0:
            starts = [*range(0, last, STEP), last]
            ids += [ids[k]] * len(starts)
            texts += [texts[k][a : a + REGION] for a in starts]
        regions.append(len(texts))
    size = np.array([len(t) for t in texts], np.int64)
    edits = np.minimum(np.floor(rate * size), np.maximum(0, (size - q) // q)).astype(np.int64)
    least = size - q + 1 - q * edits
    g, item, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, t in enumerate(texts[:wholes]):
        h = gram_hashes(np.frombuffer(t, np.uint8), q)
        g.append(h)
        item.append(np.full(len(h), k))
        at.append(np.arange(len(h)))
    g, item, at = np.concatenate(g), np.concatenate(item), np.concatenate(at)
    order = np.argsort(g, kind="stable")
    grams, begin = np.unique(g[order], return_index=True)
    gate = np.zeros(1 << _BITS, bool)
    gate[(grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return Index(ids, texts, wholes, np.array(regions, np.int64), edits, least, grams, np.append(begin, len(g)), item[order], at[order], gate, q)


def banded_distance(item: np.ndarray, text: np.ndarray, diagonals: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, from, to) of the stretch of ``text`` nearest to ``item`` within the budget.

    The stretch may start on any of the first ``diagonals`` places; paths leave
    these diagonals by at most the budget.
    """
    pad = budget
    width = diagonals + 2 * pad
    far = 1 << 20
    # cell c of row j: item[:j] aligned up to text place j + c - pad
    cell = np.arange(width)
    cost = np.where((cell >= pad) & (cell < pad + diagonals), 0, far)
    start = cell - pad
    slope = np.arange(width)
    for j in range(len(item)):
        place = j + cell - pad
        ok = (place >= 0) & (place < len(text))
        same = np.where(ok, text[np.clip(place, 0, max(len(text) - 1, 0))] == item[j], False)
        step = np.where(ok, cost + ~same, far)
        skip = np.append(cost[1:], far) + 1  # the item's byte has no partner
        from_skip = np.append(start[1:], 0)
        best = np.where(skip < step, skip, step)
        begin = np.where(skip < step, from_skip, start)
        # bytes of the text without partner, all at once
        low = np.minimum.accumulate(best - slope)
        run = low + slope
        lead = np.maximum.accumulate(np.where(best - slope == low, slope, 0))
        start = np.where(run < best, begin[lead], begin)
        cost = np.minimum(best, run)
        if cost.min() > budget:
            return None
    k = int(np.argmin(cost))
    to = len(item) + k - pad
    return (int(cost[k]), int(start[k]), int(to)) if cost[k] <= budget and 0 <= start[k] <= to <= len(text) else None


def _with_regions(item: np.ndarray, at: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posting, entry, place in it) of q-grams at ``at`` of ``item``: for the item itself and each region around them."""
    last = np.array([len(t) for t in index.texts[: index.wholes]], np.int64)[item] - REGION
    low = np.maximum(0, -((REGION - index.q - at) // STEP))
    # regions at multiples of the step begin before the last one
    high = np.minimum(at // STEP, (last - 1) // STEP)
    many = np.where(last > 0, np.maximum(0, high - low + 1), 0)
    post = np.repeat(np.arange(len(item)), many)
    nth = low[post] + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    ends = np.flatnonzero((last > 0) & (at >= last))
    entry = [item, index.regions[item[post]] + nth, index.regions[item[ends] + 1] - 1]
    return np.concatenate([np.arange(len(item)), post, ends]), np.concatenate(entry), np.concatenate([at, at[post] - nth * STEP, at[ends] - last[ends]])


def _full_bands(hit: np.ndarray, slot: np.ndarray, of: np.ndarray, many: np.ndarray, index: Index) -> np.ndarray:
    """(text, entry, band), in order, of the bands that reach their bound, from the ``many`` postings of each q-gram at ``hit``."""
    post = np.repeat(index.begin[slot] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    posting, item, place_in = _with_regions(index.item[post], index.at[post], index)
    diagonal, of = np.repeat(hit, many)[posting] - place_in, np.repeat(of, many)[posting]
    step = index.edits[item] + 1
    band = diagonal // step
    # a band is two steps wide; a q-gram counts for its own step and the one before
    key = np.stack([np.concatenate([of, of]), np.concatenate([item, item]), np.concatenate([band, band - 1])])
    order = np.lexsort(key[::-1])
    key = key[:, order]
    lead = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
    count = np.diff(np.append(lead, key.shape[1]))
    return key[:, lead[count >= index.least[key[1, lead]]]]


def find_items(data: np.ndarray, at: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item_id, from, to, edits) for texts in ``data``: bytes of each text, one row for each band that verifies.

    Regions of an item that overlap are one row.
    """
    text, place = normal(data)
    edge = np.searchsorted(place, at)
    out: list[tuple[int, int, int, int, int]] = []

    def add(k: int, item: int, a: int, b: int, edits: int) -> None:
        out.append((k, index.ids[item], int(place[a] - at[k]), int(place[b - 1] + 1 - at[k]), edits))

    raw = None
    for i, t in enumerate(index.texts[: index.wholes]):
        if len(t) < index.q:
            raw = raw if raw is not None else text.tobytes()
            a = raw.find(t)
            while a >= 0:
                k = int(np.searchsorted(edge, a, "right")) - 1
                if a + len(t) <= edge[k + 1]:
                    add(k, i, a, a + len(t), 0)
                a = raw.find(t, a + 1)
    grams = gram_hashes(text, index.q)
    if not len(grams) or not len(index.grams):
        return out
    hit = np.flatnonzero(index.gate[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
    slot = np.minimum(np.searchsorted(index.grams, grams[hit]), len(index.grams) - 1)
    true = index.grams[slot] == grams[hit]
    hit, slot = hit[true], slot[true]
    of = np.searchsorted(edge, hit, "right") - 1
    inside = hit + index.q <= edge[of + 1]
    hit, slot, of = hit[inside], slot[inside], of[inside]
    many = index.begin[slot + 1] - index.begin[slot]
    # whole texts at a time, in their order
    last = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)) if len(of) else np.zeros(0, np.int64)
    total = np.append(0, np.cumsum(many))
    bands, a = [np.zeros((3, 0), np.int64)], 0
    while a < len(hit):
        b = int(max(last[np.searchsorted(last, a, "right")], last[max(0, np.searchsorted(total[last], total[a] + SHARED, "right") - 1)]))
        bands.append(_full_bands(hit[a:b], slot[a:b], of[a:b], many[a:b], index))
        a = b
    held: dict[tuple[int, int], list[tuple[int, int]]] = {}  # where whole items stand
    parts: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

    def found_at(k: int, i: int, a: int, b: int, edits: int) -> None:
        if i < index.wholes:
            held.setdefault((k, index.ids[i]), []).append((a, b))
            add(k, i, a, b, edits)
        else:
            parts.setdefault((k, i), []).append((a, b, edits))

    for k, i, b in np.concatenate(bands, axis=1).T:  # of a text, whole items come first
        budget, m = int(index.edits[i]), len(index.texts[i])
        a = int(b * (budget + 1))
        lo, hi = max(int(edge[k]), a), min(int(edge[k + 1]), a + 2 * (budget + 1) + m + budget)
        if i >= index.wholes and any(min(t, hi) - max(f, lo) >= m // 2 for f, t in held.get((k, index.ids[i]), ())):
            continue
        spot = text[lo:hi].tobytes().find(index.texts[i])
        if spot >= 0:
            found_at(k, i, lo + spot, lo + spot + m, 0)
            continue
        shift = max(0, lo - a)
        found = banded_distance(np.frombuffer(index.texts[i], np.uint8), text[lo:hi], max(1, 2 * (budget + 1) - shift), budget)
        if found:
            found_at(k, i, lo + found[1], lo + max(found[2], found[1] + 1), found[0])
    joined: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    for (k, i), spans in parts.items():
        joined.setdefault((k, int(np.searchsorted(index.regions, i, "right")) - 1), []).extend((a, b, edits, i) for a, b, edits in spans)
    for (k, i), spans in joined.items():
        spans.sort()
        a, b, edits, _ = spans[0]
        for f, t, e, _ in spans[1:]:
            if f >= b:
                add(k, i, a, b, edits)
                a, b, edits = f, t, e
            else:
                b, edits = max(b, t), min(edits, e)
        add(k, i, a, b, edits)
    return out


def _searched(index, *path: int):
    """(row, spans) of each row; ``path`` leads to the text within the row, else it is the second column."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("from", pa.int64()), ("to", pa.int64()), ("edits", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0 if path else 1)
            for k in path:
                text = text.field(k)
            for i, j, data, at in pieces(text, CHUNK):
                found: list[dict] = [{} for _ in range(j - i)]
                for k, item, a, b, edits in find_items(data, at, index.value):
                    old = found[k].get((item, a))
                    if old is None or edits < old["edits"]:
                        found[k][item, a] = {"item_id": item, "from": a, "to": b, "edits": edits}
                spans = [sorted(x.values(), key=lambda s: (s["from"], s["to"], s["item_id"])) for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(spans, kind)], names=["row", "spans"])

    return lean(rows)


def item_blocks(benchmark: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``size`` bytes (or of one item)."""
    b = pick(benchmark, item_id="bigint", text="string").where("item_id is not null and text is not null")
    block, held = [], 0
    for r in b.distinct().toLocalIterator():
        if block and held + len(r.text) > size:
            yield block
            block, held = [], 0
        block.append((r.item_id, r.text))
        held += len(r.text)
    yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = GRAM, rate: float = RATE) -> DataFrame:
    """(row..., spans) for every row of ``docs`` (doc_id, text and what else it has).

    ``spans`` lists (item_id, from, to, edits), in bytes of the text.
    """
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"))
    at = next((k for k, f in enumerate(docs.schema) if f.name == "text" and f.dataType == StringType()), None)
    # a row goes to Python once, with its text; only what is no string yet goes beside it
    text = lambda of: [] if at is not None else [F.coalesce(F.col(of).cast("string"), F.lit("")).alias("text")]
    schema = lambda df: f"row {df.schema['row'].dataType.simpleString()}, spans array<struct<item_id:bigint,from:bigint,to:bigint,edits:bigint>>"
    out = None
    for block in item_blocks(benchmark):
        index = spark.sparkContext.broadcast(build_index(block, q, rate))
        if out is None:
            out = rows.select("row", *text("row.text")).mapInArrow(_searched(index, *([] if at is None else [at])), schema(rows))
        else:  # further blocks search the same rows again and add their spans
            more = out.select(F.struct("row", "spans").alias("row"), *text("row.text"))
            more = more.mapInArrow(_searched(index, *([] if at is None else [0, at])), schema(more))
            out = more.select("row.row", F.concat("row.spans", "spans").alias("spans"))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, q: int = GRAM, rate: float = RATE) -> DataFrame:
    """(doc_id, contaminated, items, n_spans, spans), a row for each row of ``docs``."""
    out = find_leaks(pick(docs, doc_id="bigint", text="string"), benchmark, q, rate)
    return out.select("row.doc_id", (F.size("spans") > 0).alias("contaminated"), F.array_sort(F.array_distinct("spans.item_id")).alias("items"), F.size("spans").cast("bigint").alias("n_spans"), "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = GRAM, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    return find_leaks(docs, benchmark, q, rate).where("size(spans) = 0").select("row.*")
