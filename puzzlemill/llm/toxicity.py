"""Toxicity by compression distance between two zstandard dictionaries.

A text is respelled: every word becomes two symbols of eight bytes, one for the
word and one for its first six bytes (its stem), A-Z folded.  In plain letters
a match saves hardly more than its description costs; in wide symbols it saves
most of them, so that compressed lengths of short windows tell something.

* Two dictionaries are trained, one on toxic and one on ordinary text: the
  symbols whose document frequency is higher there than in the other class, by
  a likelihood ratio, in rising order, so the strongest lie nearest.
* Windows of ``WINDOW`` words are compressed with both; the difference of the
  lengths is the window's distance.
* The largest distance of a text and its mean positive distance pass calibrated
  thresholds: a logistic function fitted on labelled texts, each measured with
  dictionaries trained on the other half of them, so that words learned by
  heart do not count.

Document frequencies cover all labelled training texts; the calibration takes
``calibrate`` texts at most, the first by a hash of doc_id.

zstandard's own trainer was tried on windows of toxic and of ordinary texts,
respelled: held-out recall 0.01 (README), since it keeps what is frequent, not
what tells the classes apart.

Defined results: null and empty texts have no windows and get the score of
distance 0; texts of any length are judged whole, window by window; equally
strong symbols go by their hash; several labels of one doc_id count as toxic if any is; null labels
and labels other than 0 and 1 are no labels; a null doc_id counts as empty text
for the held-out remainder; without toxic or without ordinary labels every
score is the smoothed share of toxic ones; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import checkpoint, pick
from .shingles import pieces, span_hashes, word_spans
from .substrings import lean

WINDOW = 16
STEM = 6
#: Twice the log likelihood ratio is chi-squared: this is far beyond chance.
EVIDENCE = 20.0
LEAST = 4
SYMBOLS = 4096
#: Bytes of texts that are judged at once.
CHUNK = 1 << 18
#: Labels up to this number may be broadcast; more are joined by a shuffle.
SMALL = 500_000
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STEM_TAG = np.uint64(0x5851F42D4C957F2D)


def respell(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts, two a word, as one array, and the offsets of the texts in it."""
    text, first, last = word_spans(data, at, _APART)
    out = np.empty(2 * len(text), np.uint64)
    if len(text):
        out[0::2] = span_hashes(data, first, np.minimum(last, first + STEM)) ^ _STEM_TAG
        out[1::2] = span_hashes(data, first, last)
    return out, 2 * np.searchsorted(text, np.arange(len(at)))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(symbol, class and half, number of texts), summed by batch; symbol 0 counts texts."""
    for batch in batches:
        kind = batch.column(0).to_numpy()
        found = [[np.zeros(int((kind == k).sum()), np.uint64)] for k in range(4)]
        for i, j, data, at in pieces(batch.column(1)):
            symbols, edge = respell(data, at)
            for k in range(i, j):
                found[kind[k]].append(np.unique(symbols[edge[k - i] : edge[k - i + 1]]))
        for k, x in enumerate(found):
            symbol, n = np.unique(np.concatenate(x), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(symbol.view(np.int64)), pa.array(np.full(len(n), k)), pa.array(n)], names=["symbol", "kind", "n"])


def _compressor(symbols: list[int]) -> zstandard.ZstdCompressor:
    content = np.array(symbols or [0], np.int64).tobytes()
    how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=14, min_match=6, strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=how)


def distances(symbols: np.ndarray, toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Largest distance of a window, and mean positive distance."""
    raw = symbols.tobytes()
    step = 16 * WINDOW
    d = [len(ordinary.compress(raw[k : k + step])) - len(toxic.compress(raw[k : k + step])) for k in range(0, len(raw), step)]
    return (float(max(d)), sum(x for x in d if x > 0) / len(d)) if d else (0.0, 0.0)


def _measured(pairs: list[tuple[list[int], list[int]]]):
    """(row, largest, mean) of each text with the pair of dictionaries that its row names."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(_compressor(a), _compressor(b)) for a, b in pairs]
        for batch in batches:
            which = batch.column(2).to_numpy()
            for i, j, data, at in pieces(batch.column(1)):
                symbols, edge = respell(data, at)
                out = [distances(symbols[edge[k] : edge[k + 1]], *made[which[i + k]]) for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array([x[c] for x in out], pa.float64()) for c in range(2))], names=["row", "largest", "mean"])

    return rows


def _shape(largest: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(largest), np.clip(largest, 0, 24) / 8, np.log1p(np.minimum(mean, 24)), (largest > 0).astype(float)], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _evidence(a: Column, b: Column, na: float, nb: float) -> Column:
    """Log likelihood ratio of a symbol's texts under the shares of the two classes; 0 unless it prefers a."""
    pa_, pb = (a + 0.5) / (na + 1), (b + 0.5) / (nb + 1)
    ratio = a * F.log(pa_ / pb) + (na - a) * F.log((1 - pa_) / (1 - pb))
    return F.when((a >= LEAST) & (pa_ > 2 * pb), ratio).otherwise(0.0)


@dataclass
class Model:
    """Two dictionaries and the calibration; without dictionaries, the share of toxic labels."""

    toxic: list[int]
    ordinary: list[int]
    weights: np.ndarray
    share: float

    def scores(self, largest: np.ndarray, mean: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(largest), self.share)
        return 1 / (1 + np.exp(-np.clip(_shape(largest, mean) @ self.weights, -30, 30)))


def _prepared(docs: DataFrame, folds: int) -> DataFrame:
    d = pick(docs, doc_id="bigint", text="string")
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (crc % folds == 0).alias("held_out"), (F.floor(crc / folds) % 2).cast("int").alias("half"))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, calibrate: int = 50_000) -> Model:
    """Learn from the labelled rows that are not held out."""
    d = _prepared(docs, folds)
    y = pick(labels, doc_id="bigint", toxic="int").where("toxic in (0, 1)").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    y = checkpoint(y)
    known = y.count()
    y = F.broadcast(y) if known <= SMALL else y
    learn = d.where(~F.col("held_out")).join(y, F.col("doc_id") == F.col("label_id"))

    counts = learn.select((F.col("toxic") * 2 + F.col("half")).cast("bigint").alias("kind"), "text").mapInArrow(lean(_frequencies), "symbol bigint, kind bigint, n bigint")
    counts = counts.groupBy("symbol").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in range(4)])
    counts = checkpoint(counts.where(f"symbol = 0 or k0 + k1 >= {LEAST} or k2 + k3 >= {LEAST}"))
    total = counts.where("symbol = 0").first()
    ordinary, toxic = ((total.k0 + total.k1, total.k2 + total.k3) if total else (0, 0))
    share = (toxic + 0.5) / (toxic + ordinary + 1)
    if not ordinary or not toxic:
        return Model([], [], np.zeros(0), share)

    def dictionary(a: str, b: str, na: float, nb: float) -> list[int]:
        e = _evidence(F.expr(a), F.expr(b), na, nb)
        best = counts.where("symbol <> 0").select("symbol", e.alias("e")).where(F.col("e") >= EVIDENCE).orderBy(F.desc("e"), "symbol").limit(SYMBOLS).collect()
        return [r.symbol for r in reversed(best)]

    parts = [("k0 + k1", "k2 + k3"), ("k0", "k2"), ("k1", "k3")]
    sums = [(ordinary, toxic), (total.k0, total.k2), (total.k1, total.k3)]
    pairs = [(dictionary(t, o, nt, no), dictionary(o, t, no, nt)) for (o, t), (no, nt) in zip(parts, sums, strict=True)]
    # each half is measured with what the other half has taught
    row = F.struct("doc_id", "toxic").alias("row")
    # half more than are asked for (a fifth is held out), by the hash that orders them, so that no more are measured
    bound = min(1.0, 1.5 * calibrate / max(known, 1))
    few = learn.where(F.xxhash64("doc_id") <= F.lit(int(bound * (2**64 - 1)) - 2**63)) if bound < 1 else learn
    seen = few.select(row, "text", F.when(F.col("half") == 0, 2).otherwise(1).alias("which")).mapInArrow(lean(_measured(pairs)), "row struct<doc_id:bigint,toxic:int>, largest double, mean double")
    seen = seen.orderBy(F.xxhash64("row.doc_id"), "row.doc_id").limit(calibrate).select("row.toxic", "largest", "mean").toPandas()
    w = fit_logistic(_shape(seen["largest"].to_numpy(), seen["mean"].to_numpy()), seen["toxic"].to_numpy(float))
    return Model(*pairs[0], w, share)


def _judged(model: Model, of: int | None = None):
    """(row, score, largest, mean) of each text: field ``of`` of the row, or else the second column."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = (_compressor(model.toxic), _compressor(model.ordinary))
        for batch in batches:
            for i, j, data, at in pieces(batch.column(1) if of is None else batch.column(0).field(of), CHUNK):
                symbols, edge = respell(data, at)
                d = np.array([distances(symbols[edge[k] : edge[k + 1]], *how) for k in range(j - i)]).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(model.scores(d[:, 0], d[:, 1])), pa.array(d[:, 0]), pa.array(d[:, 1])], names=["row", "score", "largest", "mean"])

    return lean(rows)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, calibrate: int = 50_000) -> DataFrame:
    """(doc_id, held_out, score, predicted, largest, mean), a row for each row of ``docs``."""
    model = train(docs, labels, folds, calibrate)
    d = _prepared(docs, folds).select(F.struct("doc_id", "held_out").alias("row"), "text")
    out = d.mapInArrow(_judged(model), "row struct<doc_id:bigint,held_out:boolean>, score double, largest double, mean double")
    return out.select("row.doc_id", "row.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "largest", "mean")


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, calibrate: int = 50_000) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic."""
    model = train(docs, labels, folds, calibrate)
    of = next((k for k, f in enumerate(docs.schema) if f.name == "text" and f.dataType == StringType()), None)
    # a row goes to Python once, with its text; only what is no string yet goes beside it
    text = [] if of is not None else [F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *text)
    out = d.mapInArrow(_judged(model, of), f"row {d.schema['row'].dataType.simpleString()}, score double, largest double, mean double")
    return out.where("score < 0.5").select("row.*")
