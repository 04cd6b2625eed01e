"""Language-model scores from a log-bilinear model trained with noise contrast.

Tokens are the words of a text and one end.  The model predicts a token's symbol
from the symbols of the ``POSITIONS`` tokens before it (the end stands before
the first word) and the token within its symbol:

* The end and every word that is frequent enough in training (``LEAST`` times,
  the ``HEADS`` most frequent at most) are symbols of their own, so what the
  model learns grows with the corpus.  Every other word falls into one of
  ``TAILS`` symbols by its last three bytes, so unseen words have one too.
* Each position is log-bilinear: the vector of the symbol there, mapped by the
  position's own matrix, is multiplied with every symbol's vector, plus a bias,
  and normalised over all symbols.  Since a position sees one symbol, its
  normalisers are as many as symbols, and batched matrix products give them.
  The positions and the smoothed frequencies are mixed with fitted weights.
* Training is noise-contrastive estimation in numpy over the texts themselves:
  in batches of token pairs against words drawn from the training frequencies,
  step sizes by Adagrad.  Every partition trains on all its texts from one
  start; the results are averaged, each row by how often it was trained.
* P(word | tail symbol) is the symbol's additively smoothed frequency, with the
  rest for words that training has not seen.

Everything is counted, trained and fitted over all training texts.  A token bears
on the weights of the mixture only by how its probabilities compare, so tokens
are counted by those ratios, in steps of an eighth power of two, and the weights
fit the counts of all.  Counts of words that are not among the ``local`` most
frequent are joined by the word's 64-bit hash.

Defined results: null text is empty and has only its end; texts of any length
are scored whole; a null doc_id counts as empty text for the held-out remainder
and is kept; repeated rows are scored (and learned from) one by one; equally
frequent words go by hash; without training texts all symbols are equally
likely; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, pick
from .shingles import _FOLD, pieces, span_hashes, word_spans

TAILS = 256
HEADS, LEAST = 1 << 14, 10
#: Tokens before that the model sees; size of vectors; noise words of a batch; pairs of a batch.
POSITIONS, SIZE, NOISE, BATCH = 2, 24, 192, 4096
RATE = 0.05
#: So many tokens are worked on at once, which a core's cache holds.
STRIP = 1024
#: Rows of a parameter in one message, and how many messages are summed at once.
ROWS, FAN = 2048, 64
#: Ratios of probabilities are told apart in so many steps a power of two, up to so many powers.
STEPS, POWERS = 8, 24
END = -1  # its hash; a word that has this hash too would be counted with it
LOCAL = 1 << 18
FLUSH = 1 << 21
EXTRA = 0.1


@dataclass
class Model:
    """Everything of bounded size that scoring needs.  Symbols: the end, the tails, the heads."""

    hashes: np.ndarray  # sorted, of the most frequent words
    counts: np.ndarray
    symbols: np.ndarray  # a head's symbol, or -1
    rest: np.ndarray  # log10 of each symbol's mass, 0 for heads
    freq: np.ndarray  # P(symbol)
    parts: dict[str, np.ndarray] = field(default_factory=dict)  # of the log-bilinear model
    norms: np.ndarray | None = None  # log of each position's normaliser, by the symbol there
    mix: np.ndarray | None = None  # weights of the positions and of the frequencies
    jump: np.ndarray | None = None  # where the hashes with each beginning start; made where it is used


def tail_class(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Tail symbol of each word by its last three bytes."""
    code = np.zeros(len(first), np.uint64)
    for back in (1, 2, 3):
        inside = last - back >= first
        byte = _FOLD[data[np.where(inside, last - back, first)]].astype(np.uint64) + np.uint64(1)
        code = code * np.uint64(257) + np.where(inside, byte, np.uint64(0))
    code *= np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(32)).astype(np.int64) % TAILS + 1


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """(text, hash) of each word, and a function that gives the tail classes of some."""
    text, first, last = word_spans(data, at)
    value = span_hashes(data, first, last) if len(first) else np.zeros(0, np.uint64)
    return text, value.view(np.int64), lambda some: tail_class(data, first[some], last[some]) if len(some) else np.zeros(0, np.int64)


def _groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order of ``rows`` by value, where in it each value begins)."""
    order = np.argsort(rows, kind="stable" if rows.dtype == np.uint16 else None)  # 16 bits are sorted by radix
    rows = rows[order]
    return order, np.flatnonzero(np.concatenate([rows[:1] == rows[:1], rows[1:] != rows[:-1]]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def merged() -> tuple[np.ndarray, ...]:
        word, tail, count = (np.concatenate(x) for x in zip(*held, strict=True))
        order, lead = _groups(word)
        return word[order[lead]], np.minimum.reduceat(tail[order], lead), np.add.reduceat(count[order], lead)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["h", "tail", "c"])

    for batch in batches:
        for i, j, data, at in pieces(batch.column(0)):
            _, word, tails = _words(data, at)
            order, lead = _groups(word)
            where = order[lead]
            ends = [np.array([x]) for x in (END, 0, j - i)]
            held.append(tuple(np.concatenate(x) for x in zip((word[where], tails(where), np.diff(lead, append=len(word))), ends, strict=True)))
            size += len(lead)
            if size > FLUSH:
                held = [merged()]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield out()
                    held, size = [], 0
    if held:
        held = [merged()]
        yield out()


def _places(model: Model, word: np.ndarray) -> np.ndarray:
    """The place of the first hash that is not below each word's; the last one's if there is none.

    A search that begins where the hashes with the word's first bits do: few are left between.
    """
    hashes, bits = model.hashes, 20
    if model.jump is None:
        model.jump = np.searchsorted(hashes, (np.arange(1 << bits) - (1 << bits - 1)) << 64 - bits)
    at = np.minimum(model.jump[(word >> 64 - bits) + (1 << bits - 1)], len(hashes) - 1)
    left = np.flatnonzero(hashes[at] < word)
    for _ in range(16):
        left = left[at[left] < len(hashes) - 1]
        if not len(left):
            return at
        at[left] += 1
        left = left[hashes[at[left]] < word[left]]
    at[left] = np.minimum(np.searchsorted(hashes, word[left]), len(hashes) - 1)
    return at


def _known(model: Model, word: np.ndarray, tails: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(count, symbol) of each word; count -1 where it isn't among the most frequent."""
    if not len(model.hashes) or not len(word):
        return np.full(len(word), -1), tails(np.arange(len(word)))
    at = _places(model, word)
    hit = model.hashes[at] == word
    symbol = np.where(hit, model.symbols[at], -1)
    tail = np.flatnonzero(symbol < 0)
    symbol[tail] = tails(tail)
    return np.where(hit, model.counts[at], -1), symbol


def _sequence(text: np.ndarray, symbol: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(text, symbol, symbols at each position before) of the tokens of n texts: their words, then the end."""
    place = np.arange(len(text)) + text  # one end for each text before
    of = np.zeros(len(text) + n, np.int64)
    now = np.zeros(len(text) + n, np.int64)
    now[place] = symbol
    is_end = np.ones(len(now), bool)
    is_end[place] = False
    of[place], of[is_end] = text, np.arange(n)
    before = []
    for k in range(1, POSITIONS + 1):
        shifted = np.zeros(len(now), np.int64)
        shifted[k:] = np.where(of[k:] == of[:-k], now[:-k], 0)
        before.append(shifted)
    return of, now, before


def start(freq: np.ndarray, size: int = SIZE, seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters before training: the biases alone give the frequencies."""
    rng = np.random.default_rng(seed)
    near = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    maps = {f"map{k}": np.eye(size, dtype=np.float32) for k in range(POSITIONS)}
    return {"context": near(len(freq), size), "target": near(len(freq), size), "bias": np.log(freq).astype(np.float32)[:, None], **maps}


class Trainer:
    """Noise-contrastive estimation on batches of (symbol before, symbol), by position."""

    def __init__(self, freq: np.ndarray, parts: dict[str, np.ndarray], seed: int):
        self.freq, self.p = freq, {k: v.copy() for k, v in parts.items()}
        self.square = {k: np.full((len(v), 1), 1e-6, np.float32) for k, v in parts.items()}
        self.seen = {k: np.zeros(len(v), np.float64) for k, v in parts.items()}
        self.edges = np.cumsum(freq)
        self.shift = np.log(NOISE * freq).astype(np.float32)
        self.rng = np.random.default_rng(seed)

    def _step(self, name: str, rows: np.ndarray, order: np.ndarray, lead: np.ndarray, grad: np.ndarray) -> None:
        """Adagrad on the sums of the gradients of equal rows."""
        total, rows = np.add.reduceat(grad.take(order, 0), lead, axis=0), rows[order[lead]]
        square = self.square[name][rows] + np.einsum("ij,ij->i", total, total)[:, None] / np.float32(total.shape[1])
        self.square[name][rows] = square
        total *= RATE / np.sqrt(square)
        self.p[name][rows] += total
        self.seen[name][rows] += np.diff(lead, append=len(order))

    def learn(self, position: int, before: np.ndarray, now: np.ndarray) -> None:
        p, name = self.p, f"map{position}"
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE) * self.edges[-1]), len(self.freq) - 1)
        here = p["context"][before]
        query, goal, drawn = here @ p[name], p["target"][now], p["target"][noise]
        hit = np.einsum("ij,ij->i", query, goal) + p["bias"][now, 0] - self.shift[now]
        up = 1 / (1 + np.exp(np.clip(hit, -30, 30)))  # how far a true word is from being taken for one
        back, away, still = up[:, None] * goal, -drawn.T, self.shift[noise] - p["bias"][noise, 0]
        pull, fall = np.zeros_like(drawn), np.zeros(NOISE, np.float32)
        for k in range(0, len(now), STRIP):
            down = query[k : k + STRIP] @ away  # and a drawn one from being seen through
            down += still
            np.clip(down, -30, 30, out=down)
            np.exp(down, out=down)
            down += 1
            np.divide(-1, down, out=down)
            back[k : k + STRIP] += down @ drawn
            pull += down.T @ query[k : k + STRIP]
            fall += down.sum(0)
        whole = here.T @ back / np.float32(np.sqrt(len(now)))
        small = np.uint16 if len(self.freq) <= 1 << 16 else np.int64
        both = np.concatenate([now, noise])
        ways = _groups(both.astype(small))
        self._step("target", both, *ways, np.concatenate([up[:, None] * query, pull]))
        self._step("bias", both, *ways, np.concatenate([up, fall])[:, None])
        self._step("context", before, *_groups(before.astype(small)), back @ p[name].T)
        every = np.arange(len(whole))
        self._step(name, every, every, every, whole)


def normalisers(parts: dict[str, np.ndarray]) -> np.ndarray:
    """Log of the sum over all symbols, for each position and each symbol there."""
    out = np.zeros((POSITIONS, len(parts["context"])))
    for k in range(POSITIONS):
        query = parts["context"] @ parts[f"map{k}"]
        for at in range(0, len(query), 512):
            s = query[at : at + 512] @ parts["target"].T + parts["bias"][:, 0]
            most = s.max(1)
            out[k, at : at + 512] = most + np.log(np.exp(s - most[:, None]).sum(1, dtype=np.float64))
    return out


def chances(m: Model, now: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    """P(symbol) of each token by each position, and by the frequencies."""
    out = np.empty((POSITIONS + 1, len(now)))
    for at in range(0, len(now), STRIP):
        some = slice(at, at + STRIP)
        goal, bias = m.parts["target"].take(now[some], 0), m.parts["bias"][now[some], 0]
        for k in range(POSITIONS):
            here = before[k][some]
            out[k, some] = np.einsum("ij,ij->i", m.parts[f"query{k}"].take(here, 0), goal) + bias - m.norms[k][here]
    np.exp(out[:-1], out=out[:-1])
    out[-1] = m.freq[now]
    return out


def fit_mix(p: np.ndarray, count: np.ndarray | None = None, rounds: int = 30) -> np.ndarray:
    """Weights of a mixture by expectation and maximisation; each column of ``p`` counts so often, or once."""
    w = np.full(len(p), 1 / len(p))
    for _ in range(rounds):
        share = w[:, None] * p
        w = np.average(share / share.sum(0), axis=1, weights=count)
    return w


def ratio_cells(p: np.ndarray) -> np.ndarray:
    """A number for each column of ``p``: how its rows compare with the last one."""
    side, most = 2 * POWERS * STEPS + 1, POWERS * STEPS
    cell = np.zeros(p.shape[1], np.int64)
    low = np.log2(np.maximum(p[-1], 1e-300))
    for row in p[:-1]:
        step = np.rint((np.log2(np.maximum(row, 1e-300)) - low) * STEPS)
        cell = cell * side + np.clip(step, -most, most).astype(np.int64) + most
    return cell


def cell_ratios(cell: np.ndarray, rows: int = POSITIONS + 1) -> np.ndarray:
    """Probabilities that compare as those of each cell do; the last row is 1."""
    side, most = 2 * POWERS * STEPS + 1, POWERS * STEPS
    out = np.ones((rows, len(cell)))
    for k in range(rows - 2, -1, -1):
        out[k] = 2.0 ** ((cell % side - most) / STEPS)
        cell = cell // side
    return out


def _trained(model):
    """Parameters that a partition's texts have taught, in blocks of rows, times how often each was trained."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        who = TaskContext.get().partitionId()
        trainer, turn = Trainer(m.freq, m.parts, 1000 + who), 0
        for batch in batches:
            for i, j, data, at in pieces(batch.column(0)):
                text, word, tails = _words(data, at)
                _, now, before = _sequence(text, _known(m, word, tails)[1], j - i)
                # in random order, batch by batch for one position after the other
                order = trainer.rng.permutation(len(now))
                for k in range(0, len(now), BATCH):
                    some = order[k : k + BATCH]
                    trainer.learn(turn % POSITIONS, before[turn % POSITIONS][some], now[some])
                    turn += 1
        for name, value in trainer.p.items():
            seen = trainer.seen[name]
            blocks = range(0, len(value), ROWS)
            yield pa.RecordBatch.from_pydict(
                {
                    "name": [name] * len(blocks),
                    "block": [k // ROWS for k in blocks],
                    "who": [who] * len(blocks),
                    "total": [(value[k : k + ROWS] * seen[k : k + ROWS, None]).astype(np.float32).tobytes() for k in blocks],
                    "seen": [seen[k : k + ROWS].astype(np.float32).tobytes() for k in blocks],
                },
                schema=pa.schema([("name", pa.string()), ("block", pa.int32()), ("who", pa.int32()), ("total", pa.binary()), ("seen", pa.binary())]),
            )

    return rows


_PARAMETERS = "name string, block int, who int, total binary, seen binary"


def _summed(table: pa.Table) -> pa.Table:
    """Messages of one block as one, added in a fixed order."""
    order = np.argsort(table.column("who").to_numpy(), kind="stable")
    add = lambda c: sum(np.frombuffer(table.column(c)[int(k)].as_py(), np.float32).astype(np.float64) for k in order).astype(np.float32).tobytes()
    first = table.slice(int(order[0]), 1)
    return pa.table({"name": first["name"], "block": first["block"], "who": first["who"], "total": pa.array([add("total")], pa.binary()), "seen": pa.array([add("seen")], pa.binary())})


def _averaged(learn: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """Train on all texts; rows that no partition has trained stay as they were."""
    spark = learn.sparkSession
    sent = learn.mapInArrow(_trained(spark.sparkContext.broadcast(model)), _PARAMETERS)
    # a tree: so many partitions at once, whatever their number
    sent = sent.groupBy("name", "block", F.floor(F.col("who") / FAN).alias("few")).applyInArrow(_summed, _PARAMETERS)
    sent = sent.groupBy("name", "block").applyInArrow(_summed, _PARAMETERS)
    parts = {k: v.copy() for k, v in model.parts.items()}
    for r in sent.collect():  # one row a block
        at = slice(r.block * ROWS, (r.block + 1) * ROWS)
        seen = np.frombuffer(r.seen, np.float32)
        total = np.frombuffer(r.total, np.float32).reshape(len(seen), -1)
        taught = seen > 0
        parts[r["name"]][at][taught] = total[taught] / seen[taught, None]
    return parts


def _compared(model):
    """The tokens of a partition's texts, counted by the cell of their ratios."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        count = np.zeros((2 * POWERS * STEPS + 1) ** POSITIONS, np.int64)
        for batch in batches:
            for i, j, data, at in pieces(batch.column(0)):
                text, word, tails = _words(data, at)
                _, now, before = _sequence(text, _known(m, word, tails)[1], j - i)
                cell, many = np.unique(ratio_cells(chances(m, now, before)), return_counts=True)
                count[cell] += many
        cell = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(count[cell])], names=["cell", "n"])

    return rows


def _scored(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for i, j, data, at in pieces(batch.column(1)):
                n = j - i
                text, word, tails = _words(data, at)
                count, symbol = _known(m, word, tails)
                of, now, before = _sequence(text, symbol, n)
                here = count >= 0
                seen = np.log10(np.maximum(count, 0) + EXTRA)
                sums = lambda x, by=text: np.bincount(by, x, minlength=n)
                within = np.where((symbol > 0) & (symbol <= TAILS), np.where(here, seen, 0.0) - m.rest[np.minimum(symbol, TAILS)], 0.0)
                score = sums(np.log10(m.mix @ chances(m, now, before)), of) + sums(within)
                rare = np.flatnonzero(~here)
                edge = np.searchsorted(text[rare], np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n),
                        pa.array(np.bincount(of, minlength=n)),
                        pa.array(sums(here & (count > 0)).astype(np.int64)),
                        pa.array(sums(np.where(here, seen, 0.0))),
                        pa.array(score),
                        pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(word[rare])),
                    ],
                    names=["row", "n_tokens", "known", "base", "score", "rare"],
                )

    return rows


def _most_frequent(counts: DataFrame, most: int):
    """The most frequent words, ``most`` at most, in order: those above a count that so many exceed.

    Only they reach the driver, however many partitions there are.
    """
    step = F.floor(F.log2("c") * 8)
    found, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r.step):
        found += r.n
        if found > most:
            break
        least = r.c
    return counts.where(F.col("c") >= F.lit(least)).toPandas().sort_values(["c", "h"], ascending=[False, True], ignore_index=True)


def score_documents(docs: DataFrame, folds: int = 10, local: int = LOCAL) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``."""
    spark = docs.sparkSession
    d = pick(docs, doc_id="bigint", text="string")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 0
    d = d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    learn = d.where(~F.col("held_out")).select("text")
    counts = learn.mapInArrow(_counted, "h bigint, tail bigint, c bigint").groupBy("h").agg(F.min("tail").cast("int").alias("tail"), F.sum("c").alias("c"))
    counts = checkpoint(counts)

    # bounded sizes from here: the most frequent words, sums of the tails, vectors of the symbols
    top = _most_frequent(counts.where(F.col("h") != END), local)
    heads = top.iloc[:HEADS]
    heads = heads[heads["c"] >= LEAST]
    by_tail = counts.groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas().set_index("tail")
    total, kinds = int(by_tail["n"].sum()) if len(by_tail) else 0, int(by_tail["v"].sum()) if len(by_tail) else 0
    mass, weight = np.zeros(1 + TAILS), np.zeros(1 + TAILS)
    weight[0] = by_tail["n"].get(0, 0) if total else 0
    for k in range(1, 1 + TAILS):
        n, v = (by_tail["n"].get(k, 0), by_tail["v"].get(k, 0)) if len(by_tail) else (0, 0)
        own = heads[heads["tail"] == k]
        weight[k] = n - own["c"].sum()
        mass[k] = weight[k] + EXTRA * (v - len(own) + 1)
    weight = np.concatenate([weight, heads["c"].to_numpy(float)])
    order = np.argsort(top["h"].to_numpy(np.int64))
    symbols = np.where(order < len(heads), order + 1 + TAILS, -1)
    freq = (weight + EXTRA) / (weight + EXTRA).sum()
    model = Model(top["h"].to_numpy(np.int64)[order], top["c"].to_numpy(np.int64)[order], symbols, np.log10(np.where(mass > 0, mass, 1.0)), freq, start(freq))
    model.parts = _averaged(learn, model)
    model.norms = normalisers(model.parts)
    model.parts |= {f"query{k}": model.parts["context"] @ model.parts[f"map{k}"] for k in range(POSITIONS)}
    # one row a cell, whatever the input; in order, so that sums agree
    fits = learn.mapInArrow(_compared(spark.sparkContext.broadcast(model)), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas().sort_values("cell")
    model.mix = fit_mix(cell_ratios(fits["cell"].to_numpy(np.int64)), fits["n"].to_numpy(np.int64), rounds=300) if len(fits) else np.eye(POSITIONS + 1)[-1]

    rows = d.select(F.struct("doc_id", "held_out", F.xxhash64("doc_id", "text").alias("key")).alias("row"), "text")
    scored = rows.mapInArrow(
        _scored(spark.sparkContext.broadcast(model)), "row struct<doc_id:bigint,held_out:boolean,key:bigint>, n_tokens bigint, known bigint, base double, score double, rare array<bigint>"
    )
    scored = checkpoint(scored.select("row.*", "n_tokens", "known", "base", "score", "rare"))
    # rare words of equal rows add up under one key, and are divided by the rows again
    rare = scored.select("key", F.explode("rare").alias("h")).join(counts.select("h", "c"), "h", "left")
    rare = rare.groupBy("key").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(EXTRA))).alias("r_log"), F.count("c").alias("r_known"))
    alike = scored.groupBy("key").agg(F.count("*").alias("rows"))
    out = scored.drop("rare").join(alike.join(rare, "key", "left"), "key")
    r_log = F.coalesce(F.col("r_log") / F.col("rows"), F.lit(0.0))
    spread = float(np.log10(total + EXTRA * (kinds + 1)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce(F.col("r_known") / F.col("rows"), F.lit(0)).cast("bigint") + F.lit(1 if total else 0)).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + r_log + F.lit(_end_log(by_tail, total)) - F.col("n_tokens") * F.lit(spread)).alias("base_score"),
        (F.col("score") + r_log).alias("score"),
    )


def _end_log(by_tail, total: int) -> float:
    """log10 of the end's smoothed count."""
    return float(np.log10((by_tail["n"].get(0, 0) if total else 0) + EXTRA))
