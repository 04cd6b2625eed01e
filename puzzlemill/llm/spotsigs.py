"""Document fingerprints from SpotSigs.

Wherever a common word (an anchor) stands, the chain of the next content words
after it forms a signature.  The fingerprint is the sorted set of signatures,
eight hexadecimal digits each; the likeness of two fingerprints is the Jaccard
similarity of their sets.  Anchors are function words of several languages, a
parameter.  A text that has words but yields no signature (no anchors, or
nothing after them) takes every word as an anchor instead, and the sequence of
its words if that is shorter than a chain, so different texts differ.

``similar_pairs`` finds pairs of a whole table: a set's size bounds the sizes
that can be similar to it, so sets are partitioned by size, and within
partitions they meet by the first signatures, in the order of their hashes, of
which a similar set must share one.

Defined results: texts of any length are fingerprinted whole; null, empty and
wordless texts have the empty fingerprint;
two empty fingerprints have likeness 1, an empty and another one 0; equal texts
have equal fingerprints; rows with a null doc_id have no neighbour (an empty
text stands for it); rows with one doc_id follow each other by text; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, let, pick

ANCHORS = tuple(
    """a an and are as at be but by for from had has have he her his in is it its not of on or she that the their
    they this to was we were which will with you
    au aux avec ce dans de des du elle en est et il la le les ne nous ou par pas pour que qui se sur un une
    aber als auf aus bei das dem den der die ein eine er es für ist mit nicht sich sie und von wir zu
    al como con del el ella era fue las lo los más no para pero por su una y""".split()
)
CHAIN = 2
#: Ids up to this number may be broadcast; more are joined by a shuffle.
SMALL = 200_000
NO_WORD = r"[^\p{L}\p{N}]+"


def text_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    plain = F.btrim(F.regexp_replace(F.lower(text), NO_WORD, " "))
    return let(plain, lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, " ", -1)))


def _chains(words: Column, anchors: tuple[str, ...], chain: int) -> Column:
    """A signature for each anchor that a content word follows."""
    places = F.sequence(F.lit(0), F.size(words) - 1)
    content = F.when(F.size(words) > 0, F.filter(places, lambda i: ~F.get(words, i).isin(*anchors))).otherwise(F.array().cast("array<int>"))

    def after(at: Column) -> Column:
        def own(place: Column, k: Column) -> Column:
            before = F.coalesce(F.get(at, k - 1), F.lit(-1))
            parts = [F.get(words, F.get(at, k + j)) for j in range(chain)]
            spots = F.slice(words, before + F.lit(2), place - before - F.lit(1))
            return F.transform(spots, lambda a: F.xxhash64(a, *parts))

        return F.flatten(F.transform(at, own))

    return let(content, after)


def _grams(words: Column, width: int) -> Column:
    """Every word with its followers; the whole sequence if it is shorter."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(each)


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> Column:
    """The set of signatures as a sorted array of 32-bit numbers."""

    def body(words: Column) -> Column:
        own = let(_chains(words, anchors, chain), lambda s: F.when(F.size(s) > 0, s).otherwise(_grams(words, chain + 1)))
        return F.array_sort(F.array_distinct(F.transform(own, lambda h: F.shiftright(h, 32).cast("int"))))

    return let(text_words(F.coalesce(text, F.lit(""))), body)


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.lower(F.hex(h.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    common = F.size(F.array_intersect(a, b))
    value = let(common, lambda c: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(c / (F.size(a) + F.size(b) - c)))
    # sizes bound the similarity: sets without a common size class need no look
    return F.when((F.size(a) == 0) != (F.size(b) == 0), F.lit(0.0)).otherwise(value)


def with_next(rows: DataFrame, bits: int = 8, enrich: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``rows`` (doc_id, text), enriched, with the following row as struct ``next``, in order of doc_id and text.

    The last row is followed by the first.  Rows are dealt by ranges of 2**bits
    ids, so a row's neighbour is mostly in its range; only the first row of each
    range is fetched for the range before.  Which range that is comes from the
    same step over the ranges, and so on until few are left.
    """
    rows = rows.where("doc_id is not null").withColumn("range", F.shiftright("doc_id", bits))
    rich = enrich(rows)
    whole = [c for c in rich.columns if c != "range"]
    heads = checkpoint(rows.groupBy("range").agg(F.min("doc_id").alias("head_id")))
    order = next_range(heads.select("range"), bits)
    wanted = order.join(heads.withColumnRenamed("range", "next_range"), "next_range").select("range", F.col("head_id").alias("doc_id"))
    wanted = checkpoint(wanted)
    found = rows.drop("range").join(F.broadcast(wanted) if wanted.count() <= SMALL else wanted, "doc_id")
    found = enrich(found).groupBy("range").agg(F.min(F.struct(*whole)).alias("head"))
    inside = F.lead(F.struct(*whole)).over(W.partitionBy("range").orderBy("doc_id", "text"))
    dealt = rich.withColumn("inside", inside).join(found, "range", "left")
    return dealt.select(*whole, F.coalesce("inside", "head").alias("next"))


def next_range(ranges: DataFrame, bits: int) -> DataFrame:
    """(range, next_range) for distinct ranges, the last followed by the first."""
    ends = ranges.agg(F.min("range").alias("low"), F.max("range").alias("high")).first()
    if ends.low is None or ends.high - ends.low < 1 << bits:
        nxt = F.lead("range").over(W.orderBy("range"))  # 2**bits rows at most
        return ranges.select("range", F.coalesce(nxt, F.lit(ends.low)).alias("next_range"))
    ranges = checkpoint(ranges.withColumn("group", F.shiftright("range", bits)))
    outer = next_range(ranges.select(F.col("group").alias("range")).distinct(), bits)
    heads = ranges.groupBy(F.col("group").alias("next_range")).agg(F.min("range").alias("head"))
    arrive = outer.join(heads, "next_range").select(F.col("range").alias("group"), "head")
    nxt = F.lead("range").over(W.partitionBy("group").orderBy("range"))
    return ranges.withColumn("next_range", nxt).join(arrive, "group").select("range", F.coalesce("next_range", "head").alias("next_range"))


def fingerprints(docs: DataFrame, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """(doc_id, fingerprint, n_signatures), a row for each row of ``docs``."""
    d = pick(docs, doc_id="bigint", text="string")
    s = signatures(F.col("text"), anchors, chain)
    return d.select("doc_id", s.alias("sigs")).select("doc_id", fingerprint(F.col("sigs")).alias("fingerprint"), F.size("sigs").cast("bigint").alias("n_signatures"))


def edited_likeness(docs: DataFrame, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Fingerprints of texts and of edited texts, and how alike they are.

    The edited text has its last floor(n / 4) code points replaced by as many
    first ones of the next document.  A row for each row of ``docs``: (doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_signatures).
    """
    d = pick(docs, doc_id="bigint", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    enrich = lambda df: df.withColumn("sigs", signatures(F.col("text"), anchors, chain))
    alone = enrich(d.where("doc_id is null")).withColumn("next", F.struct(F.lit(None).cast("bigint").alias("doc_id"), F.lit("").alias("text"), F.array().cast("array<int>").alias("sigs")))
    rows = with_next(d, enrich=enrich).unionByName(alone)
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - tail), F.substring("next.text", F.lit(1), tail))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "sigs", F.col("next.sigs").alias("next_sigs"), edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "sigs", "next_sigs", F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("edited"), anchors, chain).alias("edited_sigs"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").cast("bigint").alias("n_signatures"),
    )


def similar_pairs(docs: DataFrame, threshold: float = 0.8, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """(a, b, similarity) between classes of equal fingerprints, each named by its smallest doc_id.

    Sets are partitioned by size class: similar sizes lie in the same or in
    neighbouring classes.  In a partition, two sets meet if they share one of
    the first signatures, so many that a similar set cannot miss them all, and
    their exact similarity is computed from the whole sets.
    """
    d = pick(docs, doc_id="bigint", text="string")
    s = d.select("doc_id", signatures(F.col("text"), anchors, chain).alias("sigs")).where("size(sigs) > 0 and doc_id is not null")
    s = checkpoint(s.groupBy("sigs").agg(F.min("doc_id").alias("id")))
    n = F.size("sigs")
    cls = F.floor(F.log(n) / F.lit(-1.0) / F.log(F.lit(threshold))).cast("int")
    first = n - F.ceil(n * F.lit(threshold) - 1e-9).cast("int") + 1
    keys = s.select("id", n.alias("n"), cls.alias("cls"), F.explode(F.slice("sigs", F.lit(1), first)).alias("sig"))
    other = keys.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)).alias("cls"), "sig")
    near = (F.col("n") >= F.col("nb") * threshold - 1e-9) & (F.col("nb") >= F.col("n") * threshold - 1e-9) & (F.col("id") < F.col("b"))
    pairs = keys.join(other, ["sig", "cls"]).where(near).select(F.col("id").alias("a"), "b").distinct()
    left, right = s.select(F.col("id").alias("a"), F.col("sigs").alias("sa")), s.select(F.col("id").alias("b"), F.col("sigs").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)
