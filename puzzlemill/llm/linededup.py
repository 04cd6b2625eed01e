"""Line de-duplication by an exact set-similarity join.

A line's tokens are its distinct words in lower case.  A line is removed if an
earlier line, by doc_id and line number, has a set with 100 * common >=
percent * all; whether that one is removed too does not matter.  Blank lines
stay.

* Lines with equal sets are one class, whose first line stays in question.
* Tokens are ordered by rarity: by the counts of all words of all texts, kept in
  buckets of a fixed number and on a scale of quarter powers of two, then by
  hash.  Any fixed order is exact; this one makes the prefixes rare.
* Two similar sets share a token among the first of both (prefix filter; the
  smaller set's prefix is the shorter one, since the larger one asks for more in
  common), their sizes differ little (length filter), what can still follow the
  shared token must suffice (positional filter), and the parities of their tokens'
  hashes cannot differ in more bits than the sets differ in tokens (bitmap filter).
  Tokens that follow the same token in both prefixes are skipped: there the two have
  met before.
* A class first meets, of the first and the last few before it with the same pair
  of tokens at the end of the prefix, the one whose bitmap is nearest, for each of
  two pairs.  Whoever matches is decided and asks no more, so groups of many like
  lines do not meet pair by pair; the others meet all that the filters leave.
  Similarity is verified on whole sets.

Defined results: null texts are empty and stay so; a text of any length is cut
in lines and handled whole; of equal lines the first by (doc_id, number, hash of
the text) stays; of equal rows one stays; rows with a null doc_id come last, by
hash; empty tables give empty results; columns other than doc_id and text are
ignored, or kept as they are by ``drop_repeated_lines``, whatever their names.
"""

from __future__ import annotations

import math
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ID_BYTES, MOST_BYTES, SPACE, let, number_equal, small, written

#: For tables that hold hashes mostly.
hashes_written = partial(written, plain=True)
#: Words are counted in so many buckets.
BUCKETS = 1 << 18
#: So many of them are counted in one row; like ``buckets`` a power of two.
BESIDE = 8
#: Hash bits that a bitmap's second word is used beyond.
LONG_LINE = 80
#: So many pairs of neighbours at the end of a prefix lead to earlier classes.
HUBS = 2
#: Besides the first of these, so many of the last ones are looked at for the nearest.
LOOK = 4
#: White space within lines besides the space.
OTHER_SPACE = "\t\x0b\x0c\r"


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc, key, text): ``doc`` orders documents, ``key`` tells those of equal ids apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    late = F.lit(1 << 62) + F.shiftrightunsigned(key, 2)
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), late).alias("doc"), key.bitwiseAND(F.lit(0xFFFFFFFF)).alias("key"), text.alias("text"), *more)


def _spaced(text: str) -> Column:
    """A text with spaces for all its white space but line ends; most hold no other, which four searches tell."""
    text = F.col(text)
    other = reduce(or_, [text.contains(x) for x in OTHER_SPACE])
    return F.when(other, F.translate(text, OTHER_SPACE, " " * len(OTHER_SPACE))).otherwise(text)


def _lines(texts: DataFrame) -> DataFrame:
    """(doc, lo, line): ``lo`` holds the line's number and the text's key; white space within lines is spaces."""
    d = texts.select("doc", "key", F.posexplode(F.split(_spaced("text"), "\n", -1)).alias("no", "line"))
    return d.where("line != ''").select("doc", F.shiftleft(F.col("no").cast("bigint"), 32).bitwiseOR(F.col("key")).alias("lo"), "line")


def word_hashes(line: Column) -> Column:
    """The hashes of the words of a line whose white space is spaces."""
    return F.transform(F.array_remove(F.split(F.lower(line), " "), ""), lambda w: F.xxhash64(w))


def word_set(line: Column) -> Column:
    """The hashes of the distinct words of a line whose white space is spaces."""
    return F.array_distinct(word_hashes(line))


def rarity(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with one array of bytes: for each bucket of words the magnitude of its count over all texts."""
    spaced = F.replace(_spaced("text"), F.lit("\n"), F.lit(" "))  # words end where lines do
    word = texts.select(F.explode(F.split(F.lower(spaced), " ")).alias("word")).select(F.xxhash64("word").alias("h"))
    # a row counts several buckets, so that the rows are few enough for the compiled map of an aggregation
    rows = buckets // BESIDE
    part = F.shiftrightunsigned("h", rows.bit_length() - 1).bitwiseAND(F.lit(BESIDE - 1))
    counts = word.groupBy(F.col("h").bitwiseAND(F.lit(rows - 1)).alias("row")).agg(*[F.sum(F.when(part == i, 1).otherwise(0)).alias(f"c{i}") for i in range(BESIDE)])
    size = lambda c: F.when(F.col(c) > 0, F.least(F.floor(F.log2(c) * 4), F.lit(127))).otherwise(0).cast("byte")
    parts = [f"c{i}" for i in range(BESIDE)]
    none = texts.sparkSession.range(rows).select(F.col("id").alias("row"), *[F.lit(0).cast("byte").alias(c) for c in parts])
    every = counts.select("row", *[size(c).alias(c) for c in parts]).unionByName(none)
    every = every.groupBy("row").agg(*[F.max(c).alias(c) for c in parts])
    # ``buckets`` numbers, whatever the input
    every = every.agg(F.sort_array(F.collect_list(F.struct("row", *parts))).alias("rows"))
    return every.select(F.flatten(F.array(*[F.col(f"rows.{c}") for c in parts])).alias("sizes"))


def tokens_of(hashes: Column, rare: Column, buckets: int = BUCKETS) -> Column:
    """The distinct words with these hashes, rarest first: the magnitude in the first byte, then the hash."""

    def token(h: Column) -> Column:
        size = F.coalesce(F.get(rare, h.bitwiseAND(F.lit(buckets - 1))), F.lit(0).cast("byte"))
        return F.shiftleft(size.cast("bigint"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    return F.sort_array(F.array_distinct(F.transform(hashes, token)))


def _parities(tokens: Column, half: bool = False) -> Column:
    """A bit for each of 64 classes of hashes: whether the set holds an odd number of them.

    With ``half`` only for hashes whose seventh bit is set, so that both give 128 classes.
    """
    one = lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(1).cast("bigint")) if half else F.lit(1).cast("bigint")
    bit = lambda t: F.call_function("shiftleft", one(t), t.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("bigint"), lambda s, t: s.bitwiseXOR(bit(t)))


def _reaches(common: Column, na: Column, nb: Column, percent: int) -> Column:
    """100 * common >= percent * (na + nb - common)."""
    return common * (100 + percent) >= (na + nb) * percent


def _later(a: str, b: str) -> Column:
    """Whether line ``a`` comes after line ``b``."""
    return (F.col(f"{a}doc") > F.col(f"{b}doc")) | ((F.col(f"{a}doc") == F.col(f"{b}doc")) & (F.col(f"{a}lo") > F.col(f"{b}lo")))


def repeated_lines(docs: DataFrame, percent: int = 80, buckets: int = BUCKETS, hubs: int = HUBS) -> DataFrame:
    """(doc, key, nos): for each text the numbers of the lines to remove.  Takes (doc_id, text)."""
    texts = _texts(docs)
    rare = written(rarity(texts, buckets))
    # the array is a scalar that plans name and do not hold; the optimizer sets it into the tokens' expression, if that
    # names it once (else each row would hold it)
    hashed = _lines(texts).select("doc", "lo", F.explode(F.array(word_hashes(F.col("line")))).alias("hashes")).where(F.size("hashes") > 0)
    spelled = hashed.withColumn("rare", rare.rows.select("sizes").scalar())
    # few edits change the least and the largest hash, whatever words they bring
    ends = F.xxhash64(F.array_min("hashes"), F.array_max("hashes")).alias("ends")
    sets = spelled.select("doc", "lo", ends, tokens_of(F.col("hashes"), F.col("rare"), buckets).alias("tokens")).select("doc", "lo", "ends", F.explode(F.array("tokens")).alias("tokens"))
    n = F.size("tokens")
    first = F.slice("tokens", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1)
    wide = F.when(n > LONG_LINE, _parities(F.col("tokens"), half=True)).otherwise(F.lit(0).cast("bigint"))
    lines = sets.select("doc", "lo", F.xxhash64("tokens").alias("sid"), n.alias("n"), first.alias("prefix"), _parities(F.col("tokens")).alias("odd"), wide.alias("odd2"), "ends")
    # the whole prefix tells classes apart besides the hash
    equal = W.partitionBy("sid", "n", "odd", "odd2", "prefix").orderBy("doc", "lo")
    # lines of equal rows share a place and a rank; one of them stands for all
    ranked = lines.repartition("sid").withColumn("again", F.rank().over(equal) > 1).withColumn("nth", F.row_number().over(equal)).where("again or nth = 1")
    last = F.size("prefix")
    tail = F.xxhash64(F.get("prefix", last - 1), F.get("prefix", last - 2)).alias("tail")
    lines = hashes_written(ranked.select("doc", "lo", "n", "odd", "odd2", "ends", tail, F.when(~F.col("again"), F.col("prefix")).alias("prefix"), "again"))
    # sets of one to three words are like equal ones alone (at 75 % and above)
    least = 100 // (100 - percent) - 1 if percent < 100 else 1 << 30
    asked = lines.rows.where(~F.col("again") & (F.col("n") >= least)).drop("again")

    def rows_of(sets: DataFrame, tokens: Column, *more: str) -> DataFrame:
        rows = sets.select("doc", "lo", "n", "odd", "odd2", *more, F.posexplode(tokens).alias("i", "token"))
        return rows.select("token", "doc", "lo", F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.col("i")).alias("ni"), "odd", "odd2", *more)

    size = lambda x: F.shiftright(F.col(f"{x}ni"), 32).cast("int")
    place = lambda x: F.col(f"{x}ni").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

    def excess(a: str, b: str) -> Column:
        """By how much the bitmaps differ beyond what like sets may: above 0 they are not alike."""
        na, nb = size(a), size(b)
        # the sets may differ in as many tokens as (na + nb) * (100 - percent) / (100 + percent)
        odd, odd2 = (F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")) for c in ("odd", "odd2"))
        bits = F.when((na > LONG_LINE) & (nb > LONG_LINE), F.bit_count(odd.bitwiseXOR(odd2)) + F.bit_count(odd2)).otherwise(F.bit_count(odd))
        return bits * (100 + percent) - (na + nb) * (100 - percent)

    def alike(a: str, b: str) -> Column:
        na, nb = size(a), size(b)
        return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (excess(a, b) <= 0)

    def viable(a: str, b: str) -> Column:
        na, nb = size(a), size(b)
        return alike(a, b) & _reaches(F.least(na - place(a), nb - place(b)), na, nb, percent)

    def sets_of(ids: DataFrame) -> DataFrame:
        """The whole sets of lines (doc, lo), made again from their texts."""
        spots = ids.select("doc", F.col("lo").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key"), F.shiftright("lo", 32).alias("no"))
        spots = spots.groupBy("doc", "key").agg(F.collect_set("no").alias("nos"))  # lines of one text
        there = texts.join(F.broadcast(spots) if small(ids) else spots, ["doc", "key"])
        there = there.select("doc", "key", "nos", F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).where(F.array_contains("nos", F.col("no").cast("bigint")))
        lo = F.shiftleft(F.col("no").cast("bigint"), 32).bitwiseOR(F.col("key"))
        return there.select("doc", lo.alias("lo"), word_set(_spaced("line")).alias("tokens"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The lines (doc, lo) of pairs that reach the similarity."""
        found = written(pairs)
        many = found.rows.count()
        files = lambda rows, each: math.ceil(rows / each) or 1  # noqa: E731  (no more than the rows, whose number is known, need)
        ids = found.rows.select("doc", "lo").unionByName(found.rows.select(F.col("b_doc").alias("doc"), F.col("b_lo").alias("lo"))).distinct()
        # equal rows bring a set again
        whole = written(sets_of(ids).dropDuplicates(["doc", "lo"]).coalesce(files(2 * many, 20_000)))
        other = whole.rows.select(F.col("doc").alias("b_doc"), F.col("lo").alias("b_lo"), F.col("tokens").alias("b_tokens"))
        both = found.rows.join(whole.rows, ["doc", "lo"]).join(other, ["b_doc", "b_lo"])
        common = F.size(F.array_intersect("tokens", "b_tokens"))
        good = both.where(_reaches(common, F.size("tokens"), F.size("b_tokens"), percent)).select("doc", "lo").distinct()
        out = written(good.coalesce(files(many, 200_000)))
        whole.drop()
        found.drop()
        return out.rows

    # a class and the first and the last before it with the same two tokens at the end of the prefix
    near = lambda ids: F.broadcast(ids) if small(ids) else ids
    decided = asked.select("doc", "lo").limit(0)
    if hubs:
        some = rows_of(asked, F.array(*["ends", "tail"][:hubs]))
        one = F.struct("doc", "lo", "ni", "odd", "odd2")
        order = W.partitionBy("token").orderBy("doc", "lo")
        star = some.select("*", F.first(one).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("h0"), *[F.lag(one, k).over(order).alias(f"h{k}") for k in range(1, LOOK + 1)]).where("h1 is not null")
        fit = lambda h: F.when(_later("", h) & alike("", h), F.struct(excess("", h).alias("excess"), F.col(f"{h}doc").alias("doc"), F.col(f"{h}lo").alias("lo")))
        star = star.select("doc", "lo", F.least(*[fit(f"h{k}.") for k in range(LOOK + 1)]).alias("b")).where("b is not null")
        decided = verified(star.select("doc", "lo", F.col("b.doc").alias("b_doc"), F.col("b.lo").alias("b_lo")).distinct())
    # every pair of a set and one that is not larger, of whose prefix the positional filter leaves less; both sides have
    # the same rows, so that one exchange serves both
    known = asked.join(near(decided.withColumn("known", F.lit(1))), ["doc", "lo"], "left").fillna(0, "known")
    spread = known.select("doc", "lo", "n", "odd", "odd2", "known", "prefix", F.posexplode("prefix").alias("i", "token"))
    before = F.coalesce(F.get("prefix", F.col("i") - 1), F.lit(0).cast("bigint"))
    ni = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.col("i"))
    all_rows = spread.select("token", "doc", "lo", ni.alias("ni"), "odd", "odd2", "known", before.alias("before"))
    left, right = (all_rows.select("token", *[F.col(c).alias(f"{x}_{c}") for c in all_rows.columns[1:]]) for x in "ab")
    after = _later("a_", "b_")
    rest = left.join(right, "token").where((size("a_") > size("b_")) | ((size("a_") == size("b_")) & after))
    # those that also share the token before have met there; the first has 0 before it
    rest = rest.where((F.col("a_before") != F.col("b_before")) | (F.col("a_before") == 0))
    rest = rest.where(viable("a_", "b_")).where(F.when(after, F.col("a_known")).otherwise(F.col("b_known")) == 0)
    turn = lambda a, b, to: [F.when(after, F.col(f"{a}_{c}")).otherwise(F.col(f"{b}_{c}")).alias(f"{to}{c}") for c in ("doc", "lo")]
    gone = decided.unionByName(verified(rest.select(*turn("a", "b", ""), *turn("b", "a", "b_")).distinct()))
    out = lines.rows.where("again").select("doc", "lo").unionByName(gone)
    out = out.select("doc", F.col("lo").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key"), F.shiftright("lo", 32).cast("int").alias("no"))
    out = written(out.groupBy("doc", "key").agg(F.collect_set("no").alias("nos")))  # lines of one text
    for table in (rare, lines):
        table.drop()
    return out.rows


def drop_repeated_lines(docs: DataFrame, percent: int = 80, buckets: int = BUCKETS, hubs: int = HUBS) -> DataFrame:
    """``docs`` with the text that remains, and (n_lines, n_removed), which replace columns of these names.

    Its other columns stay as they are.  Of equal rows (doc_id and text) all but
    one lose all their lines but blank ones.
    """
    gone = repeated_lines(docs.select("doc_id", "text"), percent, buckets, hubs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = number_equal(_texts(docs, row), "doc", "key")
    numbers = gone.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.size("nos")), F.lit(0)).alias("lines")).first()
    fits = numbers.texts * ID_BYTES + numbers.lines * 4 <= MOST_BYTES
    out = own.join(F.broadcast(gone) if fits else gone, ["doc", "key"], "left")
    blank = lambda x: F.length(F.btrim(x, F.lit(SPACE))) == 0
    stays = lambda x, i: F.when(F.col("copy") > 1, blank(x)).otherwise(~F.array_contains("nos", i))
    lines = F.split("text", "\n", -1)
    kept = let(lines, lambda x: F.filter(x, stays))
    changed = F.col("nos").isNotNull() | (F.col("copy") > 1)
    text = F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("row.text").cast("string"))
    removed = F.when(changed, F.size(lines) - F.size(kept)).otherwise(0)
    # first beside the row, since its names may be those used here
    out = out.select("row", text.alias("left"), F.size(lines).cast("bigint").alias("n_lines"), removed.cast("bigint").alias("n_removed"))
    others = [F.col(f"row.`{c}`").alias(c) if c != "text" else F.col("left").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(F.struct(*others, "n_lines", "n_removed").alias("row")).select("row.*")
