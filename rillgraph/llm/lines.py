"""Line deduplication within an edit bound (operator 3), DataFrame functions alone.

Lines are sequences of words (lower case, split at white space). A line goes
when an earlier line, by (id, line number), is equal or within one edit: one
word replaced, added or left out. Lines of fewer than ``min_words`` words go for equal
lines only, as one edit would change much of them.

Deletion neighbourhood: a line's variants are the line without its i-th word,
as hashed keys made from hashes of what stands before and after. Two lines of equal length are
within one replacement when they share a variant of the same i; a line and a
longer one are within one insertion when a variant of the longer equals the
shorter. Equal keys are reduced to their earliest line, so the pairs of a group are never listed; each
line is then verified against that earliest line by its words.

Before variants are made, halves sort out what can have no partner: one edit
leaves the first or the last half of the line as it was, so a line whose half
occurs nowhere else needs no variants in the other half. This keeps the result whole and the shuffles small.

Defined results. A null text has no lines, an empty text one empty line. Lines without words are never removed.
A null id comes last, as the largest. Rows that repeat an id come in the order of a hash of
their texts; rows that repeat id and text are one document. Ids are integers, or what casts to them. Other columns are not
looked at.

Scale: equal lines (by 128 bits) are reduced first; what is shuffled is hashes, and words only of lines
with a candidate. Work is in proportion to a line's words, however long it is. Hot keys meet partial aggregates and joins that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, join_keys, written

MIN_WORDS = 8
#: Words whose running hashes are built in one array.
STRETCH = 256
_LAST = (1 << 63) - 1


def _plain(text: Column) -> Column:
    """Lower case, and one space for white space inside lines (the ASCII six without the line feed)."""
    return F.regexp_replace(F.lower(text), r"[ \t\x0B\f\r]+", " ")


def _running(words: Column) -> Column:
    """Hashes of the first 0, 1, 2, ... words: of the whole stretches before, and of the words since.

    An array grows by copies, so no array is built step by step beyond a stretch of words or a list of stretches.
    """
    start = F.array(F.lit(0).cast("long"))
    grow = lambda items: F.aggregate(items, start, lambda acc, w: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), w))))
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  evaluated once, however often it is used
    stretches = lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.size(w) / STRETCH).cast("int")), lambda k: grow(F.slice(w, k * STRETCH + 1, F.lit(STRETCH))))
    before = lambda parts: grow(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda part: F.element_at(part, -1)))
    # a stretch begins with the hash of none of its words, which ends the one before
    joined = lambda parts, sums: F.flatten(F.zip_with(parts, sums, lambda part, s: F.transform(F.slice(part, F.lit(1), F.lit(STRETCH)), lambda h: F.xxhash64(s, h))))
    return once(words, lambda w: once(stretches(w), lambda parts: once(before(parts), lambda sums: joined(parts, sums))))


def _without(words: Column, m: Column, i: Column, whole: Column) -> Column:
    """The words without the i-th; all of them where the line is the shorter one."""
    return F.concat(F.slice(words, F.lit(1), i - 1), F.slice(words, F.when(m == whole, i + 1).otherwise(i), F.greatest(m, F.lit(1))))


def dedup_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_lines, n_exact, n_near, text (the lines that stay)."""
    own = F.col(id_col).cast("long")
    docs = docs.select(own.alias("own"), F.coalesce(own, F.lit(_LAST)).alias("id"), F.col(text_col).cast("string").alias("text"))
    # texts tell apart only rows that share an id
    several = written(docs.groupBy("id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("id").alias("s")))
    n_several = several.limit(BROADCAST_IDS + 1).count()
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    if n_several == 0:
        docs = docs.withColumn("h", F.lit(0).cast("long"))
    elif n_several <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(several), F.col("id") == F.col("s"), "left").withColumn("h", F.when(F.col("s").isNotNull(), h).otherwise(0).cast("long")).drop("s")
    else:
        docs = docs.withColumn("h", h)
    exploded = docs.select("id", "h", F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("no", "line"))
    line = exploded.select("id", "h", "no", F.trim("line").alias("line")).where("line <> ''")
    place = F.struct("id", "h", "no")
    sized = line.withColumn("m", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    near = F.col("m") >= min_words - 1
    half, upper = F.floor(F.col("m") / 2).cast("int"), F.floor((F.col("m") + 1) / 2).cast("int")

    def part(side: str, whole: Column, words: Column) -> Column:
        return F.when(near, F.xxhash64(F.lit(side), whole, F.call_function("substring_index", F.col("line"), F.lit(" "), words)))

    # For a pair whose longer line has `whole` words: what stands before its middle, or after.
    keyed = written(
        sized.select(
            "id", "h", "no", F.unhex(F.md5(F.col("line").cast("binary"))).alias("key"),
            part("a", F.col("m"), half).alias("h0"), part("z", F.col("m"), half - F.col("m")).alias("h1"),
            part("a", F.col("m") + 1, upper).alias("h2"), part("z", F.col("m") + 1, upper - F.col("m") - 1).alias("h3"),
        )
    )

    # Equal lines: the earliest stands for all.
    equal = written(keyed.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("h0", "h1", "h2", "h3")]))
    # What follows knows a line by 64 bits; near lines are held against each other by their words.
    halves = equal.where(F.col("h0").isNotNull()).select(F.xxhash64("key").alias("key"), F.posexplode(F.array("h0", "h1", "h2", "h3")).alias("kind", "half"))
    shared = halves.groupBy("half").agg(F.min("key").alias("k1"), F.max("key").alias("k2")).where("k1 <> k2").select(F.col("half").alias("s"))
    kinds = halves.join(shared, F.col("half") == F.col("s"), "left_semi").groupBy(F.col("key").alias("k")).agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("kinds"))
    maybe = kinds.join(equal.select(F.xxhash64("key").alias("key"), "first"), F.col("key") == F.col("k"))
    wanted = written(maybe.groupBy(F.col("first.id").alias("i"), F.col("first.h").alias("g")).agg(F.collect_list(F.struct(F.col("first.no").alias("no"), "k", "kinds")).alias("wanted")))

    # Words of the lines that may have a partner, and their variants where the edit can be.
    small = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    here = docs.join(F.broadcast(wanted) if small else wanted, (F.col("id") == F.col("i")) & (F.col("h") == F.col("g")))
    if n_several:  # rows that repeat id and text
        here = here.dropDuplicates(["id", "h"])
    here = here.select("id", "h", F.split("text", "\n").alias("lines"), F.explode("wanted").alias("x"))
    words = F.split(F.trim(_plain(F.element_at("lines", F.col("x.no") + 1))), " ")
    picked = written(here.select(F.col("x.k").alias("key"), F.col("x.kinds").alias("kinds"), F.struct("id", "h", "x.no").alias("place"), words.alias("words")))
    run = picked.select("key", "kinds", "place", F.size("words").alias("m"), _running(F.col("words")).alias("fore"), F.reverse(_running(F.reverse("words"))).alias("aft"))
    m = F.col("m")
    half, upper = F.floor(m / 2).cast("int"), F.floor((m + 1) / 2).cast("int")

    def variants_of(kind: int, whole: Column, begin: Column, end: Column, skip: int) -> Column:
        """Of places begin to end; with ``skip`` 1 the word there is left out, with 0 it is the longer line's."""
        made = F.transform(F.sequence(begin, end), lambda i: F.struct(whole.alias("whole"), i.alias("i"), F.xxhash64(F.element_at("fore", i), F.element_at("aft", i + skip)).alias("v")))
        return F.when(F.col("kinds").bitwiseAND(1 << kind) > 0, made).otherwise(F.array().cast("array<struct<whole:int,i:int,v:bigint>>"))

    one = F.lit(1)
    left_out = [variants_of(0, m, half + 1, m, 1), variants_of(1, m, one, half, 1)]
    gaps = [variants_of(2, m + 1, upper + 1, m + 1, 0), variants_of(3, m + 1, one, upper, 0)]
    # An edit of a line of min_words - 1 only counts if the longer line has min_words.
    every = F.when(m >= min_words, F.concat(*left_out, *gaps)).otherwise(F.concat(*gaps))
    variants = written(run.select("key", "place", F.explode(every).alias("x")).select("key", "place", "x.*"))
    group = ["whole", "i", "v"]
    earliest = variants.groupBy(*group).agg(F.min(F.struct("place", "key")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(c).alias(c + "2") for c in group], "lead")
    met = variants.join(earliest, (F.col("v") == F.col("v2")) & (F.col("i") == F.col("i2")) & (F.col("whole") == F.col("whole2"))).where(F.col("lead.place") < F.col("place"))
    found = met.groupBy("key").agg(F.min(F.struct(F.col("lead.place").alias("place"), F.col("lead.key").alias("lead"), "whole", "i")).alias("x")).select("key", "x.lead", "x.whole", "x.i")
    ours, theirs = picked.select(F.col("key").alias("k1"), F.col("words").alias("w1"), "place"), picked.select(F.col("key").alias("k2"), F.col("words").alias("w2"))
    verified = (
        found.join(ours, F.col("key") == F.col("k1"))
        .join(theirs, F.col("lead") == F.col("k2"))
        .where(_without(F.col("w1"), F.size("w1"), F.col("i"), F.col("whole")) == _without(F.col("w2"), F.size("w2"), F.col("i"), F.col("whole")))
        .select("place.*", F.lit(True).alias("near"))
    )
    first = equal.where("n > 1").select(F.col("key").alias("k"), "first", "n")
    copies = join_keys(keyed.select("id", "h", "no", "key"), first, F.col("key") == F.col("k"), "k", "n").where(place != F.col("first")).select("id", "h", "no", F.lit(False).alias("near"))
    gone = verified.union(copies).groupBy(F.col("id").alias("i"), F.col("h").alias("g")).agg(F.collect_set(F.struct("no", "near")).alias("gone"))
    lines = F.split("text", "\n")
    joined = docs.join(gone, (F.col("id") == F.col("i")) & (F.col("h") == F.col("g")), "left").withColumn("numbers", F.coalesce(F.col("gone.no"), F.array().cast("array<int>")))
    stays = F.filter(lines, lambda x, no: ~F.array_contains("numbers", no))
    count = lambda c: F.coalesce(F.size(F.filter("gone", c)), F.lit(0)).cast("long")
    return joined.select(
        F.col("own").alias(id_col),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(count(lambda x: ~x["near"])).cast("long").alias("n_exact"),
        F.when(F.col("gone").isNull(), 0).otherwise(count(lambda x: x["near"])).cast("long").alias("n_near"),
        F.array_join(stays, "\n").alias("text"),
    )
