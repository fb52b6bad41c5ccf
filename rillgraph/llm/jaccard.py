"""N-gram Jaccard join and its groups (operator 10).

A document's set is its distinct word 4-grams as 64-bit hashes. Two sets link
when 100 * |A & B| >= percent * |A | B|. The result is exact: every link counts,
and a document's component is the smallest id reachable over links.

Set relations spare most of the work. (1) Equal sets are one class from the
start. (2) Answers within a family: sets that share a min-hash form a family
with a reference set R, what most of a few members hold. Each member is kept as its
difference from R, and answers follow from differences alone: |A ^ B| = |A'| + |B'| -
2 |A' & B'|. With w = (100 + percent) |A'| - (100 - percent) |A|, a pair links for
certain when w(A) + w(B) <= 0, and then both link to the member of least w: a star
stands for all such pairs. Every other linked pair shares at least
(w(A) + w(B)) / (2 (100 + percent)) elements of its differences and meets in an index
over their rarest elements. (3) Links between families come from an inverted index
over prefixes: the n - ceil(percent * n) + 1 first elements of a set in a global
order that puts frequent elements last. Lists of one family alone are skipped
whole. Longer lists are kept in blocks by size and by position: a set of n elements that has the
list's element at position p can link with no set of over (n - p) (100 + percent) / percent - n elements,
so a block holds entries of one band of sizes whose positions let them reach the same bands, and an
entry asks only for the blocks that it can reach and that can reach it. What meets is held against the exact
bound, bucket counts rule out most of what remains, and the rest is verified on the whole texts.

Defined results. Null or empty texts, and texts of white space, have an empty set, link with
nothing and are their own component. Fewer than four words make one element.
Rows that repeat an id are one node. A null id links with nothing and has a
null component. Ids are integers, or what casts to them. Other columns are not looked at.

Scale: no pairs inside a class or of near copies of one text are listed; heavy elements stay
out of prefixes at any size of the table, so lists are short unless a set has hardly anything else;
blocks of over BLOCK entries are dealt in parts of that size. Links settle in rounds whose number grows with the logarithm of the
longest chain; after 60 of them the operator raises an error rather than return unsettled groups.
Large families are dealt in slots. Broadcast: the heavy elements up to MAX_HEAVY of them (a shuffle beyond), and tables up to a checked count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_IDS, arrow_map, binaries, by_ids, space_words, text_key, written
from .components import components

#: An element in more prefixes than HEAVY goes last; up to MAX_HEAVY such elements are broadcast.
HEAVY, MAX_HEAVY = 64, 400_000
#: Lists of more entries are kept in blocks; bands that sizes of linked sets span; entries of a block dealt together.
SHORT, BANDS, BLOCK = 16, 2, 1024
#: Min-hashes by which similar sets meet; members that a reference is made from; members dealt together.
MEETINGS, SAMPLE, SLOT = 4, 32, 512
#: Members that have less than this percentage of Jaccard with the reference leave their family.
KIN = 30
#: Buckets whose counts bound two sets' difference from below.
BUCKETS = 256
_P = np.uint64(0x9E3779B97F4A7C15)


#: Words whose hashes a task remembers: some 25 MB.
WORDS = 150_000


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit moves every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Distinct hashes of the text's word n-grams, ascending."""
    words = space_words(text.lower() if text else None)
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(w) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    h = w[: len(w) - size + 1].copy()
    for k in range(1, size):
        h = h * _P + w[k : len(w) - size + 1 + k]
    return np.unique(mixed(h))


def prefix_size(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def reach_of(n: int, percent: int) -> int:
    """Elements kept of a set: its prefix and half as many to stand in for heavy ones."""
    p = prefix_size(n, percent)
    return min(n, p + max(16, p // 2))


def among(s: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which of s are in the sorted array ``listed``."""
    if not len(listed):
        return np.zeros(len(s), bool)
    return listed[np.minimum(np.searchsorted(listed, s), len(listed) - 1)] == s


def _sketch(size: int, percent: int):
    salts = [np.uint64(xxhash.xxh3_64_intdigest(b"%d" % k)) for k in range(MEETINGS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, keys, heads, meet, hist = [], [], [], [], []
            for text in binaries(batch, "text"):
                s = shingle_set(text, size, hashes)
                n.append(len(s))
                if not len(s):
                    for column in (keys, heads, meet, hist):
                        column.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                heads.append(s[: reach_of(len(s), percent)].view(np.int64))
                meet.append(np.array([mixed(s ^ salt).min() for salt in salts]).view(np.int64))
                hist.append(np.minimum(np.bincount((s & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes())
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(heads, longs), pa.array(meet, longs), pa.array(hist, pa.binary())], names=["id", "n", "key", "head", "meet", "hist"])

    return run


def _prefixes(heavy, percent: int):
    """Prefix elements with positions in the order (heavy last, then hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, deep = [], []
            for n, head in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = head.values.to_numpy()
                last = among(s, heavy.value)
                p = prefix_size(n, percent)
                ordered = np.concatenate([s[~last], s[last]])
                whole = len(s) == n or int((~last).sum()) >= p
                deep.append(not whole)
                tokens.append(ordered[:p] if whole else ordered[:0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.list_(pa.int64())), pa.array(deep, pa.bool_())], names=["id", "n", "tokens", "deep"])

    return run


def _ordered(heads: DataFrame, heavy: DataFrame, percent: int) -> DataFrame:
    """``_prefixes`` of (id, n, head) as a shuffle, for more heavy elements than are broadcast."""
    least = -(1 << 63)  # signed numbers sort like the unsigned ones after this flip
    rows = heads.select("id", "n", F.xxhash64("head").alias("h"), F.explode("head").alias("t")).join(heavy.select(F.col("t").alias("t2")), F.col("t") == F.col("t2"), "left")
    rows = rows.groupBy("id", "n", "h").agg(F.sort_array(F.collect_set(F.struct(F.col("t2").isNotNull().alias("last"), F.col("t").bitwiseXOR(F.lit(least)).alias("u")))).alias("s"))
    p = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    whole = (F.size("s") == F.col("n")) | (F.size(F.filter("s", lambda x: ~x["last"])) >= p)
    tokens = F.transform(F.slice("s", F.lit(1), F.when(whole, p).otherwise(0)), lambda x: x["u"].bitwiseXOR(F.lit(least)))
    return rows.select("id", "n", tokens.alias("tokens"), (~whole).alias("deep"))


def _whole_heads(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, size, hashes).view(np.int64) for t in binaries(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "n", "head"])

    return run


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for a, b in zip(binaries(batch, "text_a"), binaries(batch, "text_b"), strict=True):
                if last[0] != a:
                    last = (a, shingle_set(a, size, hashes))
                s, t = last[1], shingle_set(b, size, hashes)
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(bool(common) and 100 * common >= percent * (len(s) + len(t) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _references(size: int):
    """Rows come by family; what more than half of a family's rows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        family, sets = None, []

        def made() -> pa.RecordBatch:
            kept, n = np.unique(np.concatenate(sets), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([family], pa.int64()), pa.array([kept[2 * n > len(sets)].view(np.int64)], pa.list_(pa.int64()))], names=["f", "ref"])

        for batch in batches:
            for f, text in zip(batch.column(0).to_pylist(), binaries(batch, "text"), strict=True):
                if f != family:
                    if sets:
                        yield made()
                    family, sets = f, []
                sets.append(shingle_set(text, size, hashes))
        if sets:
            yield made()

    return run


def _differences(size: int):
    """Rows come by family, the reference first; each member's difference from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        ref = np.empty(0, np.uint64)
        longs = pa.list_(pa.int64())
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for f, id_, text, given in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binaries(batch, "text"), batch.column(3), strict=True):
                if given.is_valid:
                    ref = given.values.to_numpy().view(np.uint64)
                    continue
                s = shingle_set(text, size, hashes)
                diff = np.setxor1d(s, ref, assume_unique=True)
                total = len(s) + len(ref)
                kin = 100 * (total - len(diff)) >= KIN * (total + len(diff))
                for column, value in zip(out, (f, id_, len(s), diff.view(np.int64) if kin else None), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], longs)], names=["f", "id", "n", "diff"])

    return run


def _possible(percent: int):
    """Pairs whose bucket counts leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for k in (4, 5))
            least = np.abs(x - y).sum(axis=1)
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            yield batch.filter(pa.array((100 - percent) * total >= (100 + percent) * least)).select(["a", "b"])

    return run


def _attached(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (with a column id) and their texts; up to BROADCAST_IDS rows go to the texts."""
    rows = rows.withColumnRenamed("id", "id_r")
    small = rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(rows) if small else rows, F.col("id") == F.col("id_r")).drop("id_r")


def _linked(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link, by their whole texts."""
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = by_ids(docs, ids, "left_semi", "id")
    side = lambda c: texts.select(F.col("id").alias(f"id_{c}"), F.col("text").alias(f"text_{c}"))
    rows = pairs.join(side("b"), F.col("b") == F.col("id_b")).join(side("a"), F.col("a") == F.col("id_a")).select("a", "b", "text_a", "text_b")
    return arrow_map(rows, _verify(size, percent), "a long, b long")


def _families(docs: DataFrame, first: DataFrame, size: int) -> DataFrame:
    """(f, id, n, diff) for members of families; diff is null for one that isn't kin."""
    met = first.select("id", F.posexplode("meet").alias("k", "h"))
    hubs = met.groupBy("k", "h").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("k").alias("k2"), F.col("h").alias("h2"), "hub")
    mine = written(met.join(hubs, (F.col("k") == F.col("k2")) & (F.col("h") == F.col("h2"))).groupBy("id").agg(F.min("hub").alias("hub")))
    member = mine.join(mine.select(F.col("id").alias("i"), F.col("hub").alias("f")), F.col("hub") == F.col("i")).select("id", "f")
    sizes = member.groupBy("f").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumnRenamed("f", "g")
    member = written(member.join(sizes, F.col("f") == F.col("g")).select("id", "f", F.ceil(F.col("m") / SLOT).cast("int").alias("slots")))
    few = member.withColumn("nth", F.row_number().over(Window.partitionBy("f").orderBy("id"))).where(F.col("nth") <= SAMPLE)
    sample = _attached(docs, written(few.select("id", "f"))).select("f", "id", "text").repartition("f").sortWithinPartitions("f", "id").select("f", "text")
    refs = written(arrow_map(sample, _references(size), "f long, ref array<long>"))
    slots = member.select(F.col("f").alias("g"), "slots").distinct()
    given = refs.join(slots, F.col("f") == F.col("g")).select("f", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"), "ref")
    texts = _attached(docs, member).select("f", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int").alias("slot"), "id", "text", F.lit(None).cast("array<long>").alias("ref"))
    rows = given.union(texts).repartition("f", "slot").sortWithinPartitions("f", "slot", F.col("ref").isNull()).select("f", "id", "text", "ref")
    return written(arrow_map(rows, _differences(size), "f long, id long, n long, diff array<long>"))


def _family_links(kin: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside families: a star over certain ones, the others from the index over differences."""
    plus, less = 100 + percent, 100 - percent
    kin = kin.select("f", "id", "n", F.size("diff").cast("long").alias("d"), "diff").withColumn("w", F.col("d") * plus - F.col("n") * less)
    centre = kin.groupBy("f").agg(F.min(F.struct("w", "id")).alias("c")).select(F.col("f").alias("g"), F.col("c.w").alias("w0"), F.col("c.id").alias("c"))
    kin = written(kin.join(centre, F.col("f") == F.col("g")).drop("g"))
    star = kin.where((F.col("w") + F.col("w0") <= 0) & (F.col("id") != F.col("c"))).select(F.least("c", "id").alias("a"), F.greatest("c", "id").alias("b"))
    out = F.col("w") + F.col("w0") > 0
    share = F.ceil((F.col("w") + F.when(out, F.col("w0")).otherwise(1 - F.col("w0"))) / F.lit(float(2 * plus)))
    rows = kin.select("f", "id", "n", "d", "w", out.alias("out"), F.greatest(share, F.lit(1)).alias("o"), F.explode("diff").alias("t"))
    counts = rows.groupBy("f", "t").agg(F.count(F.lit(1)).alias("m"), F.max("out").alias("any_out")).select(F.col("f").alias("g"), F.col("t").alias("t2"), "m", "any_out")
    ranked = rows.join(counts, (F.col("f") == F.col("g")) & (F.col("t") == F.col("t2"))).withColumn("p", F.row_number().over(Window.partitionBy("id").orderBy("m", "t")) - 1)
    kept = written(ranked.where((F.col("m") > 1) & F.col("any_out") & (F.col("p") <= F.col("d") - F.col("o"))).select("f", "t", "id", "n", "d", "w", "out", "p"))
    other = kept.select(*[F.col(c).alias(c + "2") for c in kept.columns])
    need = F.ceil((F.col("w") + F.col("w2")) / F.lit(float(2 * plus)))
    pairs = (
        kept.where("out")
        .join(other, (F.col("t") == F.col("t2")) & (F.col("f") == F.col("f2")))
        .where((F.col("id") != F.col("id2")) & (~F.col("out2") | (F.col("id") < F.col("id2"))))
        .where((F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent) & (F.least(F.col("d") - F.col("p"), F.col("d2") - F.col("p2")) >= need))
        .select("id", "id2")
        .distinct()
    )
    side = kin.select(F.col("id").alias("i1"), F.col("n").alias("n1"), F.col("diff").alias("x"))
    side2 = kin.select(F.col("id").alias("i2"), F.col("n").alias("n2"), F.col("diff").alias("y"))
    apart = F.size("x") + F.size("y") - 2 * F.size(F.array_intersect("x", "y"))
    checked = pairs.join(side, F.col("id") == F.col("i1")).join(side2, F.col("id2") == F.col("i2")).where((F.col("n1") + F.col("n2")) * less >= apart * plus)
    return star.union(checked.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")))


def _band(n: Column, percent: int) -> Column:
    """Bands of sizes; linked sets are at most BANDS of them apart."""
    return F.floor(F.log(n.cast("double")) * BANDS / (1e-9 - math.log(percent / 100))).cast("int") if percent < 100 else n.cast("int")


def met(kept: DataFrame, percent: int) -> DataFrame:
    """Entries (id, n, f, p, t, with m, their list's length) that meet in a block; the second set is not the larger.

    Block: the element, the band of the second set's size, and how many bands up
    its position lets it reach. Short lists are one block.
    """
    most = lambda: F.floor((F.col("n") - F.col("p")) * (100 + percent) / F.lit(percent)) - F.col("n")
    long, own = F.col("m") > SHORT, _band(F.col("n"), percent)
    top = _band(F.greatest(most(), F.lit(1)), percent)
    parts = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    one = lambda *of: F.struct(*(F.lit(x).cast("int").alias(k) if isinstance(x, int) else x.cast("int").alias(k) for k, x in zip(("band", "up", "part"), of, strict=True)))
    second = kept.where(f"p <= n - ceil({2 * percent} * n / {100 + percent})").select(
        *[F.col(c).alias(c + "2") for c in ("id", "n", "f", "p", "t")],
        F.when(long, one(own, F.greatest(F.lit(0), F.least(top - own, F.lit(BANDS))), F.pmod(F.xxhash64("id"), parts))).otherwise(one(-1, 0, 0)).alias("block"),
    )
    # bands below that the sizes allow, no higher than the own position allows; of each, the blocks that reach up to here
    asked = [(down, up) for down in range(BANDS + 1) for up in range(down, BANDS + 1)]
    blocks = F.filter(F.array(*(F.when(own - down <= top, F.struct((own - down).alias("band"), F.lit(up).alias("up"))) for down, up in asked)), lambda x: x.isNotNull())
    blocks = F.flatten(F.transform(blocks, lambda x: F.transform(F.sequence(F.lit(0), parts - 1), lambda part: one(x["band"], x["up"], part))))
    first = kept.withColumn("ask", F.explode(F.when(long, blocks).otherwise(F.array(one(-1, 0, 0)))))
    same = (F.col("t") == F.col("t2")) & (F.col("ask.band") == F.col("block.band")) & (F.col("ask.up") == F.col("block.up")) & (F.col("ask.part") == F.col("block.part"))
    return first.join(second, same)


def reachable(percent: int) -> Column:
    """Whether two entries' sets, of different families and the second not the larger, can still overlap enough."""
    need = F.ceil((F.col("n") + F.col("n2")) * F.lit(percent) / F.lit(100 + percent))
    ordered = (F.col("f") != F.col("f2")) & ((F.col("n") > F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("id") != F.col("id2"))))
    return ordered & (F.col("n2") * 100 >= F.col("n") * percent) & (F.least(F.col("n") - F.col("p"), F.col("n2") - F.col("p2")) >= need)


def jaccard_groups(docs: DataFrame, *, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = written(arrow_map(docs, _sketch(size, percent), "id long, n long, key binary, head array<long>, meet array<long>, hist binary"))
    own = sketch.where("key IS NOT NULL AND id IS NOT NULL")

    # Equal sets: the smallest id stands for its class.
    classes = own.groupBy(F.col("key").alias("k")).agg(F.min("id").alias("rep"))
    same = F.col("key") == F.col("k")
    gone = own.join(classes, same).where("id <> rep").select(F.col("id").alias("i"), "k")
    first = own.join(gone, (F.col("id") == F.col("i")) & (F.col("key") == F.col("k")), "left_anti")

    # Families.
    kin = _families(docs, first, size)
    within = _family_links(kin.where("diff IS NOT NULL"), percent)

    # Heavy elements go last.
    heavy = written(first.select(F.explode("head").alias("t")).groupBy("t").count().where(F.col("count") > HEAVY).select("t"))
    few = heavy.count() <= MAX_HEAVY
    listed = spark.sparkContext.broadcast(np.sort(heavy.toArrow().column("t").to_numpy())) if few else None
    kinds = "id long, n long, tokens array<long>, deep boolean"
    cut = written(arrow_map(first.select("id", "n", "head"), _prefixes(listed, percent), kinds) if few else _ordered(first.select("id", "n", "head"), heavy, percent))
    deep = written(cut.where("deep").select("id").distinct())
    texts, whole = by_ids(docs, deep, "left_semi", "id"), _whole_heads(size)
    if few:  # both steps in one worker
        prefixes = _prefixes(listed, percent)
        again = arrow_map(texts, lambda batches: prefixes(whole(batches)), kinds)
    else:
        again = _ordered(arrow_map(texts, whole, "id long, n long, head array<long>"), heavy, percent)
    label = kin.where("diff IS NOT NULL").select(F.col("id").alias("i"), "f")
    entries = cut.where("NOT deep").union(again).join(label, F.col("id") == F.col("i"), "left")
    entries = written(entries.select("id", "n", "f", "tokens")).select("id", "n", F.coalesce("f", -1 - F.col("id")).alias("f"), F.posexplode("tokens").alias("p", "t"))

    # Lists that hold different families, and in them what can still overlap enough.
    live = written(entries.groupBy("t").agg(F.min("f").alias("f1"), F.max("f").alias("f2"), F.count(F.lit(1)).alias("m")).where("f1 <> f2").select(F.col("t").alias("live"), "m"))
    kept = written(entries.join(live, F.col("t") == F.col("live")).drop("live"))
    pairs = met(kept, percent).where(reachable(percent)).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
    counts_of = lambda c: first.select(F.col("id").alias(f"id_{c}"), F.col("n").alias(f"n_{c}"), F.col("hist").alias(f"hist_{c}"))
    pairs = pairs.join(counts_of("a"), F.col("a") == F.col("id_a")).join(counts_of("b"), F.col("b") == F.col("id_b")).select("a", "b", "n_a", "n_b", "hist_a", "hist_b")
    across = _linked(docs, written(arrow_map(pairs, _possible(percent), "a long, b long").distinct()), size, percent)
    found = components(within.union(across))
    members = classes.join(found.select("id", "component"), F.col("rep") == F.col("id"), "left").select("k", F.coalesce("component", "rep").alias("component_id"))
    return sketch.join(members, same & F.col("id").isNotNull(), "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, *, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without all but one of each group: the smallest id, if an id of the group stands for one row alone (and ids stay under 2^61).

    Rows whose id is null or repeated are told apart by their texts: of rows
    with equal texts one stays, the others count as documents of their own.
    """
    columns = docs.columns
    number = docs.withColumn("__n", F.col(id_col).cast("long"))
    several = written(number.groupBy("__n").agg(F.count(F.lit(1)).alias("m")).where("m > 1 OR __n IS NULL").select(F.col("__n").alias("id")))
    if not several.isEmpty():
        some = several.select(F.col("id").alias("__id"))
        double = number.join(some, F.col("__n").eqNullSafe(F.col("__id")), "left_semi")
        words = F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        double = double.where(words).withColumn("__k", text_key(text_col)).dropDuplicates(["__k"]).drop("__k").union(double.where(~words))
        # numbers of their own, after all others or before them; written, so that they stay
        least, most = (x or 0 for x in number.agg(F.min("__n"), F.max("__n")).first())
        own = F.monotonically_increasing_id()
        fresh = written(double.withColumn("__n", own + F.lit(most + 1) if most < 1 << 61 else F.lit(least - 1) - own))
        number = number.join(some.where("__id IS NOT NULL"), F.col("__n") == F.col("__id"), "left_anti").where("__n IS NOT NULL").unionByName(fresh)
    groups = jaccard_groups(number, size=size, percent=percent, id_col="__n", text_col=text_col)
    gone = written(groups.where(F.col("component_id") != F.col("__n")).select(F.col("__n").alias("id")).distinct())
    return by_ids(number, gone, "left_anti", "__n").select(*columns)
