"""Quality rules by n-gram perplexity (operator 8).

The model reads a text as the characters of its words with one space between
them, each from the ``order - 1`` characters before it, word ends and the word
before included. Spark counts the n-grams of all documents; continuation counts, modified
Kneser-Ney discounts and backoff weights follow in Spark, and the result is kept in
arrays sorted by 64-bit hash. No n-gram is pruned at any size.

``score`` is the text's negative log probability over its characters that are neither
space nor symbol (``[#*$%&|<>]``): strewn symbols cost much and count for nothing. For each language a
band around the median, ``below`` and ``above`` robust deviations (median absolute
deviation) wide, is kept; what lies outside is rejected, as are documents that fail the base
rules (under 50 words, or more than half of the words in repeated 3-word windows).

Defined results. A null text has no words, no score, and fails the base rules.
A null language is a group of its own. An empty table gives an empty result.
A band needs no least number of documents: with a deviation of 0, only scores
within ``floor`` nats are inside. Texts of any length are read in pieces that
overlap, whole. Repeated rows are judged one by one; other columns are not looked at.

Scale: n-grams are added up in each task first, and what a task holds is bounded.
Texts are never shuffled. More n-grams mean more blocks of about ``max_entries``,
ranges of context hashes that are looked up one after another, one in memory at a time.
A chunk of text asks for each distinct n-gram once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, space_words, written

#: Six characters of 21 bits are what two longs hold.
ORDER, MOST = 5, 6
#: n-grams of one block of the model, of all orders, about; 24 bytes each at most where it is used.
MAX_ENTRIES = 1_500_000
#: A band's reach below and above the median in robust deviations, and in nats at
#: least. Rote text lies below: clean texts that others repeat do too, so the band is wider there.
BELOW, ABOVE, FLOOR = 10.0, 6.0, 0.1
#: Characters read in one go, and distinct n-grams that a counting task holds.
CHUNK, HELD = 2_000_000, 1_500_000
#: Bits that an n-gram of numbered characters may take.
WORD_BITS = 64
_SYMBOLS = b"#*$%&|<>"
_EDGE = 1  # stands before a text
_BITS = 21
_P = np.uint64(0x9E3779B97F4A7C15)


def base_counts(text: bytes | None) -> tuple[list[bytes], int, int, int, int]:
    """Words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = space_words(text)
    if not words:
        return words, 0, 0, 0, 0
    n_symbols = len(text) - len(text.translate(None, _SYMBOLS))
    data = np.frombuffer(b"".join(words), np.uint8)
    word_chars = int(((data & 0xC0) != 0x80).sum())
    lines = [x for x in text.split(b"\n") if x.split()]
    return words, word_chars, n_symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that stand in the text twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    # Windows by hash first; only texts in which two agree are looked at word by word.
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = h[:n].copy()
    for k in range(1, size):
        window = window * _P + h[k : n + k]
    window.sort()
    if not (window[1:] == window[:-1]).any():
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    window = ids[:n].copy()
    for k in range(1, size):  # numbered anew each time, so that no product overflows
        _, window = np.unique(window * len(number) + ids[k : n + k], return_inverse=True)
    hit = np.zeros(len(words) + 1, np.int64)
    again = np.flatnonzero(np.bincount(window)[window] > 1)
    np.add.at(hit, again, 1)
    np.add.at(hit, again + size, -1)
    return int((np.cumsum(hit)[:-1] > 0).sum())


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(words: list[bytes], order: int, chunk: int) -> Iterator[np.ndarray]:
    """The text's characters, ``order - 1`` that are only context and then ``chunk`` to be read, again and again."""
    text = b" ".join(words).decode("utf-8", "replace").replace(chr(_EDGE), " ")
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    codes = np.concatenate([np.full(order - 1, _EDGE, np.uint32), codes])
    for i in range(0, len(codes) - order + 1, chunk):
        yield codes[i : i + chunk + order - 1]


def chunks(texts: Iterable[list[bytes]], order: int, chunk: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(number of the text, piece) in lots of about ``chunk`` characters."""
    owners, lot, held = [], [], 0
    for i, words in enumerate(texts):
        for piece in pieces(words, order, chunk) if words else ():
            owners.append(i)
            lot.append(piece)
            held += len(piece)
            if held >= chunk:
                yield owners, lot
                owners, lot, held = [], [], 0
    if lot:
        yield owners, lot


def grams(lot: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of pieces, as two words of three characters, the newest lowest; which one ends at each place; how many places each piece has.

    A lot has few kinds of characters, so numbers for these make an n-gram one
    integer, which sorts fastest; where they are too many, a hash stands for it.
    """
    codes = np.concatenate(lot)
    sizes = np.array([len(x) for x in lot])
    # the first order - 1 characters of a piece are context alone
    places = np.ones(len(codes), bool)
    for k in range(order - 1):
        places[np.cumsum(sizes) - sizes + k] = False
    ends = np.flatnonzero(places)
    kinds = np.flatnonzero(np.bincount(codes, minlength=2))
    bits = int(len(kinds) - 1).bit_length()
    if bits * order <= WORD_BITS:
        number = np.zeros(kinds[-1] + 1, np.uint64)
        number[kinds] = np.arange(len(kinds), dtype=np.uint64)
        numbered = number[codes]
        key = np.zeros(len(codes), np.uint64)
        for k in range(order):
            key[k:] |= numbered[: len(codes) - k] << np.uint64(bits * k)
        key, inverse = np.unique(key[ends], return_inverse=True)
        chars = [kinds[((key >> np.uint64(bits * k)) & np.uint64((1 << bits) - 1)).astype(np.int64)].astype(np.uint64) for k in range(order)]
        low, high = _halves(chars)
    else:
        low, high = _halves([codes[ends - k].astype(np.uint64) for k in range(order)])
        _, at, inverse = np.unique(gram_hash(low, high, order), return_index=True, return_inverse=True)
        low, high = low[at], high[at]
    return low, high, inverse, sizes - order + 1


def _halves(chars: list[np.ndarray]) -> list[np.ndarray]:
    """Characters, the newest first, in two words."""
    out = []
    for first in (0, 3):
        h = np.zeros(len(chars[0]), np.uint64)
        for k, c in enumerate(chars[first : first + 3]):
            h |= c << np.uint64(_BITS * k)
        out.append(h)
    return out


def gram_hash(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    return mixed(mixed(low * _P + np.uint64(n)) + high * _P)


def first_chars(low, high, n: int) -> tuple:
    """The ``n`` newest characters alone."""
    mask = lambda k: (1 << (_BITS * max(0, min(3, k)))) - 1
    return low & np.uint64(mask(n)), high & np.uint64(mask(n - 3))


def before(low: np.ndarray, high: np.ndarray) -> tuple:
    """All but the newest character."""
    return (low >> np.uint64(_BITS)) | ((high & np.uint64((1 << _BITS) - 1)) << np.uint64(2 * _BITS)), high >> np.uint64(_BITS)


def _count(order: int, chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the task's n-grams of the highest order; emitted when too many are held."""
    parts: list[tuple[np.ndarray, ...]] = []

    def merged() -> tuple[np.ndarray, ...]:
        low, high, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
        _, inverse = np.unique(gram_hash(low, high, order), return_inverse=True)
        at = np.empty(int(inverse.max(initial=-1)) + 1, np.int64)
        at[inverse] = np.arange(len(inverse))
        return low[at], high[at], np.bincount(inverse, weights=n).astype(np.int64)

    def packed() -> Iterator[pa.RecordBatch]:
        low, high, n = merged()
        by = np.lexsort((low, high))  # alike ones together take less room
        parts.clear()
        for i in range(0, len(by), 100_000):
            some = by[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(low[some].view(np.int64)), pa.array(high[some].view(np.int64)), pa.array(n[some])], names=["low", "high", "n"])

    texts = (space_words(t) for batch in batches for t in batch.column(0).cast(pa.binary()).to_pylist())
    for _, lot in chunks(texts, order, chunk):
        low, high, inverse, _ = grams(lot, order)
        parts.append((low, high, np.bincount(inverse, minlength=len(low))))
        if sum(len(p[0]) for p in parts) > HELD:
            parts[:] = [merged()]
            if len(parts[0][0]) > HELD // 2:
                yield from packed()
    if parts:
        yield from packed()


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney from counts of counts."""
    if not (n1 and n2):
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3), strict=True))


def _newest(n: int) -> list[Column]:
    mask = lambda k: F.lit((1 << (_BITS * max(0, min(3, k)))) - 1)
    return [F.col("low").bitwiseAND(mask(n)).alias("low"), F.col("high").bitwiseAND(mask(n - 3)).alias("high")]


def _oldest(n: int) -> Column:
    """Character n, counted from the newest."""
    half, k = ("low", n - 1) if n <= 3 else ("high", n - 4)
    return F.shiftrightunsigned(half, _BITS * k).bitwiseAND(F.lit((1 << _BITS) - 1))


def _before() -> list[Column]:
    carried = F.shiftleft(F.col("high").bitwiseAND(F.lit((1 << _BITS) - 1)), 2 * _BITS)
    return [F.shiftrightunsigned("low", _BITS).bitwiseOR(carried).alias("c_low"), F.shiftrightunsigned("high", _BITS).alias("c_high")]


def levels(order: int, counts: DataFrame) -> tuple[list[DataFrame], int]:
    """Interpolated modified Kneser-Ney: low, high, logp, delta, mass of each order, shortest first; and the number of characters known.

    ``delta`` is logp less the logp of the shorter n-gram that it stands for;
    ``mass`` is the log backoff weight of the n-gram's context. Discounts come from all counts.
    """
    g, counted = counts.select("low", "high", F.col("n").cast("double").alias("c")), []
    for n in range(order, 0, -1):
        counted.append(g)
        if n > 1:
            # continuation counts: in how many contexts the shorter one stands; one
            # that begins with the edge has no longer context and keeps its count
            shorter = g.groupBy(*_newest(n - 1)).agg(F.count("*").cast("double").alias("kinds"), F.sum("c").alias("sums"))
            whole = _oldest(n - 1) == _EDGE if n > 2 else F.lit(False)
            g = written(shorter.select("low", "high", F.when(whole, F.col("sums")).otherwise(F.col("kinds")).alias("c")))
    known = counted[-1].count()
    out: list[DataFrame] = []
    for n, g in enumerate(reversed(counted), start=1):
        seen = {int(r.c): r.n for r in g.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
        d1, d2, d3 = discounts_of(*(seen.get(k, 0) for k in (1, 2, 3, 4)))
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        g = g.select("low", "high", "c", cut.alias("cut"), *_before(), *(x.alias(f"s_{x_}") for x, x_ in zip(_newest(n - 1), ("low", "high"), strict=True)))
        totals = g.groupBy(F.col("c_low").alias("of_low"), F.col("c_high").alias("of_high")).agg(F.sum("c").alias("total"), F.sum("cut").alias("left"))
        g = g.join(totals, (F.col("c_low") == F.col("of_low")) & (F.col("c_high") == F.col("of_high")))
        low = F.lit(1.0 / (known + 1))
        if n > 1:
            short = out[-1].select(F.col("low").alias("t_low"), F.col("high").alias("t_high"), F.exp("logp").alias("p"))
            g = g.join(short, (F.col("s_low") == F.col("t_low")) & (F.col("s_high") == F.col("t_high")))
            low = F.col("p")
        logp = F.log((F.col("c") - F.col("cut")) / F.col("total") + F.col("left") / F.col("total") * low)
        out.append(written(g.select("low", "high", logp.alias("logp"), (logp - F.log(low) if n > 1 else logp).alias("delta"), F.log(F.col("left") / F.col("total")).alias("mass"))))
    return out, known


def _keys(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low, high = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
        key, ctx = gram_hash(low, high, n), gram_hash(*before(low, high), n)
        # the upper half of the hashes comes last as signed numbers too
        ctx ^= np.uint64(1 << 63)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, n, np.int32)), pa.array(ctx.view(np.int64)), pa.array(key.view(np.int64)), batch.column(2), batch.column(3)], names=["level", "ctx", "key", "delta", "mass"])


def fit(docs: DataFrame, *, order: int = ORDER, max_entries: int = MAX_ENTRIES, text_col: str = "text") -> list:
    """Count all characters of all documents and estimate in Spark; broadcast blocks of about max_entries n-grams.

    Every counted n-gram is in one block. Blocks are ranges of context hashes, so
    an n-gram, its context's backoff weight and all that follows the context are in
    one. A block holds arrays alone: the bounds, for each order the sorted hashes and
    values of n-grams and of contexts, and what an unknown character costs.
    """
    if not 1 <= order <= MOST:
        raise ValueError(f"order must be 1 to {MOST}")
    spark = docs.sparkSession
    found = arrow_map(docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string")), partial(_count, order, CHUNK), "low long, high long, n long")
    counts = written(found.groupBy("low", "high").agg(F.sum("n").alias("n")))
    tables, known = levels(order, counts)
    blocks = max(1, -(-sum(level.count() for level in tables) // max_entries))
    keyed = None
    for n, level in enumerate(tables, start=1):
        k = arrow_map(level.select("low", "high", "delta", "mass"), partial(_keys, n), "level int, ctx long, key long, delta double, mass double")
        keyed = k if keyed is None else keyed.union(k)
    keyed = written(keyed.repartitionByRange("ctx").sortWithinPartitions("ctx"))  # a block's range is then few row groups
    mass = tables[0].select("mass").first()
    unseen = mass[0] - float(np.log(known + 1)) if mass else -10.0
    out = []
    for b in range(blocks):
        least, most = b * 2**64 // blocks - 2**63, (b + 1) * 2**64 // blocks - 1 - 2**63
        rows = keyed.where(F.col("ctx").between(least, most)).toArrow()  # about max_entries of them, by the hash
        level, ctx, key = (rows.column(c).to_numpy() for c in ("level", "ctx", "key"))
        ctx, key, delta, weight = ctx.view(np.uint64) ^ np.uint64(1 << 63), key.view(np.uint64), rows.column("delta").to_numpy(), rows.column("mass").to_numpy()
        longer = []
        for n in range(1, order + 1):
            at = np.flatnonzero(level == n)
            at = at[np.argsort(key[at])]
            hashes, first = np.unique(ctx[at], return_index=True)
            longer.append((key[at], delta[at].astype(np.float32), hashes, weight[at][first].astype(np.float32)))
        out.append(spark.sparkContext.broadcast((least + 2**63, most + 2**63, longer, unseen)))
    return out


def _find(hashes: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(hashes) or not len(keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return hashes[at] == keys, values[at]


def log_probs(blocks: list, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Log probability of the newest character of each n-gram; of several blocks, one at a time is in memory."""
    total = np.zeros(len(low))
    asked = None
    for block in blocks:
        least, most, longer, unseen = block.value
        if asked is None:
            asked = []
            for n in range(1, len(longer) + 1):
                part = first_chars(low, high, n)
                key, ctx = gram_hash(*part, n), gram_hash(*before(*part), n)
                by = np.argsort(key)  # a search for sorted keys is far faster
                asked.append((by, key[by], ctx[by]))
        for n, ((by, key, ctx), (keys, delta, contexts, mass)) in enumerate(zip(asked, longer, strict=True), start=1):
            mine = (ctx >= np.uint64(least)) & (ctx <= np.uint64(most))
            by, key, ctx = by[mine], key[mine], ctx[mine]
            found, value = _find(keys, delta, key)
            total[by[found]] += value[found]
            by, ctx = by[~found], ctx[~found]
            if n == 1:
                total[by] += unseen
            else:
                known, value = _find(contexts, mass, ctx)
                total[by[known]] += value[known]
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)
    return total


def counted_rows(docs: DataFrame, blocks: list, *, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang, base counts and the score (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            nats = np.zeros(batch.num_rows)

            def texts() -> Iterator[list[bytes]]:
                for text in batch.column(2).cast(pa.binary()).to_pylist():
                    words, *counted = base_counts(text)
                    for col, value in zip(out, (len(words), *counted), strict=True):
                        col.append(value)
                    yield words

            for owners, lot in chunks(texts(), order, CHUNK):
                low, high, inverse, sizes = grams(lot, order)
                nats -= np.bincount(np.repeat(owners, sizes), weights=log_probs(blocks, low, high)[inverse], minlength=len(nats))
            n_words, chars, symbols = (np.array(c, np.int64) for c in out[:3])
            score = pa.array(nats / np.maximum(1, chars - symbols), pa.float64(), mask=n_words == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in out), score], names=["id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, f"id {kind}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")


def judge(docs: DataFrame, *, order: int = ORDER, max_entries: int = MAX_ENTRIES, below: float = BELOW, above: float = ABOVE, floor: float = FLOOR, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id_col, counts, base_failed, score, low and high, kept."""
    blocks = fit(docs, order=order, max_entries=max_entries, text_col=text_col)
    scored = counted_rows(docs, blocks, order=order, id_col=id_col, text_col=text_col, lang_col=lang_col)
    base_failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    scored = written(scored.withColumn("base_failed", base_failed))
    # a bounded summary of each language's scores, exact to a ten-thousandth of its rows
    median = lambda c: F.percentile_approx(c, 0.5, 10_000)
    middle = scored.groupBy(F.col("lang").alias("l")).agg(median("score").alias("mid"))
    off = scored.join(F.broadcast(middle), F.col("lang").eqNullSafe(F.col("l")))
    spread = off.groupBy("l").agg(F.first("mid").alias("mid"), median(F.abs(F.col("score") - F.col("mid"))).alias("dev"))
    reach = lambda width: F.greatest(F.col("dev") * 1.4826 * width, F.lit(floor))
    bands = spread.select("l", (F.col("mid") - reach(below)).alias("low"), (F.col("mid") + reach(above)).alias("high"))
    inside = F.col("score").between(F.col("low"), F.col("high"))
    return scored.join(F.broadcast(bands), F.col("lang").eqNullSafe(F.col("l")), "left").select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "low", "high", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept")
    )
