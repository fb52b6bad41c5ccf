"""Exact removal of repeated byte strings (operator 5).

A byte goes when a string of ``length`` bytes that covers it also starts
earlier: in a document of smaller id, or earlier in the same document.

The suffixes are sorted bucket by bucket, as in blockwise construction over a
difference cover. A cover by positions modulo a number needs a rank for a fifth
of all suffixes, far beyond the disk allowed here (see README). The cover used
is chosen by content and has the same property: in each string of ``length``
bytes the k-gram of the smallest hash is in the cover, so equal strings meet the
cover at equal offsets. That k-gram's name is the rank that decides a string's
bucket: strings of different buckets differ. Buckets met once have no repeated
string and are dropped before any text moves. In the others, the suffixes of one
bucket are sorted at a time by the name of their first ``length`` bytes, ties
by place; every suffix but the first of equals starts later than another.

Names are 64-bit polynomial hashes; two different strings of one bucket share a
name with a chance of 2^-64.

Defined results. A null text is empty. Texts shorter than ``length`` lose
nothing. A null id comes last; rows that repeat an id come in the order of a
hash of their texts, and rows that repeat id and text are one document. Ids are
integers, or what casts to them; a null counts as the largest. Other columns are not looked at.

Scale: equal texts are judged once. Shuffled: a name for every 35 bytes or so,
the texts once, and the surroundings of repeated names. A bucket of more than
``hot`` suffix runs isn't gathered: each of its suffixes is dealt by its own
name, after equal ones of a task are reduced to the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_IDS, arrow_map, binaries, join_keys, text_bytes, written

#: Bytes of the cover's k-grams.
COVER_GRAM = 32
#: Suffix runs that one bucket gathers at most.
HOT = 512
#: Names of hot suffixes that a task remembers.
SEEN = 200_000
#: Bytes of runs sorted in one go.
CHUNK_BYTES = 2 << 20
_BASE = 0xD1342543DE82EF95
_LAST = (1 << 63) - 1


class Names:
    """Polynomial names of all substrings of one length, modulo 2^64."""

    def __init__(self) -> None:
        self.bytes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.powers, self.inverse = self._table(_BASE, 1 << 14), self._table(pow(_BASE, -1, 1 << 64), 1 << 14)

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    def sums(self, text: bytes) -> np.ndarray:
        n = len(text)
        if n + 1 > len(self.powers):
            size = 1 << (n + 1).bit_length()
            self.powers, self.inverse = self._table(_BASE, size), self._table(pow(_BASE, -1, 1 << 64), size)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.bytes[np.frombuffer(text, np.uint8)] * self.powers[:n], out=out[1:])
        return out

    def of(self, sums: np.ndarray, length: int) -> np.ndarray:
        n = len(sums) - length
        return mixed((sums[length:] - sums[:n]) * self.inverse[:n])


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit moves every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each ``width`` neighbours."""
    n, step = len(a) - width + 1, 1
    while step * 2 <= width:
        a = pick(a[:-step], a[step:])
        step *= 2
    return a if step == width else pick(a[:n], a[width - step : width - step + n])


def buckets(text: bytes, names: Names, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of k-grams, each suffix's bucket, and where the cover stands."""
    grams = names.of(names.sums(text), gram)
    width = length - gram + 1
    least = sliding(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    cover = grams == sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    return grams, least, cover


def _cover(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for batch in batches:
            out = []
            for text in binaries(batch, "text"):
                if text is None or len(text) < length:
                    out.append(None)
                    continue
                grams, _, cover = buckets(text, names, length, gram)
                out.append(grams[cover].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["id", "h", "names"])

    return run


RUNS = "bucket long, id long, h long, at long, bytes binary, upto long"


def _runs(length: int, gram: int):
    """Runs of suffixes of repeated buckets.

    Rows with bytes are runs for their bucket. Rows without are single suffixes
    of hot buckets, dealt by name; with ``upto`` they are decided: [at, upto) goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        seen: dict[int, tuple[int, int, int]] = {}  # documents come in order, so what was seen is earlier
        for batch in batches:
            ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cols: list[list] = [[], [], [], [], [], []]
            hot_rows, hot_at, hot_name = [], [], []
            for row, (text, keys, n) in enumerate(zip(binaries(batch, "text"), batch.column(3), batch.column(4), strict=True)):
                sums = names.sums(text)
                least = sliding(names.of(sums, gram), length - gram + 1, np.minimum)
                begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                end = np.append(begin[1:], len(least))
                listed = keys.values.to_numpy().view(np.uint64)
                order = np.argsort(listed)
                at = np.minimum(np.searchsorted(listed, least[begin], sorter=order), len(listed) - 1)
                here = listed[order[at]] == least[begin]
                hot = here & (n.values.to_numpy(zero_copy_only=False)[order[at]])
                for i in np.flatnonzero(here & ~hot):
                    a, b = int(begin[i]), int(end[i])
                    for col, value in zip(cols, (int(least[a].view(np.int64)), ids[row], hs[row], a, text[a : b + length - 1], None), strict=True):
                        col.append(value)
                if hot.any():
                    places = np.concatenate([np.arange(begin[i], end[i]) for i in np.flatnonzero(hot)])
                    hot_rows.append(np.full(len(places), row)), hot_at.append(places), hot_name.append(names.of(sums, length)[places])
            if hot_rows:
                rows, places, name = np.concatenate(hot_rows), np.concatenate(hot_at), np.concatenate(hot_name)
                order = np.lexsort((places, hs[rows], ids[rows], name))
                rows, places, name = rows[order], places[order], name[order]
                first = np.concatenate([[True], name[1:] != name[:-1]])
                lead = np.flatnonzero(first)
                if len(seen) > SEEN:
                    seen.clear()
                known = [seen.setdefault(w, at) for w, at in zip(name[lead].tolist(), zip(ids[rows[lead]].tolist(), hs[rows[lead]].tolist(), places[lead].tolist(), strict=True), strict=True)]
                earliest = np.array(known, np.int64)[np.cumsum(first) - 1]
                # a repeated row of the table stands at the same place and isn't later
                late = (ids[rows] != earliest[:, 0]) | (hs[rows] != earliest[:, 1]) | (places != earliest[:, 2])
                fresh = first & ~late
                cols[0] += name[fresh].view(np.int64).tolist()
                cols[1] += ids[rows[fresh]].tolist()
                cols[2] += hs[rows[fresh]].tolist()
                cols[3] += places[fresh].tolist()
                cols[4] += [None] * int(fresh.sum())
                cols[5] += [None] * int(fresh.sum())
                rows, places = rows[late], places[late]
                later = np.lexsort((places, rows))
                rows, places = rows[later], places[later]
                if len(rows):
                    cut = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (places[1:] != places[:-1] + 1)]))
                    last = np.append(cut[1:], len(rows)) - 1
                    cols[0] += [None] * len(cut)
                    cols[1] += ids[rows[cut]].tolist()
                    cols[2] += hs[rows[cut]].tolist()
                    cols[3] += places[cut].tolist()
                    cols[4] += [None] * len(cut)
                    cols[5] += (places[last] + length).tolist()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "id", "h", "at", "bytes", "upto"])

    return run


def _sort_buckets(length: int):
    """Rows come by bucket and place; of equal suffixes all but the first go."""

    def decide(rows: list[tuple], names: Names) -> pa.RecordBatch:
        text = b"".join(r[4] for r in rows)
        sizes = np.fromiter((len(r[4]) for r in rows), np.int64, len(rows))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        n = sizes - length + 1
        suffix_row = np.repeat(np.arange(len(rows)), n)
        inner = np.arange(len(suffix_row)) - np.repeat(np.cumsum(n) - n, n)
        name = names.of(names.sums(text), length)[starts[suffix_row] + inner]
        order = np.argsort(name, kind="stable")  # ties stay by bucket, document and place
        again = np.zeros(len(name), bool)
        again[order[1:]] = name[order[1:]] == name[order[:-1]]
        found = np.flatnonzero(again)
        if not len(found):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names=["id", "h", "at", "upto"])
        cut = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1] + 1) | (suffix_row[found[1:]] != suffix_row[found[:-1]])]))
        last = found[np.append(cut[1:], len(found)) - 1]
        begin = found[cut]
        row = suffix_row[begin]
        ids, hs, at = (np.fromiter((r[k] for r in rows), np.int64, len(rows)) for k in (1, 2, 3))
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(hs[row]), pa.array(at[row] + inner[begin]), pa.array(at[row] + inner[last] + length)], names=["id", "h", "at", "upto"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                if rows and row[:4] == rows[-1][:4]:  # a repeated row of the table
                    continue
                if size >= CHUNK_BYTES and row[0] != rows[-1][0]:
                    yield decide(rows, names)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield decide(rows, names)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text, spans in zip(binaries(batch, "text"), batch.column(batch.schema.get_field_index("spans")).to_pylist(), strict=True):
            text = text or b""
            merged: list[list[int]] = []
            for a, b in sorted((s["at"], s["upto"]) for s in spans or []):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            edges = [0, *(x for s in merged for x in s), len(text)]
            kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            for col, value in zip(out, (len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), [{"from_byte": a, "to_byte": b} for a, b in merged]), strict=True):
                col.append(value)
        spans_kind = pa.list_(pa.struct([("from_byte", pa.int64()), ("to_byte", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), spans_kind]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, *, length: int = 100, gram: int = COVER_GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_bytes, n_removed, n_spans, kept_sha256 and spans [from_byte, to_byte)."""
    if not 0 < gram < length:
        raise ValueError("gram must be shorter than length")
    own = F.col(id_col).cast("long")
    docs = docs.select(own.alias("own"), F.coalesce(own, F.lit(_LAST)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # Equal texts: all but the first go whole.
    keyed = written(docs.select("own", "id", "h", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), text_bytes().alias("n"), F.when(text_bytes() < length, F.sha2("text", 256)).alias("sha")))
    classes = written(keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("key").alias("k"), "rep", "m"))
    later = written(join_keys(keyed, classes, F.col("key") == F.col("k"), "k", "m").where("id > rep").select("own", "id", "h", "n", "sha"))
    gone = later.select(F.col("id").alias("i"), F.col("h").alias("g")).distinct()
    small = later.count() <= BROADCAST_IDS
    first = docs.join(F.broadcast(gone) if small else gone, (F.col("id") == F.col("i")) & (F.col("h") == F.col("g")), "left_anti").select("own", "id", "h", "text")

    cover = written(arrow_map(first.select("id", "h", "text"), _cover(length, gram), "id long, h long, names array<long>")).select("id", "h", F.explode("names").alias("name"))
    repeated = written(cover.groupBy("name").count().where("count > 1").select(F.col("name").alias("r"), "count", (F.col("count") > hot).alias("hot")))
    listed = join_keys(cover, repeated, F.col("name") == F.col("r"), "r", "count").groupBy(F.col("id").alias("i"), F.col("h").alias("g")).agg(F.collect_set(F.struct("name", "hot")).alias("found"))
    listed = listed.select("i", "g", F.col("found.name").alias("names"), F.col("found.hot").alias("hots"))
    same = (F.col("id") == F.col("i")) & (F.col("h") == F.col("g"))
    runs = written(arrow_map(first.join(listed, same).select("id", "h", "text", "names", "hots").sortWithinPartitions("id", "h"), _runs(length, gram), RUNS))
    spans = "id long, h long, at long, upto long"
    cold = arrow_map(runs.where("bytes IS NOT NULL").select("bucket", "id", "h", "at", "bytes").repartition("bucket").sortWithinPartitions("bucket", "id", "h", "at"), _sort_buckets(length), spans)
    dealt = runs.where("bytes IS NULL AND upto IS NULL").select("bucket", "id", "h", "at")
    by_name = Window.partitionBy("bucket").orderBy("id", "h", "at")  # a row per task that met the name
    warm = dealt.withColumn("first", F.first(F.struct("id", "h", "at")).over(by_name)).where(F.struct("id", "h", "at") != F.col("first")).select("id", "h", "at", (F.col("at") + length).alias("upto"))
    decided = runs.where("upto IS NOT NULL").select("id", "h", "at", "upto")
    gathered = cold.union(warm).union(decided).groupBy(F.col("id").alias("i"), F.col("h").alias("g")).agg(F.collect_set(F.struct("at", "upto")).alias("spans"))
    out = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from_byte:long,to_byte:long>>"
    kept = arrow_map(first.join(gathered, same, "left").select(F.col("own").alias("id"), "text", "spans"), _remove, out)
    whole = F.col("n") >= length
    copies = later.select(
        F.col("own").alias("id"),
        F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(0).alias("n_removed"),
        F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("from_byte"), F.col("n").alias("to_byte")))).otherwise(F.array().cast("array<struct<from_byte:long,to_byte:long>>")).alias("spans"),
    )
    every = kept.union(copies)
    return every.withColumnRenamed("id", id_col)
