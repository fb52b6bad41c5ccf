"""Benchmark decontamination (operator 1).

Windows of the benchmark items' words are patterns of one Aho-Corasick
automaton whose symbols are word numbers. Each document is read once; every
occurrence comes back with the span of the original text that it covers.

Defined results. A null or empty text has no words and is clean. An item
without words, or with a null item_id, yields no window; rows that repeat an
item_id are one item. Repeated documents are judged one by one. An empty
benchmark leaves every document clean. Columns other than those named in the
arguments are not looked at.

Scale: one pass over the text, no shuffle. The benchmark is split into blocks
of at most ``block_words`` words by a hash of item_id, so a broadcast automaton
has a fixed bound; more blocks mean more passes, not a larger automaton. A worker
builds a block's automaton once for all its tasks. The driver holds the benchmark's texts, which
are a given list of test items and not the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDED_WORD, arrow_map, binaries, folded_words

#: Words of benchmark text in one automaton; about 120 MB per Python worker.
BLOCK_WORDS = 200_000


def _windows(words: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield tuple(words[i : i + size])


def build_automaton(items: list[tuple[object, bytes]], size: int) -> tuple[dict[bytes, int], ahocorasick.Automaton | None]:
    """Word numbers and the automaton; a pattern carries its length and items."""
    numbers: dict[bytes, int] = {}
    patterns: dict[tuple[int, ...], set] = {}
    for item, text in items:
        for window in _windows(folded_words(text), size):
            key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in window)
            patterns.setdefault(key, set()).add(item)
    if not patterns:
        return numbers, None
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, found in patterns.items():
        automaton.add_word(key, (len(key), tuple(found)))
    automaton.make_automaton()
    return numbers, automaton


def scan_words(words: list[bytes], numbers: dict[bytes, int], automaton) -> tuple[list[tuple[int, int]], set]:
    """Hit word ranges [from, to), merged and in order, and the items found."""
    ids = tuple(map(numbers.get, words, repeat(0)))
    if not any(ids):
        return [], set()
    spans: list[tuple[int, int]] = []
    items: set = set()
    for end, (length, found) in automaton.iter(ids):
        spans.append((end - length + 1, end + 1))
        items.update(found)
    return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def char_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code point ranges of the original text."""
    at = [m.span() for m in FOLDED_WORD.finditer(text.lower())]
    # bytes 0x80-0xBF continue a character and don't begin one
    begins = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [(int(begins[at[a][0]]) - 1, int(begins[at[b - 1][1] - 1])) for a, b in spans]


def _blocks(benchmark: DataFrame, size: int, block_words: int) -> list[list[tuple[str, bytes]]]:
    """Items in lists of about block_words words, an item in one of them."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")
    )
    # a word and what ends it take two bytes at least
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-n_bytes // (2 * block_words)))
    out = []
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        rows = [(r[0], bytes(r[1])) for r in part.toLocalIterator()]
        if rows:
            out.append(rows)
    return out


OUT = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<from_char:long,to_char:long>>, contaminated boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: id_col, counts, items, spans of hit text.

    ``spans`` are maximal ranges of hit words as [from_char, to_char) in code
    points of the original text.
    """
    spark = docs.sparkSession
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumns(
        {"hits": F.lit(None).cast("array<struct<a:long,b:long>>"), "items": F.lit(None).cast("array<string>")}
    )
    out = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {OUT}"
    blocks = _blocks(benchmark, window, block_words) or [[]]
    for k, items in enumerate(blocks, start=1):
        last = k == len(blocks)
        df = arrow_map(df, _scan_pass(spark.sparkContext.broadcast(items), window, id_col if last else None), out if last else df.schema)
    return df


def _built(items, window: int) -> tuple:
    """The broadcast block's automaton, kept with the broadcast: a worker builds it once, not each task, and holds one at a time."""
    from pyspark.broadcast import _broadcastRegistry

    if "_built" not in items.__dict__:
        for other in _broadcastRegistry.values():
            other.__dict__.pop("_built", None)
        items._built = build_automaton(items.value, window)
    return items._built


def _scan_pass(items, window: int, finish: str | None):
    """Add a block's hits; in the last pass give the result, the id under the name ``finish``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, automaton = _built(items, window)
        for batch in batches:
            hits, names = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for i, text in enumerate(binaries(batch, "text")):
                words = folded_words(text)
                spans, found = scan_words(words, numbers, automaton) if automaton is not None else ([], set())
                if spans:
                    hits[i] = (hits[i] or []) + [{"a": a, "b": b} for a, b in spans]
                    names[i] = (names[i] or []) + sorted(found)
                if finish is not None:
                    for column, value in zip(rows, _judged(text, words, hits[i], names[i]), strict=True):
                        column.append(value)
            if finish is None:
                arrays = [batch.column(0), batch.column(1), pa.array(hits, batch.schema.field(2).type), pa.array(names, batch.schema.field(3).type)]
                yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            else:
                span = pa.list_(pa.struct([("from_char", pa.int64()), ("to_char", pa.int64())]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), span]
                columns = [batch.column(0), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True)), pa.array([n > 0 for n in rows[1]], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[finish, "n_words", "n_hit", "n_items", "items", "spans", "contaminated"])

    return run


def _judged(text: bytes | None, words: list[bytes], hits: list[dict] | None, names: list[str] | None) -> tuple:
    """n_words, n_hit, n_items, items and spans of one document."""
    if not hits:
        return len(words), 0, 0, [], []
    merged = merge([(h["a"], h["b"]) for h in hits])
    items = sorted(set(names or []))
    return len(words), sum(b - a for a, b in merged), len(items), items, [{"from_char": a, "to_char": b} for a, b in char_spans(text, merged)]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, all columns, in which no benchmark window occurs."""
    spark = docs.sparkSession
    for items in _blocks(benchmark, window, block_words):
        docs = arrow_map(docs, _filter_pass(spark.sparkContext.broadcast(items), window, text_col), docs.schema)
    return docs


def _filter_pass(items, window: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, automaton = _built(items, window)
        for batch in batches:
            if automaton is None:
                yield batch
                continue
            clean = [not scan_words(folded_words(t), numbers, automaton)[0] for t in binaries(batch, text_col)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run
