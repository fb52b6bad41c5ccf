"""Each operator against brute force, with odd rows, empty tables and clashing columns."""

import hashlib
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from helpers import LONG, SCHEMA, contaminated, dedup_lines, folded, frame, jaccard, mixture, odd_rows, page_text, quality, random_page, repeats, spaced
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillgraph.llm import common, components, decontamination, html, jaccard as jac, language, licenses, lines, mixing, perplexity, sharding, substrings


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


BENCH = [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, "One"), (3, None), (4, "..."), (None, "w5"), (2, "One"), (10, "no ID at all")]


@pytest.mark.parametrize("block", [200_000, 4])
def test_decontamination(spark, docs, rows, none, block):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    found = decontamination.decontaminate(docs, bench, block_words=block).collect()
    assert len(found) == len(rows)
    by = {r[0]: r[1] for r in rows}
    for r in found:
        text = by[r.doc_id]
        n, hit, items, sha = contaminated(text, BENCH)
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, items) and r.contaminated == (hit > 0)
        assert hashlib.sha256(",".join(r["items"]).encode()).hexdigest() == sha
        assert sum(len(folded(text[s.from_char : s.to_char])) for s in r.spans) == hit
    kept = decontamination.drop_contaminated(docs, bench, block_words=block)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in found if not r.contaminated)
    assert decontamination.decontaminate(none, bench).count() == 0
    assert not decontamination.decontaminate(docs, bench.where("false")).where("contaminated").count()


def test_automaton_is_built_once_a_worker(monkeypatch):
    """It stays with the broadcast for the tasks that follow, and another block's takes its place."""
    from pyspark import broadcast

    class Block:
        def __init__(self, value):
            self.value = value

    one, two = Block([("1", b"a b c")]), Block([("2", b"d e f")])
    monkeypatch.setattr(broadcast, "_broadcastRegistry", {1: one, 2: two})
    first = decontamination._built(one, 10)
    assert decontamination._built(one, 10) is first and "_built" in one.__dict__
    decontamination._built(two, 10)
    assert "_built" not in one.__dict__ and "_built" in two.__dict__


PAGE = """<html><head><title>T</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body>
<nav><ul><li>menu</li></ul></nav><div class="sidebar"><p>side</p></div><div id="cookie-notice">cookies</div>
<main><article><h1>Head&amp;line</h1><p>First  <b>bold</b>
line<br>two &eacute;<p>Second<ul><li>a<li>b</ul><div class="ad">buy</div><form>f <input></form><aside>x</aside></article></main>
<section class="comments"><p>me too</p></section><footer>foot</footer></body></html>"""


def test_html(spark):
    assert html.main_text(PAGE) == "Head&line\nFirst bold line two é\nSecond\na\nb"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == ""
    # no marked article: regions of text by ratio
    plain = "<body><div class='nav'>a</div>" + "<p>" + "long text here " * 20 + "</p>" * 1 + "<p>" + "more long text " * 20 + "</p></body>"
    assert html.main_text(plain).count("\n") == 1
    assert "<" not in html.main_text("<article><p>1 &lt; 2</p><p>ok") .replace("1 < 2", "")
    pages = spark.createDataFrame([(1, "u", PAGE, "x", 1), (1, "u", PAGE, "x", 1), (2, None, None, "y", 2), (None, "v", "<article>" + LONG, "z", 3)], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert got[1].n_chars == len(got[1].text) > 0 and got[2].text == "" and got[None].text == LONG
    assert html.extract(pages).count() == 4 and html.extract(pages.where("false")).count() == 0


LINE = "A long paragraph of text that goes on and on. " * 4
PARA = f"<p>{LINE}</p>"
BODY = "\n".join([LINE.strip()] * 2)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<article><h1 class="entry-header">Title</h1>{PARA * 2}</article>', f"Title\n{BODY}"),
        (f'<div class="content with-sidebar"><article>{PARA * 2}</article></div>', BODY),
        (f'<div id="page" class="has-nav"><h1>T</h1>{PARA * 2}</div>', f"T\n{BODY}"),
        (f'<div id="sidebar-right" class="sidebar"><h1>T</h1>{PARA * 2}</div>', f"T\n{BODY}"),
        (f'<article>{PARA}<div class="related-work">{PARA}</div></article>', BODY),
        (f'<article>{PARA}<p class="social">{LINE}</p></article>', BODY),
        (f"<article>{PARA}<p>of <math><mi>y</mi></math></p><label>l</label><canvas>c</canvas><object>o</object></article>", f"{LINE.strip()}\nof y\nlco"),
        (f"<div class=teasers><article><p>teaser</p></article></div><div id=body><h2>Short</h2>{PARA * 2}</div>", f"Short\n{BODY}"),
        (f"<body><h2>short heading</h2>{PARA * 2}<footer>f</footer>", f"short heading\n{BODY}"),
        (f'<body><ul><li><a href=x>Home</a><li><a href=y>About</a></ul><div id=c>{PARA * 2}</div><div class="comments"><article class=comment>{PARA * 6}</article></div>', BODY),
        (f'<body><div class="ad">{PARA * 3}</div><article><h1>T</h1><p>short</p></article>', "T\nshort"),
        (f'<div><div class="part">{PARA}</div><div class="part">{PARA}</div></div>', BODY),
    ],
)
def test_html_pages(page, text):
    assert html.main_text(page) == text == page_text(page)


def test_html_by_a_second_extractor():
    r = random.Random(6)
    pages = [random_page(r) for _ in range(250)]
    got = [html.main_text(p) for p in pages]
    assert got == [page_text(p) for p in pages] and sum(map(bool, got)) > 150
    plain = [p.replace("<article", "<div").replace("</article", "</div").replace("<main", "<div").replace("</main", "</div") for p in pages]
    assert [html.main_text(p) for p in plain] == [page_text(p) for p in plain]


def test_html_without_article_marks(spark):
    """The method finds the same text where nothing marks it."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    for x in rows:
        assert html.main_text(x.html.replace("<article>", "<div>").replace("</article>", "</div>")) == html.main_text(x.html) != ""


def test_html_deep_pages():
    n = 100_000
    for page in ("<div>" * n + "x" + "</b>" * n, "<b>" * n + "<p>x" * n, "<ul><li>" * n + "y" * n, "<p>" + "<a>" * n + "z"):
        began = time.perf_counter()
        assert html.main_text(page)
        assert time.perf_counter() - began < 5


@given(st.lists(st.floats(0, 1e3), min_size=1, max_size=30))
@settings(max_examples=50, deadline=None)
def test_threshold_splits_best(xs):
    x = sorted(xs)
    between = lambda k: round(k * (len(x) - k) * (sum(x[k:]) / (len(x) - k) - sum(x[:k]) / k) ** 2, 6)
    cuts = [k for k in range(1, len(x)) if x[k] > x[k - 1]]
    got = html.threshold(np.array(xs))
    assert got in x and (got == x[0] or any(got == x[k] and between(k) >= 0.999 * max(map(between, cuts)) for k in cuts))


@given(st.lists(st.floats(0, 1e3), min_size=1, max_size=40), st.floats(0.3, 3))
@settings(max_examples=30, deadline=None)
def test_smoothing_is_a_mean(xs, sigma):
    got = html.smooth(np.array(xs), sigma)
    assert len(got) == len(xs) and min(xs) - 1e-6 <= got.min() and got.max() <= max(xs) + 1e-6


def test_running_hashes(spark, monkeypatch):
    """A hash for each first part, the same for the same words, at any length of the stretches."""
    words = [f"w{i % 5}" for i in range(23)]
    for stretch in (1, 4, 256):
        monkeypatch.setattr(lines, "STRETCH", stretch)
        rows = spark.createDataFrame([(words[:k],) for k in range(24)], "w array<string>").select(F.size("w").alias("n"), lines._running(F.col("w")).alias("h")).collect()
        whole = [x.h for x in rows if x.n == 23][0]
        assert len(whole) == 24 == len(set(whole)) and all(x.h == whole[: x.n + 1] for x in rows)


def test_lines_of_any_length(spark):
    """A line of a million words and a near copy: in time, and the copy goes."""
    line = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, line, "en", "s"), (2, line.replace("w777 ", "x "), "en", "s"), (3, line + " y z", "en", "s"), (2**63 - 1, "a b", "en", "s"), (None, "a b", "en", "s")]
    got = {x.doc_id: x for x in lines.dedup_lines(frame(spark, rows)).collect()}
    assert [got[i].n_near for i in (1, 2, 3)] == [0, 1, 0] and got[2].text == "" and got[3].text == line + " y z"
    assert got[2**63 - 1].text == got[None].text == "a b"  # one id, one text: one document


@pytest.mark.parametrize("small", [True, False])
def test_lines(spark, docs, rows, none, small, monkeypatch):
    monkeypatch.setattr(lines, "STRETCH", 256 if small else 3)
    monkeypatch.setattr(common, "MANY", 3 if small else 4096)
    if not small:
        monkeypatch.setattr(lines, "BROADCAST_IDS", 0)
    r = random.Random(4)
    words = [f"v{i}" for i in range(30)]
    base = [[r.choice(words) for _ in range(n)] for n in (7, 8, 8, 9, 12, 3)]
    extra = []
    for i in range(60):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2])):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], [r.choice(words)], [w[k], r.choice(words)]])
        extra.append((1000 + i, " ".join(w) + "\nx\n\n" + " ".join(r.choice(base)).upper(), "en", "s"))
    some = [x for x in rows if x[1] is None or len(x[1]) < 5000] + extra
    expected = dedup_lines(some)
    got = lines.dedup_lines(frame(spark, some)).collect()
    assert len(got) == len(some)
    for x in got:
        assert (x.n_lines, x.n_exact, x.n_near, x.text) == expected[1 << 62 if x.doc_id is None else x.doc_id]
    assert sum(x.n_near for x in got) > 10
    if small:
        assert lines.dedup_lines(none).count() == 0
        assert lines.dedup_lines(docs).count() == len(rows)


@pytest.mark.parametrize("n", [1, 5])
def test_sharding(docs, rows, none, n):
    got = sharding.shard_by_bytes(docs, n).collect()
    assert len(got) == len(rows)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [float("inf") if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)
    most = max(r.size for r in got)
    sums = [sum(r.size for r in got if r.shard == s) for s in range(n)]
    assert all(abs(s - sum(sums) / n) <= most for s in sums)
    for s in range(n):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    import zlib

    by = {r[0]: r[1] for r in rows}
    assert all(r.size == len((by[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((by[r.doc_id] or "").encode()) for r in got)
    assert sharding.shard_by_bytes(none, n).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(docs, 0)


def nothing_small(monkeypatch):
    """As if no table were small enough to broadcast."""
    for module in (common, jac, lines, mixing, substrings):
        monkeypatch.setattr(module, "BROADCAST_IDS", 0)


def test_keys_of_many_rows(spark, monkeypatch):
    """The join is the same however many rows count as many; all rows come back once."""
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 7}") for i in range(60)] + [(99, None), (98, "none")], "id long, key string")
    keys = common.written(rows.where("key <> 'none'").groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("least")))
    got = {}
    for many in (1, 10, 4096):
        monkeypatch.setattr(common, "MANY", many)
        for how in ("inner", "left"):
            found = common.join_keys(rows, keys, F.col("key") == F.col("k"), "k", "m", how)
            assert found.columns == ["id", "key", "k", "least"]
            got.setdefault(how, []).append(sorted(map(tuple, found.collect()), key=str))
    assert all(x == v[0] for v in got.values() for x in v) and len(got["left"][0]) == 62 and len(got["inner"][0]) == 60


@pytest.mark.parametrize(("hot", "gram", "small"), [(512, 32, True), (2, 60, False)])
def test_substrings(spark, rows, hot, gram, small, monkeypatch):
    if not small:
        nothing_small(monkeypatch)
    elif hot == 512:
        monkeypatch.setattr(common, "MANY", 2)
    some = [r for r in rows if r[1] is None or len(r[1]) < 5000] + [(2**63 - 1, "the largest id " * 9, "en", "s")]
    expected = repeats(some)
    got = substrings.remove_repeats(frame(spark, some), hot=hot, gram=gram).collect()
    assert len(got) == len(some)
    assert sum(r.doc_id == 2**63 - 1 for r in got) == 1
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[1 << 62 if r.doc_id is None else r.doc_id], r.doc_id
    assert any(0 < r.n_removed < r.n_bytes for r in got)


def test_substrings_long_and_empty(docs, rows, none):
    got = substrings.remove_repeats(docs).collect()
    assert len(got) == len(rows) and substrings.remove_repeats(none).count() == 0
    by = {r[0]: r[1] for r in rows}
    long = [r for r in got if by[r.doc_id] == LONG + " end"][0]
    assert long.n_removed >= len(LONG) and long.n_bytes == len(LONG) + 4


def test_language(spark, rows, none):
    r = random.Random(1)
    made = {"aa": ["ba", "be", "bi", "bo"], "zz": ["ka", "ke", "ki", "ko"]}
    texts = [(i, " ".join("".join(r.choice(made[lang]) for _ in range(r.choice([1, 2, 3]))) for _ in range(30)), lang, "s") for i in range(200) for lang in [r.choice(["aa", "zz"])]]
    model = language.fit(frame(spark, texts[:120]))
    got = language.identify(frame(spark, texts[120:] + odd_rows()), model).collect()
    truth = {t[0]: t[2] for t in texts[120:]}
    assert len(got) == len(texts[120:]) + len(odd_rows())
    assert sum(truth.get(x.doc_id) == x.lang_pred for x in got if x.doc_id is not None and x.doc_id >= 120) >= 75
    by = {x[0]: x[1] for x in odd_rows()}
    for x in got:
        assert 0 <= x.score <= 1
        if x.doc_id is not None and x.doc_id < 120 and not language.words_of(by.get(x.doc_id)):
            assert (x.lang_pred, x.score) == ("und", 0.0)
    assert language.predict(tuple(model), ["bababebe"], {}, 20)[0][0] == "aa"  # by n-grams, as the word is new
    # every score by the definition, word by word
    for text, (lang, score) in zip([t[1] for t in texts[100:160]], language.predict(tuple(model), [t[1] for t in texts[100:160]], {}, 20)):
        words = language.words_of(text)
        rows = [model.word_logs[model.words[w]] if w in model.words else language.unseen(tuple(model), w) for w in words]
        s = [sum(float(r[k]) for r in rows) / len(words) * min(len(words), 20) for k in range(len(model.langs))]
        share = [math.exp(x - max(s)) for x in s]
        assert lang == model.langs[s.index(max(s))] and score == pytest.approx(max(share) / sum(share), rel=1e-5)
    kept = language.keep_identified(frame(spark, odd_rows()), model)
    assert kept.where("text IS NULL OR text = ''").count() == 0
    # a null id is trained on and not held out
    assert [x.h for x in frame(spark, [(None, "ba", "aa", "s")]).select(language.held_out().alias("h")).collect()] == [False]
    unfit = language.fit(none)
    assert {x.lang_pred for x in language.identify(frame(spark, texts[:3]), unfit).collect()} == {"und"}
    assert language.identify(none, model).count() == 0


def test_language_sample_bound(spark):
    texts = [(i, f"wort{i} haus", "de", "s") for i in range(300)]
    assert 0 < len(language.fit(frame(spark, texts), max_train=30, min_count=1).words) < 100


def test_mixing(docs, rows, none):
    got = mixing.mix(docs, block_words=16).collect()
    assert len(got) == len(rows)
    by = {r[0]: r for r in rows}
    assert all(x.size == len(spaced(by[x.doc_id][1])) and x.taken <= 2 * x.size for x in got)
    total = sum(x.size for x in got)
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    size = {s: sum(x.size for x in got if x.source == s) for s in sources}
    target, capped = {}, set()
    while True:
        left = 1.5 * total - sum(2 * size[s] for s in capped)
        weights = sum(weight[s] for s in sources if s not in capped)
        target = {s: 2.0 * size[s] if s in capped else left * weight[s] / weights for s in sources}
        over = {s for s in sources if target[s] > 2 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    for s in sources:
        mine = [x for x in got if x.source == s]
        assert mine[0].target == pytest.approx(target[s]) and mine[0].source_size == size[s]
        assert sum(x.taken for x in mine) == round(target[s])
    placed = docs.select("doc_id", "source", F.xxhash64(F.lit(7), "doc_id", "source").alias("place"), mixing.word_count(F.col("text")).alias("size")).collect()
    expected, _ = mixture([(x.place, x.doc_id, x.source, x["size"]) for x in placed], 16)
    assert sorted((str(x.doc_id), str(x.source), x.size, x.taken) for x in got) == sorted((str(x.doc_id), str(x.source), x["size"], t) for x, t in zip(placed, expected))
    again = mixing.mix(docs.repartition(7), block_words=16).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(none).count() == 0
    repeated = mixing.repeated(docs)
    assert repeated.columns == docs.columns and repeated.where("text IS NULL").count() == sum(r[1] is None for r in rows)


def test_schedule_is_even(spark):
    sizes = spark.createDataFrame([("a", 50_000), ("b", 20_000), (None, 9_000)], "source string, source_size long")
    slots = mixing.schedule(mixing.source_targets(sizes), 50).orderBy("slot").collect()
    share = sum(s.source == "a" for s in slots) / len(slots)
    for k in range(100, len(slots), 150):
        assert abs(sum(s.source == "a" for s in slots[:k]) - share * k) <= 6


def test_quality_counts(spark, docs, rows, none):
    got = perplexity.judge(docs).collect()
    assert len(got) == len(rows)
    by = {r[0]: r[1] for r in rows}
    for x in got:
        n, chars, symbols, dup, again = quality(by[x.doc_id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (n, chars, symbols, dup, again)
        assert x.base_failed == (n < 50 or 100 * again > 50 * n)
        assert not (x.base_failed and x.kept)
    assert perplexity.judge(none).count() == 0


def probabilities(texts, order):
    """Interpolated modified Kneser-Ney over characters by recursion: p(newest character | those before it)."""
    edge, tables = "\x01", {}
    spelt = [edge * (order - 1) + " ".join(spaced(t)) for t in texts if spaced(t)]
    tables[order] = Counter(t[i : i + order] for t in spelt for i in range(len(t) - order + 1))
    for n in range(order - 1, 0, -1):
        kinds, sums = Counter(g[1:] for g in tables[n + 1]), Counter()
        for g, c in tables[n + 1].items():
            sums[g[1:]] += c
        tables[n] = {g: sums[g] if n > 1 and g[0] == edge else kinds[g] for g in kinds}
    cuts = {n: perplexity.discounts_of(*(sum(c == k for c in t.values()) for k in (1, 2, 3, 4))) for n, t in tables.items()}
    after = {n: {} for n in tables}
    for n, t in tables.items():
        for g, c in t.items():
            after[n].setdefault(g[:-1], []).append(c)

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (len(tables[1]) + 1)
        follow, cut = after[n].get(g[:-1]), lambda c: cuts[n][min(c, 3) - 1]
        if not follow:
            return p(g[1:])
        c = tables[n].get(g, 0)
        return ((c - cut(c) if c else 0) + sum(map(cut, follow)) * p(g[1:])) / sum(follow)

    return p, spelt


def packed(text, order):
    low, high, inverse, _ = perplexity.grams([np.array([*map(ord, text)], np.uint32)], order)
    return low[inverse], high[inverse]


def test_kneser_ney_is_a_distribution(spark):
    """Probabilities after any context are those of the recursion, and sum to one over known characters and one for all others."""
    texts = ["abra kadabra abba bar", "kab a raba abra"] * 3 + ["karab dab", "ab", "b"]
    p, _ = probabilities(texts, 3)
    blocks = perplexity.fit(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), order=3)
    letters = sorted({c for t in texts for c in t})
    for context in ("\x01\x01", "\x01a", "ab", "br", "a ", "zz"):
        total = 0.0
        for c in [*letters, "?"]:
            got = math.exp(perplexity.log_probs(blocks, *packed(context + c, 3))[0])
            assert got == pytest.approx(p(context + c), rel=1e-4), (context, c)
            total += got
        assert total == pytest.approx(1.0, abs=1e-4), context


@pytest.mark.parametrize(("chunk", "held", "entries"), [(1_000_000, 1_500_000, 10**6), (50, 40, 300)])
def test_quality_scores(spark, rows, monkeypatch, chunk, held, entries):
    """Scores, bands and verdicts by brute force, however small the pieces, the tasks' tables and the blocks: nothing is pruned."""
    monkeypatch.setattr(perplexity, "CHUNK", chunk)
    monkeypatch.setattr(perplexity, "HELD", held)
    monkeypatch.setattr(perplexity, "WORD_BITS", 64 if chunk > 50 else 20)
    some = [r for r in rows if r[1] is None or len(r[1]) < 5000]
    some += [(500 + i, "".join(chr(0x4E00 + k * i % 50) for k in range(70)) + " \U0001f600 x" * (i % 3), "ja", "s") for i in range(8)]
    p, spelt = probabilities([r[1] for r in some], perplexity.ORDER)
    n = perplexity.ORDER
    docs = frame(spark, some)
    blocks = perplexity.fit(docs, max_entries=entries)
    assert (len(blocks) > 4) == (entries == 300)
    got = perplexity.judge(docs, max_entries=entries).collect()
    lang = {r[0]: r[2] for r in some}
    expected = {}
    for r in some:
        words = spaced(r[1])
        if words:
            t = "\x01" * (n - 1) + " ".join(words)
            letters = sum(map(len, words)) - sum(w.count(c) for w in words for c in "#*$%&|<>")
            expected[r[0]] = -sum(math.log(p(t[i : i + n])) for i in range(len(t) - n + 1)) / max(1, letters)
    half = lambda xs: sorted(xs)[(len(xs) + 1) // 2 - 1]
    for x in got:
        if x.doc_id not in expected:
            assert x.score is None and not x.kept
            continue
        assert x.score == pytest.approx(expected[x.doc_id], rel=1e-4)
        mine = [y.score for y in got if lang[y.doc_id] == lang[x.doc_id] and y.score is not None]
        mid = half(mine)
        dev = 1.4826 * half([abs(y - mid) for y in mine])
        assert (x.low, x.high) == pytest.approx((mid - max(0.1, 10 * dev), mid + max(0.1, 6 * dev)))
        assert x.kept == (not x.base_failed and x.low <= x.score <= x.high)


def test_quality_bands_reject_oddities(spark):
    r = random.Random(2)
    clean = lambda: " ".join("".join(r.choice(["ba", "ko", "ri"]) for _ in range(r.choice([2, 3]))) for _ in range(80))
    good = [(i, clean(), "en", "s") for i in range(150)]
    odd = [(1000 + i, " ".join("".join(r.choice("qxzjvw") for _ in range(6)) for _ in range(80)), "en", "s") for i in range(3)]
    odd += [(2000 + i, " ".join(w + r.choice("#*$%") * 3 for w in clean().split()), "en", "s") for i in range(12)]
    got = {x.doc_id: x for x in perplexity.judge(frame(spark, good + odd)).collect()}
    assert all(got[g[0]].kept or got[g[0]].base_failed for g in good) and not any(got[o[0]].kept for o in odd)


def test_word_ends_are_read_across(spark):
    """The same words in another order have another score: n-grams reach over the space."""
    words = ["lemo", "tiru", "sapa", "noke"]
    texts = [(i, " ".join(words * 15), "en", "s") for i in range(40)]
    salad = (99, " ".join(sorted(words * 15)), "en", "s")
    got = {x.doc_id: x.score for x in perplexity.judge(frame(spark, [*texts, salad])).collect()}
    assert got[99] > 1.2 * got[0]


LICENSED = [
    "Released under the MIT License. mit license", "Licensed under CC BY-NC 4.0.", "apache", "Licensed under the APACHE License, version 2.0", None, "", "general public license " * 3, LONG + " mit license " + LONG,
    "x " * 30 + licenses.TEMPLATES[7][1].replace("persons", "people") + "y " * 30, "x " * 30 + licenses.TEMPLATES[7][1][:400] + "y " * 30,
]


def test_licenses(spark, none):
    rows = [(i, t, "en", "s") for i, t in enumerate([*LICENSED, LICENSED[0]])]
    got = {x.doc_id: x for x in licenses.scan(frame(spark, rows)).collect()}
    for i, t in enumerate(LICENSED):
        words = folded(t)
        at = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        x = got[i]
        assert (x.n_words, x.n_base) == (len(words), len(at))
        assert (x.first_word, x.last_word) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert x.base_labels == ",".join(sorted({label for _, label in at}))
        assert set(x.base_labels.split(",")) - {""} <= set(x.labels.split(",")) and 0 <= x.score <= 1
    assert got[1].labels == "cc-by-nc" and got[3].labels == "apache" and got[8].labels == "mit" and 0.9 <= got[8].score < 1 and got[9].labels == got[2].labels == ""
    assert licenses.scan(none).count() == 0


@given(st.lists(st.sampled_from("abcdefghijk"), max_size=60), st.sampled_from([50, 70, 90, 100]), st.sampled_from([0, 25, 60]))
@settings(max_examples=150, deadline=None)
def test_set_join_is_exact(words, percent, slack):
    words = [w.encode() for w in words]
    templates = [("x", "a b c"), ("y", "d e f g d"), ("z", "h"), ("v", "a c e g i k b d")]
    frequency = {w: i for i, w in enumerate([b"c", b"g", b"a", b"h"])}
    index = licenses.Index(templates, frequency, percent, slack)
    expected = {}
    for t, (_, listed, n) in enumerate(licenses.template_sets(templates)):
        size = licenses.block_words(n, slack)
        most = max((len(set(words[s : s + size]) & set(listed)) for s in range(len(words))), default=0)
        if 100 * most >= percent * len(listed):
            expected[t] = most
    got = {}
    for t, at, common in index.blocks(words):
        size, own = index.size[t], {w for w, k in index.number.items() if k in index.sets[t]}
        assert len(set(words[at : at + size]) & own) == common
        got[t] = max(common, got.get(t, 0))
    assert got == expected


def test_license_filters_reject_and_lose_nothing():
    """Each filter turns away stretches that the one before let pass, and planted licenses with edits are found."""
    r = random.Random(3)
    filler = [f"f{i}" for i in range(300)]
    texts, planted = [], []
    for label, text in licenses.TEMPLATES:
        words = folded(text)
        for _ in range(8):
            edited = list(words)
            for k in r.sample(range(len(words)), len(words) // 20):  # 5 % of the words
                edited[k] = r.choice(filler)
            planted.append(label)
            texts.append([r.choice(filler) for _ in range(r.randrange(60))] + edited + [r.choice(filler) for _ in range(r.randrange(60))])
    some = [w for _, t in licenses.TEMPLATES for w in folded(t)]
    clean = [[r.choice(some) if r.random() < 0.5 else r.choice(filler) for _ in range(300)] for _ in range(60)]
    clean += [sorted(folded(t))[: len(folded(t)) * 2 // 3] + [r.choice(filler) for _ in range(80)] for _, t in licenses.TEMPLATES if len(folded(t)) > 30]
    frequency = Counter(w.encode() for t in texts + clean for w in set(t))
    index = licenses.Index(licenses.TEMPLATES, frequency, licenses.PERCENT, licenses.SLACK)
    for text, label in zip(texts, planted):
        assert label in {index.label[t] for t, _, _ in index.blocks([w.encode() for w in text])}
    assert not any(True for t in clean for _ in index.blocks([w.encode() for w in t]))
    steps = index.reached
    assert steps["prefix"] > steps["length"] > steps["positional"] > 0 and steps["positional"] >= steps["found"] > 0


def test_jaccard(docs, rows, none):
    got = jac.jaccard_groups(docs).collect()
    assert len(got) == len(rows)
    expected = jaccard(rows)
    for x in got:
        assert x.component_id == (None if x.doc_id is None else expected[x.doc_id]), x
    assert jac.jaccard_groups(none).count() == 0


def test_jaccard_keeps_one(spark, docs, rows, none):
    kept = jac.keep_one(docs)
    assert kept.columns == docs.columns and jac.keep_one(none).count() == 0
    kept = kept.collect()
    expected = jaccard([(i, *r[1:]) for i, r in enumerate(rows)])
    key = lambda x: (x[0], x[1])
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(expected[i], []).append(key(r))
    left = Counter(key(x) for x in kept)
    assert len(kept) == len(groups) and sum(left.values()) == len(kept)
    ids = Counter(r[0] for r in rows)
    for group in groups.values():
        alone = [k for k in group if k[0] is not None and ids[k[0]] == 1]
        assert any(left[k] for k in ([min(alone)] if alone else group)), group
    # an id with two texts: the copy goes, the other text stays
    twice = [(1, LONG[:900], "en", "s"), (2, LONG[:900], "en", "s"), (2, "another text of its own", "en", "s"), (None, "no id", "en", "s"), (None, "no id", "en", "s")]
    assert sorted(((x.doc_id, x.text) for x in jac.keep_one(frame(spark, twice)).collect()), key=str) == sorted([twice[0][:2], twice[2][:2], twice[3][:2]], key=str)
    assert sorted(x.text[:4] for x in jac.keep_one(frame(spark, [*twice, (2**63 - 1, "last", "en", "s")])).collect()) == ["anot", "last", "no i", "w0 w"]


def test_jaccard_blocks_skip_and_lose_nothing(spark):
    """Of one list's pairs, blocks leave those that positions and sizes allow, and some of the others are never made."""
    r = random.Random(9)
    rows = [(i, n, i, r.randrange(n - (85 * n + 99) // 100 + 1), t, 400) for i in range(400) for n in [r.randrange(20, 400)] for t in [1]]
    kept = spark.createDataFrame(rows, "id long, n long, f long, p int, t long, m long")
    allowed = {(x.id, x.id2) for x in jac.met(kept, 85).where(jac.reachable(85)).collect()}
    pairs = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[1] >= b[1] and 100 * b[1] >= 85 * a[1] and min(a[1] - a[3], b[1] - b[3]) * 185 >= 85 * (a[1] + b[1]) and b[3] <= b[1] - -(-170 * b[1] // 185)}
    assert allowed == pairs and len(pairs) > 100
    made = jac.met(kept, 85).count()
    assert made < len(rows) ** 2 / 10
    parts = {(x.id, x.id2) for x in jac.met(kept.withColumn("m", F.lit(5000)), 85).where(jac.reachable(85)).collect()}
    assert parts == pairs


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_near_threshold(spark, seed, monkeypatch):
    """Families of copies with all degrees of change, and few enough heavy elements to need whole sets."""
    monkeypatch.setattr(jac, "HEAVY", 3)
    monkeypatch.setattr(common, "MANY", 4096 if seed else 1)
    if seed:
        nothing_small(monkeypatch)
        monkeypatch.setattr(jac, "MAX_HEAVY", 0)
        monkeypatch.setattr(jac, "SHORT", 0)
        monkeypatch.setattr(jac, "BLOCK", 2)
    r = random.Random(seed)
    rows, i = [], 0
    for _ in range(5):
        base = [f"t{r.randrange(60)}" for _ in range(r.choice([6, 25, 60, 90]))]
        for _ in range(14):
            w = list(base)
            for _ in range(r.randrange(0, 7)):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randrange(2)] = [f"t{r.randrange(60)}"] * r.randrange(2)
            rows.append((i, " ".join(w), "en", "s"))
            i += 1
    rows += [(i + k, rows[3][1], "en", "s") for k in range(6)]
    expected = jaccard(rows)
    got = {x.doc_id: x.component_id for x in jac.jaccard_groups(frame(spark, rows)).collect()}
    assert got == expected and len(set(expected.values())) > 8


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 100)] + [(300, x) for x in range(301, 330)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[200] == got[102] == 100 and got[329] == 300
