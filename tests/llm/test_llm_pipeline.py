"""The pipeline over odd rows and over the smallest tables, stage by stage."""

import os
import shutil
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest
from helpers import contaminated, frame, jaccard, mixture, odd_rows, spaced
from pyspark.sql import functions as F

import corpus_pipeline
from rillgraph.llm import language
from rillgraph.llm.common import written

SF = "/root/testdata/sf0.001"
ROOT = str(Path(__file__).resolve().parents[2])


def test_stages_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    full = frame(spark, odd_rows())
    for df in (full, full.where("false")):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            before = docs.count()
            docs = stage(spark, docs, str(tmp_path))
            docs.write.parquet(str(tmp_path / f"{name}-{before}"), mode="overwrite")
            docs = spark.read.parquet(str(tmp_path / f"{name}-{before}"))
            if name != "sharding":
                assert docs.columns == corpus_pipeline.COLUMNS
            if name in ("language_id", "jaccard_join", "decontamination"):
                assert docs.count() <= before
        assert {"doc_id", "shard", "slot"} <= set(docs.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_run(spark):
    """Every stage by brute force over all that the one before kept, and run() by all of them."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got, docs = {}, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        got[name] = docs.collect()

    held_out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    model = language.fit(spark.createDataFrame([r for r in rows if not held_out(r[0])], "doc_id long, text string, lang string, source string, n_chars long"))
    found = language.predict(tuple(model), [r[1] for r in rows], {}, 20.0)
    rows = [r for r, (lang, score) in zip(rows, found) if lang != "und" and score >= 0.4]
    assert Counter(map(tuple, got["language_id"])) == Counter(rows) and len(rows) > 100
    first = jaccard(rows)
    rows = [r for r in rows if first[r[0]] == r[0]]
    assert Counter(map(tuple, got["jaccard_join"])) == Counter(rows)
    rows = [r for r in rows if not contaminated(r[1], items)[1]]
    assert Counter(map(tuple, got["decontamination"])) == Counter(rows)
    frame_of = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    place = {r[0]: r[1] for r in frame_of.select("doc_id", F.xxhash64(F.lit(7), "doc_id", "source")).collect()}
    sizes = [len(spaced(r[1])) for r in rows]
    taken, _ = mixture([(place[r[0]], r[0], r[3], n) for r, n in zip(rows, sizes)])
    rows = [r for r, n, t in zip(rows, sizes, taken) for _ in range(int(t / n + 0.5) if n else 1)]
    assert Counter(map(tuple, got["mixing"])) == Counter(rows)
    order = sorted((r[0], len(r[1].encode()) + 8, zlib.crc32(r[1].encode())) for r in rows)
    total, upto, expected, slots = sum(x[1] for x in order), 0, [], Counter()
    for i, size, crc in order:
        upto += size
        shard = min(23, int((upto - size / 2) * 24.0 / total))
        expected.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
    assert sorted(map(tuple, got["sharding"])) == sorted(expected)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(expected)


SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # the driver's path alone
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
def found(batches):
    import pyarrow as pa
    for b in batches:
        try:
            import rillgraph
            yield pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])
        except ImportError:
            pass
assert spark.range(1).mapInArrow(found, "n long").count() == 0
import __spark_entry__
for name in ("op1_decontamination", "op2_html_extraction", "op6_language_id", "op8_quality_rules", "op9_license_scans"):
    assert __spark_entry__.queries()[name](spark, {sf!r}).count() > 0
print("all ran")
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_workers_need_not_have_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, sf=SF)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "all ran" in out.stdout, out.stderr[-3000:]


def test_the_rest_without_optional_modules(tmp_path):
    """Without a library that the operators need, or with an empty folder in their place, the other queries are there."""
    blocked = "import sys; sys.modules['xxhash'] = None; sys.path.insert(0, {!r}); import __spark_entry__ as e; q = e.queries(); print('sma' in q, 'op10_jaccard_join' in q, 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", blocked.format(ROOT)], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "False", "False"], out.stderr[-2000:]
    shutil.copytree(f"{ROOT}/rillgraph", tmp_path / "rillgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    for empty in (False, True):
        if empty:
            (tmp_path / "rillgraph" / "llm").mkdir()
        out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q) > 55, 'pipeline' in q)"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
        assert out.stdout.split() == ["True", "False"], out.stderr[-2000:]
