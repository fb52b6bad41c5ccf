"""Every query with SQL equals it, over the smallest tables; the entry runs."""

import os

import duckdb
import pytest

from rillgraph import gallery

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


def plain(df):
    keys = sorted(df.columns)
    return df[keys].astype(str).replace({"None": "nan", "NaN": "nan", "<NA>": "nan", "-0.0": "0.0"}).sort_values(keys).reset_index(drop=True)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(gallery.ORACLES))
def test_query_equals_sql(spark, tables, name):
    got, expected = plain(gallery.QUERIES[name](spark, SF).toPandas()), plain(tables.sql(gallery.ORACLES[name]).df())
    assert list(got.columns) == list(expected.columns) and len(got) == len(expected)
    assert (got == expected).all().all()


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["event_id", "spread", "ewma"] and df.count() == 1000
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def written(spark, folder, values):
    """Events of one user in order, (type, value); the folder and a connection that has them."""
    rows = [(i, i, 1, kind, value) for i, (kind, value) in enumerate(values)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double")
    df.selectExpr("event_id", "cast(timestamp_seconds(s) as timestamp_ntz) as ts", "user_id", "event_type", "value").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return str(folder), con


def agrees(spark, folder, con, name):
    got, expected = plain(gallery.QUERIES[name](spark, folder).toPandas()), plain(con.sql(gallery.ORACLES[name]).df())
    assert len(got) == len(expected) and got.to_dict("list") == expected.to_dict("list")
    return got


def test_harmonic_mean_of_a_zero_equals_sql(spark, tmp_path):
    values = [("view", 2.0), ("click", 0.0), ("purchase", 4.0), ("click", 3.0), ("view", -0.0), ("purchase", 0.0), ("view", -3.0), ("purchase", 1.0)]
    folder, con = written(spark, tmp_path, values)
    assert list(agrees(spark, folder, con, "harmonic_mean")["harmonic_mean"]).count("nan") == 3  # two rows without all legs, and inf - inf


def test_log_return_at_zeros_equals_sql(spark, tmp_path):
    values = [("view", v) for v in (2.0, 0.0, 3.0, 0.0, 0.0, -0.0, 4.0, None, 5.0, -1.0, -2.0, 2.0, float("inf"), float("nan"), 1.0, 2.0)]
    folder, con = written(spark, tmp_path, values)
    agrees(spark, folder, con, "log_return")
    # NaN and null apart, too
    got = {r["event_id"]: r["log_return"] for r in gallery.QUERIES["log_return"](spark, folder).collect()}
    expected = dict(con.sql(gallery.ORACLES["log_return"]).fetchall())
    assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in expected.items()} and str(got[4]) == "nan"


def zeros_of_the_stress_graph():
    return [("view", 2.0), ("click", 0.0), ("purchase", 4.0), ("view", 3.0), ("error", 1.0), ("view", 0.0), ("click", 5.0), ("view", -5.0), ("view", 6.0), ("click", -0.0), ("view", 1.0)]


def test_incremental_stress_graph_at_zeros_equals_sql(spark, tmp_path):
    folder, con = written(spark, tmp_path, zeros_of_the_stress_graph())
    final = list(agrees(spark, folder, con, "stress_incremental")["final"])
    assert final.count("nan") == 3 and {"inf", "-inf"} & set(final)  # two rows without all sources, and 0 / 0


def test_stress_template_at_zeros_equals_sql(spark, tmp_path):
    folder, con = written(spark, tmp_path, zeros_of_the_stress_graph())
    agrees(spark, folder, con, "stress_template")


def test_stress_template_at_halves_equals_sql(spark, tmp_path):
    """The seventh row's average is 66.8405895, whose last place SQL rounds down."""
    values = [("click", 112.48), ("purchase", 31.3), ("view", 27.46), ("error", 1.0), ("purchase", 192.05), ("view", 4.7), ("error", 1.0), ("purchase", 49.13), ("click", 96.83)]
    folder, con = written(spark, tmp_path, values)
    assert "66.840589" in list(agrees(spark, folder, con, "stress_template")["smooth"])
