"""The feature vector and the purged cross-validation against hand examples and brute force."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions.distributions import t_two_sided
from tidemill.operators import features as feat
from tidemill.operators import meta


def days(spark, counts):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=k)) for i, n in counts.items() for k in range(n)]
    return spark.createDataFrame(rows, "instrument string, ts timestamp_ntz")


@pytest.mark.parametrize("n", [6, 7, 40, 41])
def test_roles_match_brute_force(spark, n):
    placed, paths = meta.cpcv_roles(days(spark, {"a": n, "b": 3}))
    got = placed.select("instrument", "_n", *[c.alias(f"{r}{k}") for k, roles in paths.items() for r, c in zip(("test", "train"), roles)]).collect()
    size = n // 6
    groups = [range(g * size, n if g == 5 else (g + 1) * size) for g in range(6)]
    assert len(paths) == 15
    for k, combo in enumerate(itertools.combinations(range(6), 2)):
        test = {i for g in combo for i in groups[g]}
        shut = {i + d for i in test for d in range(-5, 3)}
        for row in got:
            if row.instrument == "b":
                assert not row[f"test{k}"] and not row[f"train{k}"]
            else:
                assert row[f"test{k}"] == (row["_n"] in test)
                assert row[f"train{k}"] == (row["_n"] not in test | shut)


def test_report(spark):
    rng = np.random.default_rng(5)
    paths = {k: rng.normal(0.002, 0.01, 60) for k in range(4)} | {4: np.zeros(60)}
    rows = spark.createDataFrame([(k, float(r)) for k, v in paths.items() for r in v], "path int, r double")
    got = meta.cpcv_report(rows).first()
    sharpes = np.array([v.mean() / v.std() * np.sqrt(252) if v.std() > 0 else 0.0 for v in paths.values()])
    t = sharpes.mean() / sharpes.std(ddof=1) * np.sqrt(5)
    two = t_two_sided(t, 4)
    assert got.paths == 5
    assert got.sharpe_mean == pytest.approx(sharpes.mean()) and got.sharpe_std == pytest.approx(sharpes.std(ddof=1))
    assert got.t == pytest.approx(t) and got.p == pytest.approx(two / 2 if t > 0 else 1 - two / 2)
    assert 0 < got.psr < 1


def test_report_of_equal_paths_and_of_none(spark):
    same = spark.createDataFrame([(k, 0.0) for k in range(3)], "path int, r double")
    assert meta.cpcv_report(same).first()[:5] == (3, 0.0, 0.0, 0.0, 1.0)
    assert meta.cpcv_report(same.where("path > 5")).first().paths == 0


def test_vector_defaults_order_and_least_days(spark):
    rows = days(spark, {"a": 5, "b": 2})
    forecasts = rows.where("instrument = 'a'").select("instrument", "ts", F.lit(0.3).alias("p50"), F.lit(0.5).alias("spread"), F.lit(0.01).alias("sigma"), F.when(F.dayofmonth("ts") == 3, "EFFICIENT").when(F.dayofmonth("ts") == 4, "odd").alias("structure"))
    got = feat.feature_vector(rows, feat.forecast_part(forecasts), least_bars=3)
    assert got.columns == ["instrument", "ts", *feat.VECTOR] and len(feat.VECTOR) == 25
    found = sorted(got.collect(), key=lambda r: r.ts)
    assert [r.ts.day for r in found] == [3, 4, 5] and {r.instrument for r in found} == {"a"}
    assert [r.structure_code for r in found] == [0.0, -1.0, -1.0]
    assert found[0].rsi_14 == 50.0 and found[0].body_pct_of_range == 0.5 and found[0].vpin == 0.0
    assert [(r.day_of_week, r.is_friday) for r in found] == [(2.0, 0.0), (3.0, 0.0), (4.0, 1.0)]


def test_days_in_regime(spark):
    rows = days(spark, {"a": 5}).withColumn("state", F.element_at(F.array(*[F.lit(x) for x in (0, 0, 2, 2, 0)]), F.dayofmonth("ts")))
    got = feat.regime_part(rows).orderBy("ts").collect()
    assert [(r.regime_state, r.days_in_regime) for r in got] == [(0, 1), (0, 2), (2, 1), (2, 2), (0, 1)]


def test_buckets_and_book_known_at_each_day(spark):
    two = days(spark, {"a": 4})
    at = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
    buckets = spark.createDataFrame([("a", 0, 8.0, 2.0, at(2)), ("a", 1, 5.0, 5.0, at(2)), ("a", 2, 0.0, 10.0, at(3, 12)), ("b", 0, 1.0, 9.0, at(1))], "instrument string, bucket long, buy double, sell double, close_ts timestamp_ntz")
    got = {r.ts.day: r.vpin for r in feat.bucket_part(two, buckets, last=2).collect()}
    assert got == {1: None, 2: pytest.approx(0.3), 3: pytest.approx(0.3), 4: pytest.approx(0.5)}
    book = spark.createDataFrame([("a", at(3), -0.25)], "instrument string, ts timestamp_ntz, imbalance_l1 double")
    rows = sorted(feat.feature_vector(two, feat.bucket_part(two, buckets, last=2), feat.book_part(book)).collect(), key=lambda r: r.ts)
    assert [(r.vpin, r.book_imbalance) for r in rows] == [(0.0, 0.0), (pytest.approx(0.3), 0.0), (pytest.approx(0.3), -0.25), (pytest.approx(0.5), 0.0)]


def test_labelled_rows_are_stored(spark, sf_dir):
    """A fit that reads them again doesn't aggregate the lines again; the rows are those of the operators."""
    from tidemill.plans.p_decisions import decided
    from tidemill.plans.p_meta import labelled
    from tidemill.sources.tables import daily_bars

    got = labelled(spark, sf_dir)
    assert got.inputFiles() and not [f for f in got.inputFiles() if "lineitem" in f]
    want = meta.training_rows(decided(spark, sf_dir), daily_bars(spark, sf_dir))
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
