import duckdb
import pytest

from tidemill.llm.mixing import mix, plan_mix
from tidemill.llm.q_mixing import SQL, op1_mixing


def test_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(SQL["op1_mixing"]).df().sort_values("doc_id").reset_index(drop=True)
    got = op1_mixing(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns].to_numpy() == want.to_numpy()).all()


def test_near_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = plan_mix(docs).toPandas()
    per = got.groupby("source").agg(taken=("mix_taken", "sum"), target=("mix_target", "first"), top=("mix_size", "max"))
    assert ((per.taken - per.target).abs() <= 2 * per.top + 0.05 * per.target).all()
    assert (got.mix_taken <= 3 * got.mix_size).all()
    assert abs(per.target.sum() - got.mix_size.sum()) < 1e-6 * got.mix_size.sum()


def test_odd_rows(odd):
    got = plan_mix(odd).toPandas()
    assert len(got) == 13 and set(odd.columns) < set(got.columns)
    assert got[got.text.isna()].mix_size.eq(0).all()
    again = plan_mix(odd.repartition(7)).toPandas()
    key = ["doc_id", "text", "source", "mix_copies"]
    assert sorted(map(str, got[key].to_numpy().tolist())) == sorted(map(str, again[key].to_numpy().tolist()))


def test_mix_repeats_rows(odd):
    planned = plan_mix(odd).agg({"mix_copies": "sum"}).first()[0]
    out = mix(odd)
    assert out.count() == planned and out.columns == odd.columns


def test_empty(none):
    assert plan_mix(none).count() == 0 and mix(none).count() == 0


@pytest.mark.parametrize("cap", [1.0, 3.0])
def test_cap(spark, cap):
    docs = spark.createDataFrame([(i, "a b c d", "x" if i < 90 else "y") for i in range(100)], "doc_id long, text string, source string")
    got = plan_mix(docs, cap=cap).toPandas()
    assert (got.mix_copies <= cap).all()
    target = got.groupby("source").mix_target.first()
    assert target["y"] == pytest.approx(min(cap * 40, target["y"])) and target["x"] <= cap * 360
