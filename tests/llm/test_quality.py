import duckdb

from tidemill.llm.q_quality import SQL, op9_quality_rules
from tidemill.llm.quality import METRICS, host_verdicts, quality


def test_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(SQL["op9_quality_rules"]).df().sort_values("doc_id").reset_index(drop=True)
    got = op9_quality_rules(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns].to_numpy() == want.to_numpy()).all()


def test_bad_host_goes_small_host_is_shrunk(spark):
    rows = [("bad", True)] * 60 + [("bad", False)] * 5 + [("tiny", True)] + [("good", False)] * 200 + [(None, False)] * 50
    got = {r._host: r for r in host_verdicts(spark.createDataFrame(rows, "source string, base_failed boolean")).collect()}
    assert not got["bad"].host_kept and got["good"].host_kept and got[None].host_kept
    assert got["tiny"].host_rate < 1


def test_odd_rows(odd, none, scratch):
    got = quality(odd, scratch).toPandas()
    assert len(got) == 13 and got[METRICS].notna().all().all()
    assert got[got.doc_id == 6].n_words.tolist() == [40_000]
    assert got[got.doc_id.isin([3, 4, 5])].n_words.eq(0).all() and got[got.doc_id == 5].base_failed.all()
    assert quality(none, scratch).count() == 0


def test_repeated_words(spark, scratch):
    text = "a b c x a b c y z z z z\n\nline one\nline one\n line one"
    got = quality(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string"), scratch).first()
    assert (got.n_words, got.n_dup_lines, got.n_symbols) == (18, 1, 0)
    assert got.n_repeat_words == 6 + 4 + 6
