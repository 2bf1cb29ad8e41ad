import pandas as pd

from tidemill.llm.q_toxicity import op4_toxicity
from tidemill.llm.toxicity import Lexicon, fit, fold, reject_toxic, score_column


def test_fold():
    assert fold("Id10t! MОRОN, m0r0n") == " idiot moron moron "  # Cyrillic О
    assert fold(None) == " " == fold("") == fold("!!! 123"[:3])


def test_exception_takes_weight_back():
    lexicon = Lexicon(terms={" trash ": 5.0}, exceptions={" trash can ": 5.0})
    automaton = lexicon.automaton()
    total = lambda text: sum(w for _, w in automaton.iter(fold(text)))
    assert total("you trash person") == 5.0 and total("a trash can here") == 0.0


def test_learns_and_holds_out(spark):
    rows = [(i, f"some plain words here {'you grobnik' if i % 3 == 0 else 'you friend'} number{i}", int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    from tidemill.llm.common import Scratch

    lexicon = fit(docs, labels, Scratch(spark, "t"))
    assert any(t.startswith(" gro") for t in lexicon.terms)
    new = spark.createDataFrame([(1, "that gr0bnik again"), (2, "a friend again"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.s for r in new.select("doc_id", score_column(lexicon)["score"].alias("s")).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] < 0.5
    assert {r.doc_id for r in reject_toxic(new, lexicon).collect()} == {2, 3, 4}


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    got = op4_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97
    assert held[held.toxic == 1].score.mean() > 0.7 > 0.1 > held[held.toxic == 0].score.mean()
    assert got.score.between(0, 1).all()


def test_odd_rows(odd, none, spark, scratch):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = fit(odd, labels, scratch)
    out = reject_toxic(odd, lexicon)
    assert out.columns == odd.columns and out.count() <= 13
    assert reject_toxic(none, lexicon).count() == 0
    empty = fit(none, labels.limit(0), scratch)
    assert not empty.terms and reject_toxic(odd, empty).count() == 13
