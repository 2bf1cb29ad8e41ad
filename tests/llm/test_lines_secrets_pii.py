import duckdb
import pytest

from tidemill.llm import pii
from tidemill.llm.line_dedup import boilerplate, dedup_lines, lines_of
from tidemill.llm.q_line_dedup import SQL, op3_line_dedup
from tidemill.llm.q_pii import op2_pii_surrogates
from tidemill.llm.q_secrets import op5_secret_scan
from tidemill.llm.secrets import BESIDE, candidates, scan


def test_lines_match_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(SQL["op3_line_dedup"]).df().sort_values("doc_id").reset_index(drop=True)
    got = op3_line_dedup(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns].to_numpy() == want.to_numpy()).all()


def test_near_threshold_is_exact(spark, scratch):
    rows = [(i, f"nine\nten\nmany\nown {i}", f"s{i}") for i in range(60)]
    rows = [(i, "\n".join(x for x in t.split("\n") if not (x == "nine" and i >= 9 or x == "ten" and i >= 10)), s) for i, t, s in rows]
    found = boilerplate(lines_of(spark.createDataFrame(rows, "doc_id long, text string, source string")), scratch).collect()
    assert sorted((r.sites, r.exact) for r in found) == [(10, True), (60, False)]


def test_lines_odd_rows(odd, none, scratch):
    got = dedup_lines(odd, scratch, min_sites=2).toPandas()
    assert len(got) == 13 and list(got.columns)[: len(odd.columns)] == odd.columns
    assert got[got.doc_id == 1].line_text.tolist() == [""] and got[got.doc_id == 4].line_text.isna().all()
    assert got[got.doc_id == 5].line_text.tolist() == [" \t\n "]
    assert dedup_lines(none, scratch).count() == 0


def test_secrets(spark, scratch):
    rows = [(i, f'key AKIA{i:06d}QWERTYUIOP here token = "a{i:05d}b61fedef2798093a39309a7b84b6ac51" and averylongplainwordindeed 4663622617512{i:03d}') for i in range(80)]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string"), scratch).toPandas()
    kind = got.value.str[:4].where(got.value.str.startswith("AKIA"), got.value.str.len().astype(str))
    assert got[got.value.str.startswith("AKIA")].secret.all() and got[got.value.str.startswith("a0")].secret.all()
    assert not got[got.value.str.isdigit() | got.value.str.isalpha()].secret.any() and kind.nunique() > 2


def test_secrets_on_tables(spark, sf_dir, odd, none, scratch):
    got = op5_secret_scan(spark, sf_dir.replace("sf0.001", "sf0.01")).toPandas()
    assert 0 < got.secret.sum() < len(got) and got.score.between(0, 1).all()
    assert not scan(odd, scratch).where("secret").count() and scan(none, scratch).count() == 0


@pytest.mark.parametrize("text", ["mail bob.22@mail7.example.com or +1 (269) 555-3296, 4738745156746829, 42.144.35.254", "Mr. John Smith and Frau Anna Weber, 123-45-6789"])
def test_surrogates_keep_form(text):
    new, n = pii.replace(text, "k")
    spans, others = pii.detect(text), pii.detect(new)
    assert n == len(spans) == len(others) and [k for _, _, k, _ in spans] == [k for _, _, k, _ in others]
    for (a, b, kind, _), (c, d, _, _) in zip(spans, others):
        assert text[a:b] != new[c:d]
        if kind not in ("name", "email", "ip"):
            assert [x.isdigit() for x in text[a:b]] == [x.isdigit() for x in new[c:d]]
    assert pii.replace(text, "k") == (new, n) != pii.replace(text, "other key")


def test_permutation_is_one_to_one():
    for n in (3, 4):
        assert len({pii._permute(str(i).zfill(n), "k", "x", 0) for i in range(10**n)}) == 10**n
    assert pii.surrogate("name", "f:Anna Weber", "k").split(":")[1].split()[0] in pii.GIVEN["latin", "f"]
    assert pii.surrogate("name", "m:Иван Белов", "k").split(":")[1].split()[0] in pii.GIVEN["cyrillic", "m"]


def test_collisions_are_settled(spark, scratch):
    names = [("name", f"m:Name{i} Surname{i}") for i in range(700)]  # as many as there are combinations, nearly
    got = pii.settle(spark.createDataFrame(names, "kind string, canon string"), "k", scratch).collect()
    assert len({r.surrogate for r in got}) == 700 and max(r.attempt for r in got) > 0
    assert not {r.surrogate for r in got} & {r.canon for r in got}


def test_pii_on_tables(spark, sf_dir, odd, none, scratch):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op2_pii_surrogates(spark, sf).collect():
        real = {c for _, _, _, c in pii.detect(old[r.doc_id])}
        assert r.n_entities == len(pii.detect(old[r.doc_id])) and (r.text == old[r.doc_id]) == (r.n_entities == 0)
        assert not real & {c for _, _, _, c in pii.detect(r.text)}
    got = pii.anonymise(odd, "k", scratch).collect()
    assert len(got) == 13 and all(r.pii_text == r.text and r.pii_count == 0 for r in got)
    assert pii.anonymise(none, "k", scratch).count() == 0


def test_prefilter_keeps_all_that_detect_finds(spark, scratch):
    """Texts whose only entity follows a capitalised or upper-case title that isn't ASCII, or has other digits."""
    texts = ["Господин Иванов пришёл", "ГОСПОЖА Иванова", "SEÑORA Gomez", "Señor Perez", "Monſieur Petit", "Mıss Gray", "mİss Gray", "Tel. (٢٦٩) ٥٥٥-٣٢٩٦", "x-Господин Белов", "+\U00011F51 \U00011F52\U00011F56\U00011F59 \U00011F55\U00011F55"]
    assert all(len(pii.detect(t)) == 1 for t in texts)
    got = pii.anonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k", scratch).collect()
    assert len(got) == len(texts) and all(r.pii_count == 1 and r.pii_text != r.text for r in got)


def test_more_entities_than_a_format_has_values(spark, scratch):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [("email", f"{a}@{b}{c}.com") for a in letters for b in letters for c in letters[:3]] + [("email", f"_@{a}.de") for a in letters]
    rows += [("name", f"m:Person{i}") for i in range(4000)] + [("name", f"f:Женщина{i}") for i in range(1000)]
    rows += [("phone", f"1{i:04d}") for i in range(9990)]
    got = pii.settle(spark.createDataFrame(rows, "kind string, canon string"), "k", scratch).collect()
    assert len({(r.kind, r.surrogate) for r in got}) == len(rows) == len(got)
    assert not {(r.kind, r.surrogate) for r in got} & set(rows)
    for r in got:
        if r.kind == "email":
            assert pii.detect(r.surrogate) == [(0, len(r.surrogate), "email", r.surrogate)]
        elif r.kind == "name":
            assert pii.detect("Herr " + pii.dress("X", "name", r.surrogate))[0][1] == 5 + len(r.surrogate) - 2


def test_mentions_of_one_person(spark, scratch):
    texts = [
        "Mr. John Smith came. Mr. Smith left, said Smith's wife; JOHN SMITH and John Smith too.",
        "Dr. Anna Weber wrote. Frau Anna Weber sent it; later Anna Weber and Weber signed.",
        "Dr. Anna Weber again",
        "Госпожа Анна Иванова и Dr. Иванова, потом Анна Иванова.",
    ]
    assert [len(pii.detect(t)) for t in texts] == [5, 4, 1, 3]
    got = [r.pii_text for r in pii.anonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k", scratch).orderBy("doc_id").collect()]
    assert not any(w in t for t in got for w in ("Smith", "SMITH", "Weber", "Иванова"))
    _, first, last = got[0].split(" came")[0].split()
    assert got[0] == f"Mr. {first} {last} came. Mr. {last} left, said {last}'s wife; {first.upper()} {last.upper()} and {first} {last} too."
    first, last = got[1].split(" wrote")[0].split()[1:]
    assert got[1] == f"Dr. {first} {last} wrote. Frau {first} {last} sent it; later {first} {last} and {last} signed."
    assert first in pii.GIVEN["latin", "f"] and got[2].split()[2] == last
    first, last = got[3].split(" и ")[0].split()[1:]
    assert got[3] == f"Госпожа {first} {last} и Dr. {last}, потом {first} {last}." and last.endswith("а")


def test_written_forms_differ(spark, scratch):
    """The title's gender isn't written: surrogates differ without it."""
    texts = [f"{t} {g}{k} Same" for t in ("Herr", "Dr.", "Frau") for g in ("Kim", "Jo", "Al") for k in range(30)]
    got = pii.anonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k", scratch).collect()
    assert len({r.pii_text.split(maxsplit=1)[1] for r in got}) == len(texts)


def test_every_place_of_a_secret(spark, scratch):
    key = "a0f1b61fedef2798093a39309a7b84b6"
    texts = [f"sha256 {key} of it. Later token = {key} and 😀 xx{key}: {key}", f"{key}", f"{key} {key}", "pwd: 'hunter2x' and PASSWORD=Tr0ub4dor&3 end", "no candidate", "", " ".join(f"pwd:{i:06d}x" for i in range(50)), None]
    got = candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert texts[r.doc_id][r.start : r.start + len(r.value)] == r.value
        assert r.before == texts[r.doc_id][max(0, r.start - BESIDE) : r.start] and r.after == texts[r.doc_id][r.start + len(r.value) :][:BESIDE]
    count = {k: sum(r.doc_id == k for r in got) for k in range(len(texts))}
    assert count == {0: 4, 1: 1, 2: 2, 3: 2, 4: 0, 5: 0, 6: 50, 7: 0}
    assert {r.value for r in got if r.doc_id == 3} == {"hunter2x", "Tr0ub4dor&3"}
    rows = [(i, f"sha256 {i:04d}{key} is the checksum of the file that was sent to the others here. Later we set token = {i:04d}{key} again; pwd=short{i:03d}") for i in range(80)]
    scored = scan(spark.createDataFrame(rows, "doc_id long, text string"), scratch).toPandas()
    assert len(scored) == 240 and scored[scored.start > 50].secret.all() and not scored[scored.start < 50].secret.any()
