"""Every pipeline stage against its operator's brute-force version, on its own input."""

import corpus_pipeline as P
from hourcast.llm.common import documents, shared_table
from tests.llm.test_models import brute_matches, tokens_of
from tests.llm.test_near_duplicates import brute_jaccard, brute_lines

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark):
    docs = documents(spark, SMALL)
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in P.STAGES:
        out = shared_table(stage(spark, docs, SMALL), name)
        rows = out.collect()
        texts = [(k, r.text) for k, r in before.items()]
        if name == "language_id":
            clean = [k for k, t in texts if t and len(t.split()) >= 5]
            assert {r.doc_id for r in rows} >= set(clean) and all(r == before[r.doc_id] for r in rows)
        elif name == "line_dedup":
            want = {k: t for k, t in brute_lines(texts).items() if t.strip() or t == before[k].text}
            assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_duplicates":
            want = {k for k, (_, c) in brute_jaccard(texts, 5, 80).items() if k == c}
            assert {r.doc_id for r in rows} == want and all(r == before[r.doc_id] for r in rows)
        elif name == "decontamination":
            leaks = {k for k, _ in brute_matches(texts, items)}
            assert leaks and {r.doc_id for r in rows} == before.keys() - leaks
        else:
            ids = dict(zip(before, tokens_of([r.text for r in before.values()])))
            got = {k: b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)) for k in ids}
            assert got == {k: v.tobytes() for k, v in ids.items()}
            break
        assert out.columns == COLUMNS
        docs, before = out, {r.doc_id: r for r in rows}


def test_stages_take_odd_rows(spark):
    t = "these are seven quite ordinary english words\nand a second line of them"
    rows = [(1, t, "en", None, None), (1, t, "en", None, None), (2, t, None, "s", 3), (None, t, "en", "s", 4), (None, None, None, None, None),
            (3, None, "de", "s", 0), (4, "", "de", "s", 0), (5, "der die das und nicht auch ein", "de", "s", 9), (6, "word " * 60_000, "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS score", "2 AS k", "'x' AS matches", "3 AS component_id", "4 AS n_lines")
    for name, stage in P.STAGES:
        out = shared_table(stage(spark, docs, SMALL), name)
        assert out.count() > 0
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
            empty = stage(spark, docs.limit(0), SMALL)
            assert empty.columns == docs.columns and empty.count() == 0


def test_an_id_of_several_rows_leaves_one_document_per_text(spark):
    a, b = "one two three four five six", "six five four three two one"
    rows = [(1, a), (1, a), (2, a), (3, b)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in P.near_duplicates(spark, docs, SMALL).orderBy("doc_id").collect()]
    assert got == [(1, a), (3, b)]


def test_run_is_registered_and_packs_everything(spark):
    import __spark_entry__ as E
    assert "pipeline" in E.queries() and "pipeline" not in E.oracle_sql()
    out = P.run(spark, SMALL)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 100


def test_line_stage_cuts_runs_whose_first_gram_stood_elsewhere(spark):
    # whichever gram of a, b, c is selected, it occurs first in another context
    rows = [(1, "x\na\nb\ny"), (2, "x\nb\nc\ny"), (3, "p\na\nb\nc\nq"), (4, "r\na\nb\nc\ns")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.text for r in P.lines(spark, docs, SMALL).collect()}[4] == "r\ns"


def test_copies_with_blank_lines_leave_no_husk(spark):
    text = "one line of words\n\nanother line of words\n \n\t\n\u00a0\nand a third line\n"
    rows = [(1, text), (2, text), (3, "one line of words\n\n\nanother line of words\n\n"), (4, "\n\n"), (5, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in P.lines(spark, docs, SMALL).collect()}
    assert got.keys() & {1, 2, 4, 5} == {1, 4, 5} and got[1] == text
    assert all(t is None or t.strip() or k == 4 for k, t in got.items())
