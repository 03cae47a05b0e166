import corpus_pipeline as C
from storelens.llm import ORACLES, QUERIES
from storelens.llm.base import table
from tests.llm.test_near_copies import brute

SF = "/root/testdata/sf0.001"
EXPECTED = ["quality", "near", "clean", "mix", "tokens"]


def test_registered():
    import __spark_entry__ as E

    names = E.queries()
    assert [n for n, _ in C.STAGES] == EXPECTED and "pipeline" in names
    for i in range(1, 11):
        assert sum(n.startswith(f"op{i}_") for n in names) == 1
    assert set(ORACLES) <= set(QUERIES) and all(fn.__doc__ for fn in QUERIES.values())


def test_stages_by_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = C.quality(spark, docs, SF)
    assert kept.columns == columns and kept.schema == docs.schema and 0 < kept.count() <= docs.count()
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    ids = {r.doc_id for r in kept.collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in ids for i in good) / len(good) > 0.95
    near = C.near(spark, kept, SF).persist()
    classes = brute(sorted((r.doc_id, r.text) for r in kept.collect()))
    assert {r.doc_id for r in near.collect()} == set(classes.values()) and near.columns == columns
    clean = C.clean(spark, near, SF)
    items = [" ".join(r.text.lower().split()) for r in table(spark, SF, "benchmark").collect()]
    want = {r.doc_id for r in near.collect() if not any(i in " ".join(r.text.lower().split()) for i in items)}
    assert {r.doc_id for r in clean.collect()} == want
    mixed = C.mix(spark, clean, SF)
    assert mixed.columns == columns
    assert {r.doc_id for r in mixed.collect()} <= want
    done = C.tokens(spark, mixed, SF)
    assert done.count() == mixed.count()


def test_run_goes_through_all_stages(spark):
    rows = C.run(spark, SF).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert rows


def test_stages_on_odd_rows(spark, odd, empty):
    for docs, some in ((odd, True), (empty, False)):
        for name, stage in C.STAGES:
            out = stage(spark, docs, SF)
            if name != "tokens":
                assert out.columns == docs.columns
            assert some or not out.collect()
            out.count()
