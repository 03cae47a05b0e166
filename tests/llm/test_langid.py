import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storelens.llm import langid as L
from storelens.llm.base import table, utf8
from tests.llm.conftest import as_rows

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = L.folded_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_mixture_proportions_and_selection():
    draw = np.random.default_rng(1)
    # 3 languages, segments whose likelihood favours one language by 5 nats
    def doc(shares, n):
        of = draw.choice(3, size=n, p=shares)
        logs = draw.normal(0, 0.5, (n, 3))
        logs[np.arange(n), of] += 5
        return logs
    logs = [doc([1, 0, 0], 40), doc([0.5, 0.5, 0], 400), doc([0, 0.2, 0.8], 400)]
    at = np.repeat(np.arange(3), [len(x) for x in logs])
    share = L.proportions(np.concatenate(logs), at)
    assert np.allclose(share, [[1, 0, 0], [0.5, 0.5, 0], [0, 0.2, 0.8]], atol=0.08)
    assert (share > 0).sum(axis=1).tolist() == [1, 2, 2]
    alone = [L.proportions(x, np.zeros(len(x), int))[0] for x in logs]
    assert np.allclose(share, alone)  # a document's result doesn't depend on its batch


def test_odd_rows(odd, clashing, empty):
    got = L.folded_languages(odd)
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == odd.count()
    for i in (3, 4, 5, 11):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[8].lang_pred == "en" and not by[None].held_out
    assert as_rows(L.folded_languages(clashing)) == as_rows(got)
    assert L.folded_languages(empty).count() == 0
    none = L.identify(odd, L.train(empty.selectExpr("lang", "text")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_signs_beyond_ascii_are_not_letters(spark):
    df = spark.createDataFrame([(0, "€ – …"), (1, "漢字"), (2, "Ünï")], "doc_id long, text string")
    model = L.train(spark.createDataFrame([("xx", "Ünï 漢字")], "lang string, text string"))
    assert [r.lang_pred for r in sorted(L.identify(df, model).collect())] == ["und", "xx", "xx"]


def test_a_text_is_read_by_itself(spark):
    """The result of a text is the same alone, beside any others and however they are partitioned."""
    docs = table(spark, SF, "documents")
    model = L.train(docs.where("lang is not null and doc_id % 2 = 0").select("lang", "text"))
    short = ["die", "am", "no", "le", "a", "x 1", "Über", "  und?", "de la", "12 the", "é", "der the le"]
    rows = [(i, t) for i, t in enumerate(short)] + [(100 + r.doc_id, r.text) for r in docs.select(
        "doc_id", "text").orderBy("doc_id").limit(60).collect()]
    every = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r.lang_pred, r.score, r.n_langs, tuple(sorted(r.shares.items())))
    want = {r.doc_id: key(r) for r in L.identify(every.coalesce(1), model).collect()}
    for other in (every.orderBy(F.desc("doc_id")).coalesce(1), every.repartition(5), every.repartition(len(rows), "doc_id")):
        assert {r.doc_id: key(r) for r in L.identify(other, model).collect()} == want
    cells, rows_of, letter = L.grams(*utf8(pa.array(["xyz", "die", "", "die"])))
    alone = L.grams(*utf8(pa.array(["die"])))
    for c, a in zip(cells, alone[0]):
        assert c[rows_of == 1].tolist() == c[rows_of == 3].tolist() == a.tolist()


def test_em_runs_until_the_likelihood_stands_still():
    rng = np.random.default_rng(3)
    logs = np.log(rng.dirichlet(np.ones(3) * 0.7, 400))
    doc = np.repeat(np.arange(20), 20)
    got = L.proportions(logs, doc, penalty=0.0, tolerance=1e-9)
    like = np.exp(logs)
    for i in range(20):
        own, share = like[doc == i], np.full(3, 1 / 3)
        for _ in range(20_000):
            w = own * share
            share = (w / w.sum(1, keepdims=True)).mean(0)
        assert np.log(own @ got[i]).sum() == pytest.approx(np.log(own @ share).sum(), abs=1e-4)
