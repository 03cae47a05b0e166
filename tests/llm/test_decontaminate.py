import re

from storelens.llm import decontaminate as D
from storelens.llm.base import table
from tests.llm.conftest import PROSE, as_rows

SF = "/root/testdata/sf0.01"


def test_finds_all_planted_items_and_no_others(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()}
    norm = lambda t: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} "
    items = [(r.item_id, norm(r.text)) for r in bench.collect()]
    want = {(d.doc_id, i) for d in docs.collect() for i, t in items if t in norm(d.text)}
    assert got == want and want


def brute_scores(index, texts):
    """BM25 of every (text window, item) from the index's impacts, all items in full."""
    import numpy as np
    import pyarrow as pa
    from storelens.llm.base import utf8

    out = set()
    for r, t in enumerate(texts):
        words, _ = D.terms(*utf8(pa.array([t])))
        stride = index.window // 2
        for a in range(0, max(1, len(words)), stride):
            seen = np.flatnonzero(np.isin(index.terms, words[a:a + 2 * stride]))
            score = np.zeros(len(index.words))
            for term in seen:
                rows = slice(index.start[term], index.start[term + 1])
                score[index.item[rows]] += index.impact[rows]
            out |= {(r, i) for i in np.flatnonzero(score >= index.threshold)}
    return out


def test_block_bounds_drop_no_item(spark):
    import pyarrow as pa

    bench = [(r.item_id, *D._halves(r.text)) for r in table(spark, SF, "benchmark").collect()]
    docs = [r.text for r in table(spark, SF, "documents").limit(150).collect()]
    for threshold in (0.2, 0.4, 0.6):
        index = D.Index(bench, threshold, block=4)
        rows, items, *_ = index.search(pa.array(docs))
        assert set(zip(rows.tolist(), items.tolist())) == brute_scores(index, docs)


def test_shards_and_edits(spark):
    bench = spark.createDataFrame([(i, PROSE.replace("cat", f"animal{i}")) for i in range(20)],
                                  "item_id long, text string")
    text = "before " * 300 + PROSE.replace("moon", "sun").replace("cat", "animal7") + " after" * 300
    docs = spark.createDataFrame([(1, text), (2, "nothing of it " * 50)], "doc_id long, text string")
    one = as_rows(D.find_leaks(docs, bench).select("doc_id", "item_id"))
    assert ("1", "7") in one and all(r[0] == "1" for r in one)
    many = D.indexes(bench, shard_bytes=500)
    assert len(many) > 3 and sum(len(x.names) for x in many) == 20
    qa = bench.selectExpr("item_id", "text AS q", "'seven words that do not occur anywhere' AS a")
    assert D.find_leaks(docs, qa, question_col="q", answer_col="a").count() == 0


def test_odd_rows(spark, odd, clashing, empty):
    bench = spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (None, "lone words here"), (4, PROSE)],
                                  "item_id long, text string")
    got = D.find_leaks(odd, bench)
    ids = sorted(str(r.doc_id) for r in got.collect())
    assert ids == ["1"] * 2 + ["2"] * 4 + ["None"]
    assert as_rows(D.find_leaks(clashing, bench)) == as_rows(got)
    assert D.find_leaks(empty, bench).count() == 0 and D.find_leaks(odd, bench.limit(0)).count() == 0
    left = D.drop_leaks(clashing, bench)
    assert left.columns == clashing.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 7, 8, 9, 10, 11]


def test_shards_give_the_scores_of_the_whole(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    one, many = D.find_leaks(docs, bench).collect(), D.find_leaks(docs, bench, shard_bytes=4_000).collect()
    assert len(D.indexes(bench, shard_bytes=4_000)) > 3 and len(one) > 20
    key = lambda r: (r.doc_id, r.item_id)
    for a, b in zip(sorted(one, key=key), sorted(many, key=key), strict=True):
        assert key(a) == key(b) and abs(a.score - b.score) < 1e-9
        assert (a.question_overlap, a.answer_overlap) == (b.question_overlap, b.answer_overlap)
    odd = spark.createDataFrame([(1, PROSE), (2, None), (3, " \xa0 "), (4, PROSE + " and\xa0more words\xa0here")],
                                "item_id long, text string")
    text = spark.createDataFrame([(1, PROSE + " and\xa0more words\xa0here")], "doc_id long, text string")
    assert as_rows(D.find_leaks(text, odd, shard_bytes=100)) == as_rows(D.find_leaks(text, odd))
