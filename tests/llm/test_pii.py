import hashlib
import random
import re

from storelens.llm import pii as P
from storelens.llm.queries import QUERIES
from tests.llm.conftest import as_rows


def brute(text):
    out = []
    for kind, pattern in P.BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split(".")),
                    "card": lambda: 14 <= len(d) <= 19 and P.luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], P.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    draw = random.Random(4)
    parts = list("a1.@-+_% ()0\n") + ["4111111111111111", "10.0.0.1", "x.y@b.co", "+1 (555) 123-4567", "é", "999.1.1.1"]
    for _ in range(8000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))
        assert P.base_spans(text) == brute(text), text
    assert P.base_spans("9" * 6000 + ".1.1.1") == brute("9" * 6000 + ".1.1.1")


def texts(spark):
    draw = random.Random(5)
    rows = []
    for i in range(400):
        card = f"4{draw.randrange(10 ** 14):014d}"
        while not P.luhn(card + "0") and not any(P.luhn(card + str(c)) for c in range(10)):
            card = f"4{draw.randrange(10 ** 14):014d}"
        card += next(str(c) for c in range(10) if P.luhn(card + str(c)))
        wrong = card[:-1] + str((int(card[-1]) + 5) % 10)
        rows.append((i, f"pay with card {card} or call +1 (555) {100 + i}-{1000 + i} now, order no. {wrong} total 12.5"))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_trees_learn_and_base_spans_stay(spark):
    docs = texts(spark)
    trees = P.fit(docs)
    assert trees is not None and 0.5 <= trees.threshold <= 1.0
    got = P.find_pii(docs, trees=trees).collect()
    for r, d in zip(sorted(got), sorted(docs.collect())):
        base = P.base_spans(d.text)
        assert r.base == P._join(base) and set(r.base.split(",")) <= set(r.spans.split(","))
        assert len(base) == 2 and r.n_card == 1 and r.n_phone == 1
    spaced = spark.createDataFrame([(1, "card 4111/1111/1111/1111 please, and mail jane (at) mail (dot) org")],
                                   "doc_id long, text string")
    assert P.find_pii(spaced, trees=trees).first().base == ""


def test_odd_rows(odd, clashing, empty):
    got = P.find_pii(odd)
    assert got.count() == odd.count() and all(r.spans == "" for r in got.collect())
    assert as_rows(P.find_pii(clashing)) == as_rows(got)
    assert P.find_pii(empty).count() == 0


def test_query_digest(spark):
    df = QUERIES["op5_pii"](spark, "/root/testdata/sf0.001")
    from storelens.llm.base import table

    text = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    for r in df.collect():
        base = brute(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(P._join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in P.KINDS]


def test_redact():
    assert P.redact("call 123 or a@b.c", "phone:5:8,email:12:17") == "call [phone] or [email]"
    assert P.redact("none", "") == "none"


def mixed(spark, n=600):
    """Base spans of all kinds beside numbers and words that look alike."""
    draw = random.Random(6)
    rows = [(r.doc_id, r.text) for r in texts(spark).collect()]
    for i in range(n):
        rows.append((1000 + i, f"mail to user{i}.x@site{i % 97}.org or the host 10.{i % 250}.{draw.randrange(255)}.7 was "
                               f"down; see page {draw.randrange(10 ** 7, 10 ** 8)}, version 1.{i}:2.3:4 of order "
                               f"{draw.randrange(10 ** 12, 10 ** 13)}, look at shop{i}.example.com today"))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_loose_forms_are_added(spark):
    trees = P.fit(mixed(spark))
    rows = [(1, "mail to jane.doe (at) mail (dot) org today"), (2, "pay with card 4111/1111/1111/1111 now"),
            (3, "or call 1 (555) 123-4567 now"), (4, "mail to jane at mail dot org today"),
            (5, "the host 10:20:30:40 was down"), (6, "pay with card 4222222222222 now")]
    got = {r.doc_id: r for r in P.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), trees=trees).collect()}
    want = {1: "email", 2: "card", 3: "phone", 4: "email", 5: "ip", 6: "card"}
    for i, text in rows:
        r = got[i]
        assert (r.base, r.n_added) == ("", 1) and r.spans.split(":")[0] == want[i], (text, r)
        assert r.n_email + r.n_card + r.n_phone + r.n_ip == 0
    joined = spark.createDataFrame([(1, "x 4111111111111111 4111111111111111 y")], "doc_id long, text string")
    assert P.find_pii(joined, trees=trees).first().spans == "card:2:18,card:19:35"
    others = [(1, "order no. 4111111111111112 total 12.5"), (2, "see page 12345678, it is long"), (3, "look at shop.example.com today")]
    for r in P.find_pii(spark.createDataFrame(others, "doc_id long, text string"), trees=trees).collect():
        assert r.n_added == 0, r


def test_repeated_spans_count_once(spark):
    every = mixed(spark)
    again = every.unionByName(spark.createDataFrame([(9, "order 1234567890123 total")] * 5000, every.schema))
    one = every.unionByName(spark.createDataFrame([(9, "order 1234567890123 total")], every.schema))
    a, b = P.fit(again, sample_rows=1500), P.fit(one, sample_rows=1500)
    assert a.threshold == b.threshold and all((x == y).all() for x, y in zip(a.trees, b.trees))


def planted(n=300):
    """Loose forms of each kind after a word of their kind, and the same forms in other surroundings."""
    draw = random.Random(8)
    out = []
    for i in range(n):
        digits = "".join(draw.choice("0123456789") for _ in range(13))
        forms = {"email": f"ann{i}.b (at) mail{i % 7} (dot) net", "ip": f"10:{i % 200}:3:{draw.randrange(9, 250)}",
                 "card": f"{4000 + i}/1111/{2000 + i}/1234", "phone": f"1 (555) {draw.randrange(100, 999)}-{draw.randrange(1000, 9999)}"}
        for k, lead in (("email", "mail to"), ("ip", "or the host"), ("card", "pay with card"), ("phone", "or call")):
            out.append((k, True, f"{lead} {forms[k]} now"))
            out.append((k, False, f"order no. {digits} of {forms[k]} total"))
    return out


def test_the_trees_add_and_reject_by_kind(spark):
    trees = P.fit(mixed(spark))
    rows = planted()
    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in P.find_pii(docs, trees=trees).collect()}
    found, away = {k: 0 for k in P.KINDS}, {k: 0 for k in P.KINDS}
    for i, (k, cue, _) in enumerate(rows):
        assert got[i].base == ""
        if cue:
            found[k] += k in got[i].spans
        else:
            away[k] += k not in got[i].spans
    print("added", found, "rejected", away)
    assert all(v >= 0.9 * 300 for v in found.values()) and all(v >= 0.9 * 300 for v in away.values())
    assert sum(r.n_added for r in got.values()) > 1000 and sum(r.n_rejected for r in got.values()) > 1000


def test_no_feature_is_the_label():
    """Forms with and without a cue occur in both classes, as do texts against them."""
    text = "mail to a.b@c.org today and then look around for a long while here, see order 4111111111113 now"
    ex = [(label, x) for _, _, x, label in P.examples(text)]
    assert {label for label, _ in ex} == {0.0, 1.0}
    cued = "card number 4222222222222 or call 555 123 4567 now"  # no base span, words of their kinds
    assert P.base_spans(cued) == [] and {(label, x[-3]) for _, _, x, label in P.examples(cued)} >= {(0.0, 1.0)}


def test_many_spans_of_one_text_in_linear_time(spark):
    import time

    def cost(n):
        text = " ".join(f"mail to u{i}@x.org or call 555 {100 + i % 800} 1234" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        started = time.process_time()
        for _ in range(3):
            list(P.examples(text))
        return time.process_time() - started, P.find_pii(df, trees=trees).first()

    trees = P.fit(mixed(spark))
    (small, a), (large, b) = cost(2_000), cost(8_000)
    assert (a.n_email, b.n_email) == (2_000, 8_000) and large < 9 * small


def test_the_trees_learn_from_all_spans(spark):
    """Card numbers whose hashes lie above those of 20,000 other spans count too: only
    they have digits, and no word of their kind, before them."""
    draw = random.Random(9)
    rows = [(i, f"mail to user{i}.x@site{i % 97}.org today and then look around for a long while here") for i in range(11_500)]
    high = 0.9 * 2 ** 56
    while len(rows) < 11_800:
        d = f"4{draw.randrange(10 ** 14):014d}"
        d += next(str(c) for c in range(10) if P.luhn(d + str(c)))
        text = f"bill 7712 is {d} now and then look around for a long while here"
        if all(P._draw(k, s, label) > high for k, s, _, label in P.examples(text) if label):
            rows.append((len(rows), text))
    every = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.find_pii(spark.createDataFrame([(1, "bill 7713 is 4111/1111/1111/1111 now")], every.schema), trees=P.fit(every))
    assert got.first().n_added == 1


def test_cuts_and_threshold_count_every_row(spark):
    draw = random.Random(10)
    values = [(draw.randrange(6), draw.randrange(1000) ** 2, 7) for _ in range(5000)]
    df = spark.createDataFrame([(list(v), 1) for v in values for _ in range(1 + v[0])], "x array<int>, n long")
    cuts = P._cuts(df, 8)
    assert [c for f, c in cuts if f == 0] == [0.5, 1.5, 2.5, 3.5, 4.5] and not [c for f, c in cuts if f == 2]
    second = sorted(v[1] for v in values for _ in range(1 + v[0]))
    parts = [0] + [sum(v <= c for v in second) for f, c in cuts if f == 1] + [len(second)]
    assert len(parts) == 9 and all(abs(b - a - len(second) / 8) < len(second) / 80 for a, b in zip(parts, parts[1:]))

    rows = [(round(draw.random(), 3), 0) for _ in range(3000)]
    rows = [(s, int(draw.random() < s ** 0.1)) for s, _ in rows]
    for precision in (0.9, 0.95, 0.97, 1.1):
        want = None
        for s in {s for s, _ in rows}:
            of = [label for t, label in rows if t >= s]
            if sum(of) / len(of) >= precision:
                want = s if want is None else min(s, want)
        assert P._threshold(spark.createDataFrame(rows, "score double, label int").repartition(5), precision) == want


def test_features_without_cuts(spark):
    text = "order 1234567890123 total"
    assert P._cuts(spark.createDataFrame([([1, 2], 3)], "x array<int>, n long"), 32) == [(0, float("inf"))]
    assert P.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().n_added == 0
