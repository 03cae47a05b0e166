"""Personal data by candidate gradient boosting (operator 5).

High-recall generators propose overlapping spans: the four base patterns
(email, ip, card, phone) and looser forms of them - an email with spelt-out or
bracketed signs, digit groups with separators, numbers after a plus sign or in
the ways that phones are written, dotted and colon-separated addresses.
Boosted trees score each loose candidate from its format (length, digits,
groups, separators, checksum, edges) and its context (signs and words around
it); a threshold calibrated on held-back candidates selects the ones to add.

Base spans are found exactly by the patterns below and always stay; a selected
candidate is added if it overlaps no span kept so far (highest score first).  A
candidate that meets its base rule by itself, as one of two card numbers that a
space joins to one match of the pattern, needs no score.

The trees never see what decides the base rules (checksum, octet values, the
plus sign), and no label is a rule over what they see.  They are fitted and calibrated
on all distinct spans of the corpus.  Positives are its own base spans rewritten in the
looser forms (spelt-out at and dot, other separators, no plus sign, 13 digits) where
they stand.  Negatives are the same forms at a place of the text that a hash draws, away
from what precedes spans of the kind, and every loose candidate of the corpus beside
its base spans, whatever its words.  So form and surroundings decide together; without
both classes nothing is added.

Null text: the empty text, no spans.  Repeated rows: a result each.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.base import id_text, slices

#: The base patterns, in the order of their kinds.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP, _CARD, _PHONE = (re.compile(BASE[k]) for k in ("ip", "card", "phone"))
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: The generators' looser forms.
LOOSE = (
    ("ip", re.compile(r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}[.,:]){3}[0-9]{1,3}(?![0-9])|"
                      r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[\x20.\-/]{0,2}[0-9]){12,18}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])(?:\+|00|\()?[0-9](?:[\x20().\-/]{0,3}[0-9]){6,14}(?![0-9A-Za-z])")),
)


#: A loose email: a spelt-out or bracketed at sign, the word before it, a domain after it.
_AT = re.compile(r"\s?(?:[(\[{]at[)\]}]|@)\s?| at ", re.I)
_BEFORE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*\Z")
_AFTER = re.compile(r"[A-Za-z0-9-]+(?:(?:\s?[(\[{]dot[)\]}]\s?| dot |\.)[A-Za-z0-9-]+)+", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or "0") <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    """Leftmost matches of the base pattern, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL_SIGNS:
            a -= 1
        m = _DOMAIN.match(text, at) if a < at else None
        if m:
            yield a, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by start, then kind as listed."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_ANY = re.compile(r"[0-9@]|[(\[{ ]at[)\]} ]", re.I)
_DIGIT = re.compile("[0-9]")


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates of the generators; they may overlap each other and base spans."""
    if not _ANY.search(text):
        return []
    out = []
    for at in _AT.finditer(text):
        if after := _AFTER.match(text, at.end()):
            low = max(0, at.start() - 64)
            if before := _BEFORE.search(text[low:at.start()]):
                out.append(("email", low + before.start(), after.end()))
    if _DIGIT.search(text):
        out += [(k, m.start(), m.end()) for k, p in LOOSE for m in p.finditer(text)]
    return out


#: Words near a span that speak for or against each kind.
CUES = {
    "email": re.compile(r"mail|contact|write|address"), "ip": re.compile(r"\bip\b|host|server|address|login"),
    "card": re.compile(r"\bcard|visa|credit|\bpay|account"), "phone": re.compile(r"phone|\btel\b|\bcall|\bfax|mobile"),
    "against": re.compile(r"isbn|order|invoice|version|\bpage|\bno\.|total|\bsum\b|\byear"),
}
BEFORE, AFTER = 24, 12
#: Places of a text that are tried for a negative.
PLACES = 8


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format and context of one candidate, without the marks of the base rules."""
    s = text[start:end]
    before, after = text[max(0, start - BEFORE):start], text[end:end + AFTER]
    near = before.lower()
    groups = re.findall(r"[0-9]+", s)
    d = "".join(groups)
    seps = [c for c in s if not c.isalnum()]
    return [
        float(KINDS.index(kind)), float(len(s)), float(len(d)), float(len(groups)),
        float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(len(set(seps))), float(len(seps)), float("(" in s),
        float(len(set(d))), float(sum(c.isalpha() for c in s)), float(s.count(".")),
        float(before[-1:].isalnum()), float(after[:1].isalnum()),
        float(bool(CUES[kind].search(near))), float(bool(CUES["against"].search(near))),
        float(sum(c.isdigit() for c in before + after)),
    ]


def is_base(kind: str, s: str) -> bool:
    """Whether a whole candidate meets its kind's base rule."""
    return (kind, 0, len(s)) in base_spans(s)


class Taken:
    """Spans that no other may overlap, by start; overlapping ones given at first are one."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlaps(self, a: int, b: int) -> bool:
        i = bisect.bisect_right(self.ends, a)
        return i < len(self.ends) and self.starts[i] < b

    def add(self, a: int, b: int) -> None:
        i = bisect.bisect_right(self.ends, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def loosened(kind: str, s: str) -> list[str]:
    """A base span written in the looser forms of its kind."""
    if kind == "email":
        local, domain = s.split("@", 1)
        return [f"{local}{at}{domain.replace('.', dot)}" for at, dot in (
            (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", "."), (" @ ", "."))]
    if kind == "ip":
        return [s.replace(".", ":"), s.replace(".", ",")]
    d = _digits(s)
    if kind == "card":
        fours = [d[i:i + 4] for i in range(0, len(d), 4)]
        return ["/".join(fours), ".".join(fours), d[:13], "  ".join(fours)]
    return [s[1:], "00" + s[1:], d, re.sub(r"^\+[0-9]+[\x20().-]+", "", s)]


def _draw(*of) -> int:
    return int.from_bytes(hashlib.blake2b(":".join(map(str, of)).encode(), digest_size=7).digest())


def _elsewhere(text: str, lead: Taken, *of) -> int | None:
    """A word's start in the text whose surroundings lie outside ``lead`` (what
    precedes base spans of the kind): the first good one of ``PLACES`` places that
    a hash draws, else None."""
    for i in range(PLACES):
        p = text.find(" ", _draw(i, *of) % (len(text) + 1)) + 1  # 0, the text's start, if no word follows
        if not lead.overlaps(max(0, p - BEFORE), p + AFTER):
            return p
    return None


def examples(text: str):
    """Labelled examples of one text: kind, span, features, label."""
    own = base_spans(text)
    lead = {k: Taken((max(0, a - BEFORE), b) for kind, a, b in own if kind == k) for k in {k for k, _, _ in own}}
    for k, a, b in own:
        forms = loosened(k, text[a:b])
        first = _draw(text[a:b]) % len(forms)
        place = _elsewhere(text, lead[k], k, text[a:b])
        places = [(text[max(0, a - BEFORE):a], text[b:b + AFTER], 1.0)]
        if place is not None:
            places.append((text[max(0, place - BEFORE):place], " " + text[place:place + AFTER - 1], 0.0))
        for before, after, label in places:
            for form in forms[first:] + forms[:first]:
                at, end = len(before), len(before) + len(form)
                seen = before + form + after
                if (k, at, end) in loose_spans(seen) and not base_spans(form):
                    yield k, form, features(k, seen, at, end), label
                    break
    taken = Taken((a, b) for _, a, b in own)
    for k, a, b in loose_spans(text):
        if not taken.overlaps(a, b):
            yield k, text[a:b], features(k, text, a, b), 0.0


class Trees:
    """Boosted trees as flat arrays: feature, threshold, children, value."""

    def __init__(self, trees: list[list[list[float]]], weights: list[float], threshold: float):
        self.trees = [np.array(t, float) for t in trees]
        self.weights, self.threshold = weights, threshold

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for t, w in zip(self.trees, self.weights):
            at = np.zeros(len(x), int)
            while True:
                f = t[at, 0].astype(int)
                if (f < 0).all():
                    break
                left = x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1]
                at = np.where(f < 0, at, np.where(left, t[at, 2], t[at, 3]).astype(int))
            margin += w * t[at, 4]
        return 1.0 / (1.0 + np.exp(-2.0 * margin))


def _flat(node, cuts: list[tuple[int, float]]) -> list[list[float]]:
    """A tree over the yes-or-no columns of ``cuts`` as rows over the features."""
    rows: list[list[float]] = []

    def add(n) -> int:
        at = len(rows)
        # rounded, so that the order in which partial sums arrived does not show
        rows.append([-1.0, 0.0, 0.0, 0.0, round(float(n.prediction()), 9)])
        if n.getClass().getSimpleName() == "InternalNode":
            split = n.split()
            rows[at][:2] = map(float, cuts[split.featureIndex()])
            low, high = n.leftChild(), n.rightChild()
            if list(split.leftCategories()) != [0.0]:  # the left child has the rows above the cut
                low, high = high, low
            rows[at][2] = float(add(low))
            rows[at][3] = float(add(high))
        return at

    add(node)
    return rows


def _cuts(train: DataFrame, bins: int) -> list[tuple[int, float]]:
    """Exact cuts of every feature, by its values in all rows of ``train`` (x, n):
    between all neighbouring values of a feature with at most ``bins`` of them, else
    where its rows are divided into ``bins`` parts of about the same size."""
    feature = Window.partitionBy("feature").orderBy("value")
    values = (train.select(F.posexplode("x").alias("feature", "value"), "n")
              .groupBy("feature", "value").agg(F.sum("n").alias("n"))
              .withColumns({"below": F.sum("n").over(feature) - F.col("n"), "rank": F.row_number().over(feature) - 1,
                            "next": F.lead("value").over(feature),
                            "total": F.sum("n").over(Window.partitionBy("feature")),
                            "different": F.count("*").over(Window.partitionBy("feature"))}))
    part = F.when(F.col("different") <= bins, F.col("rank")).otherwise(F.floor(F.col("below") * bins / F.col("total")))
    ends = (values.withColumn("part", part).withColumn("then", F.lead("part").over(feature))
            .where("part < then").select("feature", ((F.col("value") + F.col("next")) / 2).alias("cut")))
    # fewer than bins a feature; without any, a cut that no row passes
    return sorted((r.feature, r.cut) for r in ends.collect()) or [(0, float("inf"))]


def _threshold(scored: DataFrame, precision: float) -> float | None:
    """The lowest score from which on at least ``precision`` of all rows (score, label) are
    positive: running sums within 1,024 ranges of the score, on top of the ranges above."""
    scores = (scored.groupBy("score").agg(F.sum("label").alias("right"), F.count("*").alias("n"))
              .withColumn("range", F.floor(F.col("score") * 1024)))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # at most 1,025 rows
    ranges = scores.groupBy("range").agg(F.sum("right").alias("r"), F.sum("n").alias("m")).select(
        "range", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("r", "m")))
    within = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    share = (F.col("r") + F.sum("right").over(within)) / (F.col("m") + F.sum("n").over(within))
    return (scores.join(F.broadcast(ranges), "range").select("score", share.alias("share"))
            .where(F.col("share") >= precision).agg(F.min("score")).first()[0])


#: Folded rows that one task of a fit holds.
FIT_ROWS = 20_000


def fit(df: DataFrame, sample_rows: int | None = None, rounds: int = 10, depth: int = 3,
        precision: float = 0.99, bins: int = 32) -> Trees | None:
    """Fit and calibrate the trees on all candidates of ``df`` (columns text); with
    ``sample_rows``, on that many of their spans.

    A quarter of the distinct spans, by their hash, is held back for the threshold.
    Equal feature vectors of the others are one row that weighs as much as they do; each cut
    of a feature is a column of its own to the trees, as Spark would find the cuts
    of numbers in a sample."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    def propose(batches):
        # one example for equal spans of a slice of texts, the least as below
        for batch in batches:
            for part in slices(batch):
                kept: dict[int, tuple] = {}
                for t in part.column(0).to_pylist():
                    for k, s, x, label in examples(t):
                        draw = _draw(k, s, label)
                        kept[draw] = min(kept.get(draw, (label, x)), (label, x))
                yield pa.RecordBatch.from_pydict({
                    "x": pa.array([list(map(int, x)) for _, x in kept.values()], pa.list_(pa.int32())),
                    "label": pa.array([int(label) for label, _ in kept.values()], pa.int32()),
                    "draw": pa.array(list(kept), pa.int64())})

    drawn = (df.select("text").mapInArrow(propose, "x array<int>, label int, draw long")
             .groupBy("draw").agg(F.min(F.struct("label", "x")).alias("e")).select("draw", "e.label", "e.x"))
    if sample_rows is not None:
        drawn = drawn.orderBy("draw").limit(sample_rows)
    drawn = drawn.persist()
    folded = None
    try:
        fold = F.col("draw") % 4 == 0
        train = drawn.where(~fold)
        if train.select("label").distinct().count() < 2:
            return None
        cuts = _cuts(train.groupBy("x").agg(F.count("*").alias("n")), bins)
        binned = F.array(*(F.when(F.col("x")[i] > cut, 1.0).otherwise(0.0) for i, cut in cuts))
        folded = train.groupBy(binned.alias("x"), "label").agg(F.count("*").cast("double").alias("n")).persist()
        attributes = {"attrs": {"binary": [{"idx": i} for i in range(len(cuts))]}, "num_attrs": len(cuts)}
        rows = (folded.repartition(folded.count() // FIT_ROWS + 1).sortWithinPartitions("x", "label")
                .select(array_to_vector("x").alias("features", metadata={"ml_attr": attributes}),
                        F.col("label").cast("double").alias("label"), "n"))
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=bins, seed=5, weightCol="n").fit(rows)
        trees = Trees([_flat(t._java_obj.rootNode(), cuts) for t in model.trees], list(model.treeWeights), 1.1)

        def score(batches):
            for batch in batches:
                x = batch.column(0).combine_chunks() if isinstance(batch.column(0), pa.ChunkedArray) else batch.column(0)
                if len(x):
                    score = trees.score(np.array(x.flatten(), float).reshape(len(x), -1))
                    yield pa.RecordBatch.from_arrays([pa.array(score), batch.column(1)], names=["score", "label"])

        least = _threshold(drawn.where(fold).select("x", "label").mapInArrow(score, "score double, label int"), precision)
    finally:
        drawn.unpersist()
        if folded is not None:
            folded.unpersist()
    if least is not None:
        trees.threshold = max(0.5, least)
    return trees


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: Trees | None = None) -> DataFrame:
    """Spans of every text: doc_id, base (their kind:start:end, joined), spans
    (base and added ones), n_<kind> of the base spans, n_added and n_rejected (loose
    candidates that the trees' threshold let in, without those that overlap a
    better one, and that it kept out)."""
    docs = id_text(df, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(trees or fit(docs))

    def find(batches):
        trees = model.value
        for batch in batches:
            for part in slices(batch):
                base, owner, loose, x, whole = [], [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    own = base_spans(t)
                    base.append(own)
                    if trees is None:
                        continue
                    taken = Taken((a, b) for _, a, b in own)
                    for k, a, b in loose_spans(t):
                        if not taken.overlaps(a, b):
                            owner.append(i)
                            loose.append((k, a, b))
                            x.append(features(k, t, a, b))
                            whole.append(is_base(k, t[a:b]))
                added = [[] for _ in base]
                rejected = np.zeros(len(base), np.int64)
                if x:
                    score = np.where(whole, 1.0, trees.score(np.array(x)))
                    np.add.at(rejected, np.array(owner)[score < trees.threshold], 1)
                    kept: dict[int, Taken] = {}
                    for j in np.lexsort(([s[1] for s in loose], -score)):
                        k, a, b = loose[j]
                        if score[j] < trees.threshold:
                            break
                        if not kept.setdefault(owner[j], Taken()).overlaps(a, b):
                            kept[owner[j]].add(a, b)
                            added[owner[j]].append(loose[j])
                every = [sorted(o + e, key=lambda s: (s[1], KINDS.index(s[0]))) for o, e in zip(base, added)]
                columns = [part.column(0)]
                columns += [pa.array([sum(s[0] == k for s in o) for o in base], pa.int64()) for k in KINDS]
                columns += [pa.array([len(e) for e in added], pa.int64()), pa.array(rejected),
                            pa.array([_join(o) for o in base], pa.string()),
                            pa.array([_join(e) for e in every], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "n_added",
                                                                 "n_rejected", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.mapInArrow(find, f"doc_id {kind}, {counts}, n_added long, n_rejected long, base string, spans string")


def redact(text: str, spans: str, mask: str = "[{kind}]") -> str:
    """The text with each span of the ``spans`` column replaced by its kind."""
    out, done = [], 0
    for s in filter(None, spans.split(",")):
        kind, a, b = s.split(":")
        if int(a) >= done:
            out += [text[done:int(a)], mask.format(kind=kind)]
        done = max(done, int(b))
    return "".join(out) + text[done:]
