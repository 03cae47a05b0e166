"""Price estimators as column expressions.

Every estimator is ``f(df) -> df + price column``; keyword rules are
``filter``/``aggregate`` over ``split`` arrays, so the whole estimator stays
inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.exprs import any_substring, count_substrings_present, ordered_when, python_round

# Keyword price rule.
BASE_PRICE = 5.00
LONG_TEXT_WORDS, LONG_TEXT_BONUS = 10, 2.50
KEYWORD_BONUS = 1.25
PRICE_FLOOR, PRICE_CEILING = 1.00, 50.00
PREMIUM_WORDS = ["gold", "silver", "set", "vintage", "large", "luxury", "wooden",
                 "glass", "limited", "edition", "special", "handmade", "ceramic"]

# Item categories, checked in this order by substring.
CATEGORIES = [
    ("Kitchenware", ["glass", "cup", "mug", "dish", "plate", "bowl"]),
    ("Seasonal & Gifts", ["christmas", "heart", "gift", "decoration", "card"]),
    ("Home Decor", ["sign", "frame", "box", "candle", "holder"]),
    ("Storage & Organization", ["bag", "hanger", "storage", "box"]),
]
DEFAULT_CATEGORY = "General Merchandise"

# Neighbour-weighted price rule.
RANK_WEIGHTS = [1.0, 0.8, 0.6, 0.4, 0.2]
NEIGHBOR_PREMIUM = ["luxury", "vintage", "special", "handmade", "set", "collection"]
NEIGHBOR_BUDGET = ["small", "mini", "basic", "simple"]
KEYWORD_ADJUSTMENT = 0.15
NEIGHBOR_FLOOR = 0.99
NO_NEIGHBOR_PRICE = 9.99

# Neighbours used when no vector store is available.  Each
# group: trigger substrings, then (item, price) in order.
FALLBACK_GROUPS = [
    (["glass", "cup", "mug", "plate"],
     [("SET OF 4 BLUE GLASS MUGS", 12.99), ("CERAMIC WHITE COFFEE CUP", 8.50),
      ("VINTAGE GLASS TUMBLER SET", 15.75)]),
    (["christmas", "holiday", "decoration"],
     [("CHRISTMAS TREE DECORATION SET", 7.99), ("HOLIDAY HANGING ORNAMENTS", 9.25)]),
    (["box", "storage", "wooden"],
     [("WOODEN STORAGE BOX WITH LID", 14.50), ("SMALL TRINKET BOX", 6.75)]),
]
GENERIC_ITEMS = [("VINTAGE METAL SIGN", 11.99), ("CERAMIC FLOWER POT", 8.50),
                 ("DECORATIVE WALL HANGING", 15.25), ("SET OF SCENTED CANDLES", 12.00),
                 ("METAL STORAGE BASKET", 9.75)]
MIN_NEIGHBORS = 5

ENSEMBLE_FALLBACK = 9.99

NEIGHBOR_TYPE = "array<struct<item:string,price:double>>"


def words(text: Column) -> Column:
    """Python ``str.lower().split()``: whitespace runs, no empty tokens."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def keyword_price(df: DataFrame, text: str = "text", out: str = "specialist_price") -> DataFrame:
    """5.00, +2.50 above 10 words, +1.25 per whole-word premium hit (repeats
    count), clamped to [1, 50] (R10)."""
    ws = words(F.col(text))
    hits = F.size(F.filter(ws, lambda w: w.isin(*PREMIUM_WORDS)))
    p = (F.lit(BASE_PRICE) + F.when(F.size(ws) > LONG_TEXT_WORDS, LONG_TEXT_BONUS).otherwise(0.0)
         + hits * KEYWORD_BONUS)
    return df.withColumn(out, F.greatest(F.lit(PRICE_FLOOR), F.least(p, F.lit(PRICE_CEILING))))


def classify_items(df: DataFrame, text: str = "text", price: str = "specialist_price") -> DataFrame:
    """Category by the first matching substring group, popularity by price
    (< 3 High, > 15 Low, else Medium), stock fixed at Medium (R11)."""
    low = F.lower(F.col(text))
    cat = ordered_when([(any_substring(low, ws), name) for name, ws in CATEGORIES], DEFAULT_CATEGORY)
    pop = F.when(F.col(price) < 3.0, "High").when(F.col(price) > 15.0, "Low").otherwise("Medium")
    return df.withColumns({"category": cat, "popularity": pop, "estimated_stock": F.lit("Medium")})


def _items_array(items) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("item"), F.lit(float(p)).alias("price")) for n, p in items])


def fallback_neighbors(df: DataFrame, text: str = "text", out: str = "neighbors") -> DataFrame:
    """Keyword neighbours (R9): category lists in order, topped up from the
    generic list until there are 5 (a request may end with 7)."""
    low = F.lower(F.col(text))
    empty = F.array().cast(NEIGHBOR_TYPE)
    parts = [F.when(any_substring(low, trig), _items_array(items)).otherwise(empty)
             for trig, items in FALLBACK_GROUPS]
    found = F.concat(*parts)
    need = F.greatest(F.lit(MIN_NEIGHBORS) - F.size(found), F.lit(0))
    generic = _items_array(GENERIC_ITEMS)
    topup = F.when(need > 0, F.slice(generic, F.lit(1), need)).otherwise(empty)
    return df.withColumn(out, F.concat(found, topup))


def neighbor_price(df: DataFrame, text: str = "text", neighbors: str = "neighbors",
                   out: str = "frontier_price") -> DataFrame:
    """Rank-weighted neighbour price with a keyword adjustment.

    weights 1, .8, .6, .4, .2 over the first five neighbours (in rank
    order); x (1 + .15 * (premium - budget)) where each keyword counts once
    if it occurs as a substring; floor .99; no neighbours -> 9.99.
    """
    nb = F.col(neighbors)
    top = F.slice(nb, 1, len(RANK_WEIGHTS))
    w = F.array(*[F.lit(x) for x in RANK_WEIGHTS])
    ws = F.slice(w, F.lit(1), F.size(top))
    num = F.aggregate(F.zip_with(top, ws, lambda n, wt: n["price"] * wt), F.lit(0.0), lambda a, x: a + x)
    den = F.aggregate(ws, F.lit(0.0), lambda a, x: a + x)
    low = F.lower(F.col(text))
    adj = (count_substrings_present(low, NEIGHBOR_PREMIUM) - count_substrings_present(low, NEIGHBOR_BUDGET)) \
        * KEYWORD_ADJUSTMENT
    price = F.greatest(F.lit(NEIGHBOR_FLOOR), num / den * (F.lit(1.0) + adj))
    return df.withColumn(out, F.when(F.coalesce(F.size(nb), F.lit(0)) > 0, price)
                         .otherwise(F.lit(NO_NEIGHBOR_PRICE)))


def ensemble_price(df: DataFrame, cols: Sequence[str] = ("specialist", "frontier", "random_forest"),
                   out: str = "ensemble", model=None) -> DataFrame:
    """Combine nullable estimates.

    No estimate -> 9.99.  Without a stacker: sort the valid ones, drop the
    lowest and highest when there are at least 3, average the rest.  With a
    fitted stacker (:func:`fit_stacker`): NULLs <- mean of the valid ones,
    add Min and Max, predict, floor at 0.
    """
    valid = F.array_sort(F.array_compact(F.array(*[F.col(c).cast("double") for c in cols])))
    n = F.size(valid)
    if model is None:
        kept = F.when(n >= 3, F.slice(valid, F.lit(2), n - 2)).otherwise(valid)
        mean = F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept))
        return df.withColumn(out, F.when(n == 0, F.lit(ENSEMBLE_FALLBACK)).otherwise(mean))
    avg_valid = F.try_divide(F.aggregate(valid, F.lit(0.0), lambda a, x: a + x), n)
    # rows without any estimate get 0 here; their result is the 9.99 fallback
    filled = [F.coalesce(F.col(c).cast("double"), avg_valid, F.lit(0.0)).alias(f"_f_{c}") for c in cols]
    tmp = df.withColumn("_n_valid", n).select("*", *filled)
    fc = [f"_f_{c}" for c in cols]
    tmp = tmp.withColumns({"_min": F.least(*fc), "_max": F.greatest(*fc)})
    pred = model.transform(tmp)
    res = F.when(F.col("_n_valid") == 0, F.lit(ENSEMBLE_FALLBACK)).otherwise(
        F.greatest(F.lit(0.0), F.col("prediction")))
    return pred.withColumn(out, res).drop(*fc, "_min", "_max", "_n_valid", "features", "prediction")


def fit_stacker(df: DataFrame, cols: Sequence[str] = ("specialist", "frontier", "random_forest"),
                label: str = "truth", reg_param: float = 1e-6):
    """Linear stacker over the estimates plus their Min and Max.

    Min/Max are collinear with the inputs, so a tiny ridge term keeps the
    normal equations solvable.  Returns a ``PipelineModel`` used by
    :func:`ensemble_price`.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    valid = F.array_compact(F.array(*[F.col(c).cast("double") for c in cols]))
    avg_valid = F.try_divide(F.aggregate(valid, F.lit(0.0), lambda a, x: a + x), F.size(valid))
    fc = [f"_f_{c}" for c in cols]
    tr = df.where(F.size(valid) > 0).select(
        F.col(label).cast("double").alias("label"),
        *[F.coalesce(F.col(c).cast("double"), avg_valid).alias(f) for c, f in zip(cols, fc)])
    tr = tr.withColumns({"_min": F.least(*fc), "_max": F.greatest(*fc)})
    asm = VectorAssembler(inputCols=[*fc, "_min", "_max"], outputCol="features")
    lr = LinearRegression(featuresCol="features", labelCol="label", regParam=reg_param,
                          elasticNetParam=0.0, solver="normal")
    return Pipeline(stages=[asm, lr]).fit(tr)


def price_panel(df: DataFrame, cols: Sequence[str] = ("specialist", "frontier", "random_forest"),
                ensemble: str = "ensemble") -> DataFrame:
    """Round each estimate to cents (half-even, as Python ``round``); when the
    ensemble is missing use the mean of the available rounded estimates (R7)."""
    rounded = [python_round(c, 2).alias(c) for c in cols]
    out = df.select(*[c for c in df.columns if c not in cols and c != ensemble], *rounded,
                    python_round(ensemble, 2).alias("_ens"))
    avail = F.array_compact(F.array(*[F.col(c) for c in cols]))
    mean = F.when(F.size(avail) > 0, F.aggregate(avail, F.lit(0.0), lambda a, x: a + x) / F.size(avail))
    return out.withColumn(ensemble, F.coalesce(F.col("_ens"), mean)).drop("_ens")


# Reply parsing.
NUMBER = r"[-+]?\d*\.\d+|\d+"
PRICE_PREFIX = "Price is $"


def _num(text: Column) -> Column:
    m = F.regexp_extract(text, f"({NUMBER})", 1)
    return F.when(m != "", m.try_cast("double"))


def extract_price(df: DataFrame, col: str = "text", out: str = "price", layered: bool = False) -> DataFrame:
    """Number in a model reply (R20; R21 with ``layered``).

    Simple: drop '$' and ',', first number, else 0 ('-7' gives 7).
    Layered: after the 'Price is $' prefix -> after a '$' -> after
    price/cost/value -> any number -> 0.
    """
    t = F.col(col)
    if not layered:
        v = _num(F.replace(F.replace(t, F.lit("$"), F.lit("")), F.lit(","), F.lit("")))
        return df.withColumn(out, F.coalesce(v, F.lit(0.0)))
    after = F.when(F.instr(t, PRICE_PREFIX) > 0,
                   F.replace(F.element_at(F.split(t, r"Price is \$"), 2), F.lit(","), F.lit("")))
    dollar = F.regexp_extract(t, r"\$\s*([\d,]+\.?\d*|\d*\.?\d+)", 1)
    kw = F.regexp_extract(F.lower(t), r"(?:price|cost|value)[^\d]*?([\d,]+\.?\d*|\d*\.?\d+)", 1)

    def clean(m):
        return F.when(m != "", F.replace(m, F.lit(","), F.lit("")).try_cast("double"))

    v = F.coalesce(_num(after), clean(dollar), clean(kw), _num(t), F.lit(0.0))
    return df.withColumn(out, v)


CONTEXT_HEADER = ("To provide some context, here are some other items that might be similar to "
                  "the item you need to estimate.\n\n")
QUESTION_LEAD = "And now the question for you:\n\nHow much does this cost?\n\n"
SYSTEM_MESSAGE = "You estimate prices of items. Reply only with the price, no explanation"


def retrieval_prompts(df: DataFrame, text: str = "text", neighbors: str = "neighbors",
                      out: str = "messages") -> DataFrame:
    """System / user / assistant-prefix messages with neighbour context.

    Prices are printed with two decimals after half-even rounding, as Python
    formats them.
    """
    lines = F.transform(F.col(neighbors), lambda n: F.concat(
        F.lit("Potentially related product:\n"), n["item"], F.lit("\nPrice is $"),
        F.format_string("%.2f", python_round(n["price"], 2)), F.lit("\n\n")))
    user = F.concat(F.lit(CONTEXT_HEADER), F.array_join(lines, ""), F.lit(QUESTION_LEAD), F.col(text))
    msg = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_MESSAGE).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.lit(PRICE_PREFIX).alias("content")))
    return df.withColumn(out, msg)


def rf_price(train: DataFrame, score: DataFrame, features: str = "features", label: str = "price",
             seed: int = 42, num_trees: int = 50, out: str = "random_forest_price") -> DataFrame:
    """Random-forest regression on an embedding column, floor 0."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    tr = train.select(array_to_vector(F.col(features)).alias("_x"), F.col(label).cast("double").alias("_y"))
    model = RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=num_trees, seed=seed).fit(tr)
    sc = score.withColumn("_x", array_to_vector(F.col(features)))
    return model.transform(sc).withColumn(out, F.greatest(F.lit(0.0), F.col("prediction"))).drop("_x", "prediction")
