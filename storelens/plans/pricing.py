"""Pricing, text and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.operators import evaluate as EV
from storelens.operators import price as P
from storelens.operators import profile as PR
from storelens.operators import text as TX
from storelens.functions.exprs import py_round, py_round_sql
from storelens.plans.catalog import register
from storelens.plans.retail import CLEAN_SQL, clean_lines
from storelens.sources.fixtures import VIEWS


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any_sub(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _count_sub(col: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, '{w}') AS INTEGER)" for w in words) + ")"


KEYWORD_SQL = f"""
WITH w AS (SELECT id, text, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS ws FROM item_texts),
p AS (SELECT id, text, CAST(greatest(1.0, least(5.0 + CASE WHEN len(ws) > 10 THEN 2.5 ELSE 0.0 END
              + len(list_filter(ws, lambda x: list_contains({_sql_list(P.PREMIUM_WORDS)}, x))) * 1.25, 50.0)) AS DOUBLE) AS specialist_price
      FROM w)
SELECT id, specialist_price,
  CASE {" ".join(f"WHEN {_any_sub('lower(text)', ws)} THEN '{name}'" for name, ws in P.CATEGORIES)}
       ELSE '{P.DEFAULT_CATEGORY}' END AS category,
  CASE WHEN specialist_price < 3.0 THEN 'High' WHEN specialist_price > 15.0 THEN 'Low' ELSE 'Medium' END AS popularity,
  'Medium' AS estimated_stock
FROM p
"""


@register("keyword_price", KEYWORD_SQL, views=("item_texts",))
def q_keyword(spark, sf):
    """R10 + R11: keyword price, category and popularity per item text."""
    it = P.classify_items(P.keyword_price(VIEWS["item_texts"](spark, sf)))
    return it.select("id", "specialist_price", "category", "popularity", "estimated_stock")


def _struct_list(items) -> str:
    return "[" + ", ".join(f"{{'item': '{n}', 'price': CAST({p} AS DOUBLE)}}" for n, p in items) + "]"


def _fallback_sql(src: str) -> str:
    parts = [f"CASE WHEN {_any_sub('lower(text)', trig)} THEN {_struct_list(items)} ELSE [] END"
             for trig, items in P.FALLBACK_GROUPS]
    return f"""
f AS (SELECT *, list_concat({', '.join(parts)}) AS found FROM {src}),
nb AS (SELECT * EXCLUDE (found), list_concat(found, CASE WHEN 5 - len(found) > 0
          THEN {_struct_list(P.GENERIC_ITEMS)}[1:5 - len(found)] ELSE [] END) AS neighbors FROM f)
"""


NEIGHBOR_PRICE_SQL = f"""
WITH {_fallback_sql('item_texts').strip()},
c AS (SELECT id, text, neighbors, neighbors[1:5] AS top,
             ([1.0, 0.8, 0.6, 0.4, 0.2])[1:len(neighbors[1:5])] AS ws FROM nb),
s AS (SELECT id, text, neighbors,
        list_reduce(list_transform(list_zip(top, ws), lambda z: z[1].price * z[2]), lambda a, x: a + x, CAST(0.0 AS DOUBLE)) AS num,
        list_reduce(ws, lambda a, x: a + x, CAST(0.0 AS DOUBLE)) AS den FROM c)
SELECT id, len(neighbors) AS n_neighbors, neighbors[1].item AS first_neighbor,
  CASE WHEN len(neighbors) > 0 THEN greatest(0.99, num / den * (1.0 + ({_count_sub('lower(text)', P.NEIGHBOR_PREMIUM)}
       - {_count_sub('lower(text)', P.NEIGHBOR_BUDGET)}) * 0.15)) ELSE 9.99 END AS frontier_price
FROM s
"""


@register("neighbor_price", NEIGHBOR_PRICE_SQL, views=("item_texts",))
def q_neighbor(spark, sf):
    """R9 + R8: keyword neighbours and the rank-weighted neighbour price."""
    it = P.neighbor_price(P.fallback_neighbors(VIEWS["item_texts"](spark, sf)))
    return it.select("id", F.size("neighbors").alias("n_neighbors"),
                     F.col("neighbors")[0]["item"].alias("first_neighbor"), "frontier_price")


def _sql_text(t: str) -> str:
    """A Python string as a SQL expression (newlines via chr(10))."""
    return "(" + " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in t.split("\n")) + ")"


RETRIEVAL_SQL = f"""
WITH {_fallback_sql('item_texts').strip()}
SELECT id, 3 AS n_messages,
  {_sql_text(P.CONTEXT_HEADER)} || array_to_string(list_transform(neighbors, lambda n:
      'Potentially related product:' || chr(10) || n.item || chr(10) || 'Price is $'
      || printf('%.2f', {py_round_sql('n.price', 2)}) || chr(10) || chr(10)), '')
  || {_sql_text(P.QUESTION_LEAD)} || text AS user_prompt,
  'Price is $' AS assistant_prefix
FROM nb
"""


@register("retrieval_prompts", RETRIEVAL_SQL, views=("item_texts",))
def q_retrieval(spark, sf):
    """R9 + R19: message list with neighbour context per item text."""
    it = P.retrieval_prompts(P.fallback_neighbors(VIEWS["item_texts"](spark, sf)))
    return it.select("id", F.size("messages").alias("n_messages"),
                     F.col("messages")[1]["content"].alias("user_prompt"),
                     F.col("messages")[2]["content"].alias("assistant_prefix"))


_ENS = ("CASE WHEN len(valid) = 0 THEN 9.99 ELSE list_reduce(kept, lambda a, x: a + x, CAST(0.0 AS DOUBLE))"
        " / len(kept) END")


#: Python's round to cents: the exact binary value, printed.
_CENTS = "CAST(printf('%.2f', {}) AS DOUBLE)"


@register("ensemble_panel", f"""
WITH v AS (SELECT *, list_sort(list_filter([specialist, frontier, random_forest], lambda x: x IS NOT NULL)) AS valid FROM panel),
k AS (SELECT *, CASE WHEN len(valid) >= 3 THEN valid[2:len(valid) - 1] ELSE valid END AS kept FROM v)
SELECT request_id, {_CENTS.format('specialist')} AS specialist, {_CENTS.format('frontier')} AS frontier,
       {_CENTS.format('random_forest')} AS random_forest, {_CENTS.format(_ENS)} AS ensemble
FROM k
""", views=("panel",))
def q_ensemble(spark, sf):
    """R6 + R7: trimmed-mean ensemble of three nullable estimates, cents panel."""
    return P.price_panel(P.ensemble_price(VIEWS["panel"](spark, sf)))


NUM = r"([-+]?\d*\.\d+|\d+)"


@register("reply_prices", f"""
WITH r AS (SELECT reply_id, text,
  CASE WHEN instr(text, 'Price is $') > 0 THEN replace(split_part(text, 'Price is $', 2), ',', '') END AS after,
  regexp_extract(text, '\\$\\s*([\\d,]+\\.?\\d*|\\d*\\.?\\d+)', 1) AS dollar,
  regexp_extract(lower(text), '(?:price|cost|value)[^\\d]*?([\\d,]+\\.?\\d*|\\d*\\.?\\d+)', 1) AS kw
  FROM replies)
SELECT reply_id,
  coalesce(TRY_CAST(nullif(regexp_extract(replace(replace(text, '$', ''), ',', ''), '{NUM}', 1), '') AS DOUBLE), 0.0) AS price,
  coalesce(TRY_CAST(nullif(regexp_extract(after, '{NUM}', 1), '') AS DOUBLE),
           CASE WHEN dollar <> '' THEN TRY_CAST(replace(dollar, ',', '') AS DOUBLE) END,
           CASE WHEN kw <> '' THEN TRY_CAST(replace(kw, ',', '') AS DOUBLE) END,
           TRY_CAST(nullif(regexp_extract(text, '{NUM}', 1), '') AS DOUBLE), 0.0) AS price_layered
FROM r
""", views=("replies",))
def q_reply_prices(spark, sf):
    """R20 + R21: price pulled from model replies, simple and layered."""
    r = VIEWS["replies"](spark, sf)
    r = P.extract_price(r, "text", "price")
    r = P.extract_price(r, "text", "price_layered", layered=True)
    return r.select("reply_id", "price", "price_layered")


@register("json_extract", """
WITH c AS (SELECT reply_id, text, regexp_extract(text, '(?s)(\\{.*\\})', 1) AS obj,
                  regexp_extract(text, '(?s)(\\[.*\\])', 1) AS arr FROM json_replies),
j AS (SELECT reply_id, CASE WHEN json_valid(text) THEN text
                            WHEN obj <> '' THEN CASE WHEN json_valid(obj) THEN obj END
                            WHEN arr <> '' THEN CASE WHEN json_valid(arr) THEN arr END END AS json_text FROM c)
SELECT reply_id, json_text,
  coalesce(list_contains(json_keys(json_text), 'renamed_clusters'), false)
  AND coalesce(list_contains(json_keys(json_text), 'descriptions'), false)
  AND coalesce(list_contains(json_keys(json_text), 'strategies'), false) AS has_required
FROM j
""", views=("json_replies",))
def q_json(spark, sf):
    """Lenient JSON extraction and the required-key check."""
    return TX.extract_json(VIEWS["json_replies"](spark, sf)).select("reply_id", "json_text", "has_required")


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{TX.PY_WS}]+|[{TX.PY_WS}]+$', '', 'g')"


def _route_sql() -> str:
    low = "lower(text)"
    desc = " ".join(
        f"WHEN contains({low}, '{p}') THEN {_strip_sql(f'substr({low}, instr({low}, {chr(39)}{p}{chr(39)}) + {len(p)})')}"
        for p in TX.REQUEST_PREFIXES)
    route = (f"CASE WHEN text IS NULL OR text = '' THEN 'greeting' WHEN contains({low}, 'segment') THEN 'segment' "
             f"WHEN contains({low}, 'price') OR contains({low}, 'cost') OR contains({low}, 'worth') THEN 'price' "
             f"WHEN contains({low}, 'help') THEN 'help' ELSE 'unknown' END")
    return (f"WITH r AS (SELECT message_id, text, {route} AS route FROM messages) "
            f"SELECT message_id, route, CASE WHEN route = 'price' THEN CASE {desc} ELSE text END END AS description FROM r")


@register("route_messages", _route_sql(), views=("messages",))
def q_route(spark, sf):
    """Chat intent and the description to price."""
    return TX.route_messages(VIEWS["messages"](spark, sf)).select("message_id", "route", "description")


def _scrub_sql(x: str) -> str:
    s = _strip_sql(f"regexp_replace({x}, '{TX.SCRUB_CLASS}', ' ', 'g')")
    s = f"replace(replace(replace({s}, ' ,', ','), ',,,', ','), ',,', ',')"
    return (f"array_to_string(list_filter(string_split({s}, ' '), "
            f"lambda w: length(w) < 7 OR NOT regexp_matches(w, '[0-9]')), ' ')")


def _details_sql(x: str) -> str:
    out = x
    for r in TX.REMOVALS:
        out = f"replace({out}, '{r}', '')"
    return out


CURATE_SQL = f"""
WITH c AS (
  SELECT id, title, price,
    CASE WHEN array_to_string(description, chr(10)) <> '' THEN array_to_string(description, chr(10)) || chr(10) ELSE '' END
    || CASE WHEN array_to_string(features, chr(10)) <> '' THEN array_to_string(features, chr(10)) || chr(10) ELSE '' END
    || CASE WHEN details IS NOT NULL AND details <> '' THEN {_details_sql('details')} || chr(10) ELSE '' END AS contents
  FROM products),
f AS (SELECT *, {_scrub_sql('title')} || chr(10) || {_scrub_sql('substring(contents, 1, 1120)')} AS full_text FROM c),
i AS (SELECT *, length(contents) > 300 AND length(full_text) > 300 AS include FROM f),
t AS (SELECT id, price, include, CASE WHEN include THEN substring(full_text, 1, 560) END AS text,
             CASE WHEN include THEN CAST(floor(length(full_text) / 4) AS INTEGER) END AS token_count FROM i),
p AS (SELECT *, '{TX.ITEM_QUESTION}' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Price is $'
                || CAST(CAST({py_round_sql('price', 0)} AS BIGINT) AS VARCHAR) || '.00' AS prompt FROM t)
SELECT id, include, token_count, text, prompt,
       split_part(prompt, 'Price is $', 1) || 'Price is $' AS test_prompt,
       '<|im_start|>user' || chr(10) || split_part(prompt, 'Price is $', 1) || '<|im_end|>' || chr(10)
         || '<|im_start|>assistant' || chr(10) || 'Price is $' AS chat_prompt
FROM p
"""


@register("curated_products", CURATE_SQL, views=("products",))
def q_curate(spark, sf):
    """R16 + R17: curated product text (character path) and the three prompts."""
    c = TX.curate_items(VIEWS["products"](spark, sf))
    c = TX.price_prompts(c, "text", "price")
    return c.select("id", "include", "token_count", "text", "prompt", "test_prompt", "chat_prompt")


@register("instruction_dataset", f"""
WITH clean AS ({CLEAN_SQL.format(src='retail_lines_dup')}),
x AS (SELECT invoice, stock_code, '{TX.RETAIL_QUESTION}' || chr(10) || chr(10) || description AS instruction,
             'Price is $' || printf('%.2f', {py_round_sql('price', 2)}) AS response FROM clean)
SELECT invoice, stock_code, instruction, response,
       '<|im_start|>user' || chr(10) || instruction || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)
       || response || '<|im_end|>' AS chat_text
FROM x
""", views=("retail_lines_dup",))
def q_instructions(spark, sf):
    """Instruction / response / chat text for every cleaned line (the
    reference then samples 10,000; ``instruction_dataset(n=...)`` does that)."""
    d = TX.instruction_dataset(clean_lines(spark, sf), "description", "price", n=None)
    return d.select("invoice", "stock_code", "instruction", "response", "chat_text")


SCORE_ROWS_SQL = """
s AS (SELECT id, truth, guess AS raw_guess, abs(guess - truth) AS error,
             CASE WHEN guess <= 0 THEN 0.01 ELSE guess END AS guess,
             guess IS NULL OR truth + 1 <= 0 OR (truth = 0 AND abs(guess - truth) >= 40) AS failed FROM scored),
r AS (SELECT id, truth, error, guess, failed,
        CASE WHEN NOT failed THEN (ln(truth + 1) - ln(guess + 1)) * (ln(truth + 1) - ln(guess + 1)) END AS sle,
        CASE WHEN failed THEN NULL
             WHEN error < 40 OR error / nullif(truth, 0) < 0.2 THEN 'green'
             WHEN error < 80 OR error / nullif(truth, 0) < 0.4 THEN 'orange' ELSE 'red' END AS color FROM s)
"""


@register("score_rows", f"WITH {SCORE_ROWS_SQL.strip()} SELECT id, error, guess, round(sle, 8) AS sle, color, failed FROM r",
          views=("scored",))
def q_score_rows(spark, sf):
    """E1 + E2: per-row error, squared log error, colour and failure flag."""
    s = EV.score_predictions(VIEWS["scored"](spark, sf))
    return s.select("id", "error", "guess", py_round("sle", 8).alias("sle"), "color", "failed")


@register("score_report", f"""
WITH {SCORE_ROWS_SQL.strip()}, ok AS (SELECT * FROM r WHERE NOT failed)
SELECT (SELECT count(*) FROM r) AS tested, (SELECT count(*) FROM r WHERE failed) AS failed,
       count(*) AS success, round(avg(error), 6) AS mae, round(sqrt(avg(sle)), 8) AS rmsle,
       round(avg(CASE WHEN truth > 0 THEN error / truth ELSE error END) * 100, 6) AS mape_pct,
       round(avg(CAST(color = 'green' AS DOUBLE)) * 100, 6) AS hit_rate_pct,
       round(regr_slope(guess, truth), 6) AS trend_slope, round(regr_intercept(guess, truth), 6) AS trend_intercept,
       (SELECT error FROM ok ORDER BY error LIMIT 1 OFFSET (SELECT count(*) // 2 FROM ok)) AS median_error
FROM ok
""", views=("scored",))
def q_score_report(spark, sf):
    """E3 + E4: report over successful rows with the upper median error."""
    rep = EV.score_report(EV.score_predictions(VIEWS["scored"](spark, sf)))
    return rep.select("tested", "failed", "success", py_round("mae", 6).alias("mae"),
                      py_round("rmsle", 8).alias("rmsle"), py_round("mape_pct", 6).alias("mape_pct"),
                      py_round("hit_rate_pct", 6).alias("hit_rate_pct"),
                      py_round("trend_slope", 6).alias("trend_slope"),
                      py_round("trend_intercept", 6).alias("trend_intercept"), "median_error")


@register("score_error_histogram", f"""
WITH {SCORE_ROWS_SQL.strip()}, x AS (SELECT error / truth AS rel_error FROM r WHERE NOT failed AND truth > 0)
, d AS (SELECT CAST(rel_error AS DOUBLE) AS v FROM x WHERE rel_error IS NOT NULL AND NOT isnan(rel_error)),
rr AS (SELECT min(v) AS mn, max(v) AS mx FROM d),
c AS (SELECT least(CAST(floor(coalesce((v - mn) / nullif(mx - mn, 0), 0.0) * 20) AS INTEGER), 19) + 1 AS bin,
             count(*) AS count FROM d CROSS JOIN rr GROUP BY 1),
sp AS (SELECT CAST(range AS INTEGER) AS bin FROM range(1, 21))
SELECT sp.bin, rr.mn + (rr.mx - rr.mn) / 20 * (sp.bin - 1) AS lo, rr.mn + (rr.mx - rr.mn) / 20 * sp.bin AS hi,
       CAST(coalesce(c.count, 0) AS BIGINT) AS count
FROM sp CROSS JOIN rr LEFT JOIN c ON sp.bin = c.bin
""", views=("scored",))
def q_score_hist(spark, sf):
    """E5: 20-bin histogram of the relative error of successful rows."""
    s = EV.score_predictions(VIEWS["scored"](spark, sf))
    rel = s.where(~F.col("failed") & (F.col("truth") > 0)).select((F.col("error") / F.col("truth")).alias("rel_error"))
    return PR.histogram(rel, "rel_error", 20)


@register("python_rounding", """
WITH v AS (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS price,
                  CAST(CAST(l_partkey AS BIGINT) % 4000 * 10 + 5 AS DOUBLE) / 1000.0 * (CASE WHEN l_linenumber = 3 THEN -1 ELSE 1 END) AS half
           FROM lineitem)
SELECT l_orderkey, l_linenumber, half, CAST(printf('%.2f', price) AS DOUBLE) AS price_2,
       CAST(printf('%.2f', half) AS DOUBLE) AS half_2, CAST(printf('%.1f', half) AS DOUBLE) AS half_1 FROM v
""")
def q_python_rounding(spark, sf):
    """Python's round of prices and of doubles whose text ends in 5
    (2.675 and the like); the oracle prints the exact binary value."""
    from storelens.functions.exprs import python_round
    from storelens.sources.fixtures import table

    sign = F.when(F.col("l_linenumber") == 3, -1.0).otherwise(1.0)
    half = (F.col("l_partkey").cast("long") % 4000 * 10 + 5).cast("double") / F.lit(1000.0) * sign
    v = table(spark, sf, "lineitem").withColumns({"half": half, "price": F.col("l_extendedprice") / F.col("l_quantity")})
    return v.select("l_orderkey", "l_linenumber", "half", python_round("price", 2).alias("price_2"),
                    python_round("half", 2).alias("half_2"), python_round("half", 1).alias("half_1"))
