"""Fixture views: the reference's tables expressed over the driver tables.

Each view exists twice - as a lazy Spark DataFrame and as the DuckDB SQL the
oracle uses - and the two must stay expression-for-expression identical.
The driver tables hold no NULLs and no duplicate lines, so those are injected
by deterministic rules (see FIXTURES.md section 3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.sizing import partitions_by_size, spread

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------------
# retail_lines: one row per invoice line (Online-Retail shape)
# --------------------------------------------------------------------------

def retail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    # as many partitions as the lines' size asks for, so that a task of the joins and of
    # what follows in it (a DISTINCT of wide rows) holds no more rows of a larger table
    n = partitions_by_size(lines)
    li = lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
                      "l_returnflag").repartition(n, "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # nation is a fixed 25-row dimension; broadcasting it is always safe.
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name").repartition(n, "p_partkey")

    # Resolve the order header first (orders << lineitem), then one join
    # of the line table against it, then the part name.
    head = (orders.join(cust, orders.o_custkey == cust.c_custkey)
                  .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
                  .select("o_orderkey", "o_custkey", "o_orderdate", "n_name").repartition(n, "o_orderkey"))
    j = (li.join(head, li.l_orderkey == head.o_orderkey)
           .join(part, li.l_partkey == part.p_partkey))
    return j.select(
        F.col("l_orderkey").alias("invoice"),
        F.col("l_partkey").alias("stock_code"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string"))
         .otherwise(F.col("p_name")).alias("description"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), -F.col("l_quantity"))
         .otherwise(F.col("l_quantity")).cast("int").alias("quantity"),
        F.col("o_orderdate").alias("invoice_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_extendedprice").alias("amount"),
        F.when(F.col("o_custkey") % 50 == 0, F.lit(None).cast("long"))
         .otherwise(F.col("o_custkey")).alias("customer_id"),
        F.col("n_name").alias("country"),
    )


RETAIL_LINES_SQL = """
SELECT l.l_orderkey AS invoice,
       l.l_partkey AS stock_code,
       CASE WHEN l.l_linenumber = 7 THEN NULL ELSE p.p_name END AS description,
       CAST(CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber = 1 THEN -l.l_quantity
                 ELSE l.l_quantity END AS INTEGER) AS quantity,
       o.o_orderdate AS invoice_date,
       l.l_extendedprice / l.l_quantity AS price,
       l.l_extendedprice AS amount,
       CASE WHEN o.o_custkey % 50 = 0 THEN NULL ELSE o.o_custkey END AS customer_id,
       n.n_name AS country
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN part p ON l.l_partkey = p.p_partkey
"""


def retail_lines_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """retail_lines plus an exact copy of every line of invoices divisible by 10."""
    rl = retail_lines(spark, sf_dir)
    # one scan: every row once, lines of invoices divisible by 10 twice
    copies = F.when(F.col("invoice") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rl.withColumn("_copy", F.explode(copies)).drop("_copy")


RETAIL_LINES_DUP_SQL = """
SELECT * FROM retail_lines UNION ALL SELECT * FROM retail_lines WHERE invoice % 10 = 0
"""


# --------------------------------------------------------------------------
# store_sales / store (Rossmann shape)
# --------------------------------------------------------------------------

def store_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_extendedprice", "l_orderkey", "l_discount"))
    return li.groupBy(F.col("l_suppkey").alias("store"),
                      F.to_date("l_shipdate").alias("date")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("sales"),
        F.countDistinct("l_orderkey").alias("customers"),
        F.max(F.when(F.col("l_discount") >= 0.08, 1).otherwise(0)).alias("promo"),
    ).withColumn("open", F.lit(1))


STORE_SALES_SQL = """
SELECT l_suppkey AS store, CAST(l_shipdate AS DATE) AS date,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sales,
       COUNT(DISTINCT l_orderkey) AS customers,
       MAX(CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END) AS promo,
       1 AS open
FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)
"""


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    letters = F.array(*[F.lit(x) for x in "abcd"])
    no_comp = k % 5 == 0
    no_p2 = k % 2 == 0
    return s.select(
        k.alias("store"),
        F.element_at(letters, (F.col("s_nationkey") % 4 + 1).cast("int")).alias("store_type"),
        F.element_at(letters, (F.col("s_nationkey") % 3 + 1).cast("int")).alias("assortment"),
        F.when(k % 7 == 0, F.lit(None).cast("double")).otherwise(F.abs("s_acctbal")).alias("competition_distance"),
        F.when(no_comp, F.lit(None)).otherwise(k % 12 + 1).cast("int").alias("competition_open_since_month"),
        F.when(no_comp, F.lit(None)).otherwise(k % 4 + 1996).cast("int").alias("competition_open_since_year"),
        (k % 2).cast("int").alias("promo2"),
        F.when(no_p2, F.lit(None)).otherwise(k % 52 + 1).cast("int").alias("promo2_since_week"),
        F.when(no_p2, F.lit(None)).otherwise(k % 3 + 2009).cast("int").alias("promo2_since_year"),
        F.when(no_p2, F.lit(None).cast("string")).otherwise(F.lit("Jan,Apr,Jul,Oct")).alias("promo_interval"),
    )


STORE_SQL = """
SELECT s_suppkey AS store,
       (['a','b','c','d'])[CAST(s_nationkey % 4 + 1 AS INTEGER)] AS store_type,
       (['a','b','c','d'])[CAST(s_nationkey % 3 + 1 AS INTEGER)] AS assortment,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE abs(s_acctbal) END AS competition_distance,
       CAST(CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey % 12 + 1 END AS INTEGER) AS competition_open_since_month,
       CAST(CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey % 4 + 1996 END AS INTEGER) AS competition_open_since_year,
       CAST(s_suppkey % 2 AS INTEGER) AS promo2,
       CAST(CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_suppkey % 52 + 1 END AS INTEGER) AS promo2_since_week,
       CAST(CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_suppkey % 3 + 2009 END AS INTEGER) AS promo2_since_year,
       CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'Jan,Apr,Jul,Oct' END AS promo_interval
FROM supplier
"""


# --------------------------------------------------------------------------
# events, points, panels, texts
# --------------------------------------------------------------------------

def event_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("customer_id"), F.col("event_id").alias("invoice"),
        F.col("ts").alias("invoice_date"), F.col("value").alias("amount"))


EVENT_PURCHASES_SQL = """
SELECT user_id AS customer_id, event_id AS invoice, ts AS invoice_date, value AS amount
FROM events WHERE event_type = 'purchase'
"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nullable price estimates per part (ensemble input)."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    price = F.col("p_retailprice")
    none = k % 30 == 1
    nul = F.lit(None).cast("double")
    return p.select(
        k.alias("request_id"),
        F.when(none, nul).otherwise(price).alias("specialist"),
        F.when(none | (k % 3 == 0), nul).otherwise(price * 1.1).alias("frontier"),
        F.when(none | (k % 5 == 0), nul).otherwise(price * 0.8).alias("random_forest"),
    )


PANEL_SQL = """
SELECT p_partkey AS request_id,
       CASE WHEN p_partkey % 30 = 1 THEN NULL ELSE p_retailprice END AS specialist,
       CASE WHEN p_partkey % 30 = 1 OR p_partkey % 3 = 0 THEN NULL ELSE p_retailprice * 1.1 END AS frontier,
       CASE WHEN p_partkey % 30 = 1 OR p_partkey % 5 = 0 THEN NULL ELSE p_retailprice * 0.8 END AS random_forest
FROM part
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and guess per part (scorer input)."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"),
        F.col("p_retailprice").alias("truth"),
        F.when(F.col("p_partkey") % 40 == 0, F.lit(-1.0))
         .otherwise(F.col("p_retailprice") + (F.col("p_size") - 25) * 10.0).alias("guess"))


SCORED_SQL = """
SELECT p_partkey AS id, p_name AS title, p_retailprice AS truth,
       CASE WHEN p_partkey % 40 = 0 THEN -1.0 ELSE p_retailprice + (p_size - 25) * 10.0 END AS guess
FROM part
"""


def item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"),
                    F.concat_ws(" ", F.col("p_name"), F.lower(F.col("p_type")), F.col("p_brand")).alias("text"),
                    F.col("p_retailprice").alias("price"))


ITEM_TEXTS_SQL = """
SELECT p_partkey AS id, concat_ws(' ', p_name, lower(p_type), p_brand) AS text, p_retailprice AS price
FROM part
"""


def store_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text store-sales requests built from supplier rows.

    'Store {id} type {t}, {basic|extended|extra} assortment, competition at
    {n} meters, promo on {yyyy-MM-dd}', clauses dropped by s_suppkey % 4.
    """
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    letters = F.array(*[F.lit(x) for x in "abcd"])
    kinds = F.array(F.lit("basic"), F.lit("extended"), F.lit("extra"))
    m = k % 4
    day = F.date_add(F.lit("1996-01-01").cast("date"), (k * 37 % 1500).cast("int"))
    text = F.concat_ws(
        ", ",
        F.concat(F.lit("Store "), k.cast("string"), F.lit(" type "),
                 F.element_at(letters, (F.col("s_nationkey") % 4 + 1).cast("int"))),
        F.when(m != 1, F.concat(F.element_at(kinds, (k % 3 + 1).cast("int")), F.lit(" assortment"))),
        F.when(m != 2, F.concat(F.lit("competition at "), (k * 113 % 20000).cast("string"), F.lit(" meters"))),
        F.when(m != 3, F.concat(F.lit("promo on "), F.date_format(day, "yyyy-MM-dd"))),
    )
    return s.select(k.alias("request_id"), text.alias("text"))


STORE_REQUESTS_SQL = """
SELECT s_suppkey AS request_id,
       concat_ws(', ',
         'Store ' || CAST(s_suppkey AS VARCHAR) || ' type ' || (['a','b','c','d'])[CAST(s_nationkey % 4 + 1 AS INTEGER)],
         CASE WHEN s_suppkey % 4 <> 1 THEN (['basic','extended','extra'])[CAST(s_suppkey % 3 + 1 AS INTEGER)] || ' assortment' END,
         CASE WHEN s_suppkey % 4 <> 2 THEN 'competition at ' || CAST(s_suppkey * 113 % 20000 AS VARCHAR) || ' meters' END,
         CASE WHEN s_suppkey % 4 <> 3 THEN 'promo on ' || strftime(DATE '1996-01-01' + CAST(s_suppkey * 37 % 1500 AS INTEGER), '%Y-%m-%d') END
       ) AS text
FROM supplier
"""

# Edge-case chat messages that the driver texts lack (the
# routing words never occur in `conversations`).
EDGE_MESSAGES = [
    "Perform customer segmentation", "How much is a red mug", "Price for wooden box",
    "help", "hello", "", "What is the cost of a glass vase", "Value of a silver set worth it?",
]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of `conversations` plus the edge messages (ids < 0)."""
    conv = table(spark, sf_dir, "conversations").where(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.col("text"))
    edge = spark.createDataFrame([(-(i + 1), t) for i, t in enumerate(EDGE_MESSAGES)],
                                 "message_id long, text string")
    return conv.unionByName(edge)


MESSAGES_SQL = "SELECT conv_id * 1000 + turn AS message_id, text FROM conversations WHERE role = 'user' UNION ALL " + \
    " UNION ALL ".join(
        f"SELECT CAST({-(i + 1)} AS BIGINT), '{t.replace(chr(39), chr(39) * 2)}'" for i, t in enumerate(EDGE_MESSAGES))

# Model replies with the number shapes the parsers must handle.
EDGE_REPLIES = ["Price is $1,299.50", "$.99", "about 12", "-7", "none",
                "The estimate: Price is $45.00 for this", "It would cost $ 12.5 or so",
                "price: 3", "value 14.75 dollars"]


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns of `conversations` plus edge replies (ids < 0)."""
    conv = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"), F.col("text"))
    edge = spark.createDataFrame([(-(i + 1), t) for i, t in enumerate(EDGE_REPLIES)] + [(-100, None)],
                                 "reply_id long, text string")
    return conv.unionByName(edge)


REPLIES_SQL = "SELECT conv_id * 1000 + turn AS reply_id, text FROM conversations WHERE role = 'assistant' UNION ALL " + \
    " UNION ALL ".join(
        f"SELECT CAST({-(i + 1)} AS BIGINT), '{t}'" for i, t in enumerate(EDGE_REPLIES)) + \
    " UNION ALL SELECT CAST(-100 AS BIGINT), CAST(NULL AS VARCHAR)"


# Reply shapes for the lenient JSON extraction.
EDGE_JSON = [
    '{"renamed_clusters": {"0": "Loyal"}, "descriptions": {"0": "d"}, "strategies": {"0": "s"}}',
    'Here you go: {"renamed_clusters": {}, "descriptions": {}, "strategies": {}} hope it helps',
    'List: [1, 2, 3] end',
    '{broken',
    '[{"a": 1}]',
    '{"a": 1} and {"b": 2}',
    'text [1, 2',
]


def json_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns of `conversations` plus JSON-shaped edge replies."""
    conv = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"), F.col("text"))
    edge = spark.createDataFrame([(-(i + 1), t) for i, t in enumerate(EDGE_JSON)] + [(-100, None)],
                                 "reply_id long, text string")
    return conv.unionByName(edge)


JSON_REPLIES_SQL = "SELECT conv_id * 1000 + turn AS reply_id, text FROM conversations WHERE role = 'assistant' UNION ALL " + \
    " UNION ALL ".join(
        f"SELECT CAST({-(i + 1)} AS BIGINT), '{t}'" for i, t in enumerate(EDGE_JSON)) + \
    " UNION ALL SELECT CAST(-100 AS BIGINT), CAST(NULL AS VARCHAR)"


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product records: part title/price with a document as description.

    description = the lines of document ``doc_id = p_partkey``; features =
    [type, brand]; details = 'Item Number {partkey}{size}' or NULL for odd keys.
    Parts without a document get an empty description.
    """
    p = table(spark, sf_dir, "part")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    j = p.join(d, p.p_partkey == d.doc_id, "left")
    return j.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"),
        F.when(F.col("text").isNull(), F.array().cast("array<string>"))
         .otherwise(F.split(F.col("text"), "\n")).alias("description"),
        F.array(F.col("p_type"), F.col("p_brand")).alias("features"),
        F.when(F.col("p_partkey") % 2 == 0,
               F.concat(F.lit('"Item Number": "'), F.col("p_partkey").cast("string"),
                        F.col("p_size").cast("string"), F.lit('", "Batteries Required?": "No"')))
         .alias("details"),
        F.col("p_retailprice").alias("price"))


PRODUCTS_SQL = """
SELECT p_partkey AS id, p_name AS title,
       CASE WHEN d.text IS NULL THEN CAST([] AS VARCHAR[]) ELSE string_split(d.text, chr(10)) END AS description,
       [p_type, p_brand] AS features,
       CASE WHEN p_partkey % 2 = 0 THEN '"Item Number": "' || CAST(p_partkey AS VARCHAR) || CAST(p_size AS VARCHAR)
            || '", "Batteries Required?": "No"' END AS details,
       p_retailprice AS price
FROM part LEFT JOIN documents d ON p_partkey = d.doc_id
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-d labelled embedding vectors (k-NN and clustering input)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"),
                    F.col("label"))


VIEW_SQL = {
    "retail_lines": RETAIL_LINES_SQL,
    "retail_lines_dup": RETAIL_LINES_DUP_SQL,
    "store_sales": STORE_SALES_SQL,
    "store": STORE_SQL,
    "event_purchases": EVENT_PURCHASES_SQL,
    "panel": PANEL_SQL,
    "scored": SCORED_SQL,
    "item_texts": ITEM_TEXTS_SQL,
    "store_requests": STORE_REQUESTS_SQL,
    "messages": MESSAGES_SQL,
    "replies": REPLIES_SQL,
    "products": PRODUCTS_SQL,
    "json_replies": JSON_REPLIES_SQL,
}

VIEWS = {
    "retail_lines": retail_lines,
    "retail_lines_dup": retail_lines_dup,
    "store_sales": store_sales,
    "store": store,
    "event_purchases": event_purchases,
    "panel": panel,
    "scored": scored,
    "item_texts": item_texts,
    "store_requests": store_requests,
    "messages": messages,
    "replies": replies,
    "products": products,
    "json_replies": json_replies,
    "points": points,
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the fixture views it needs as CTEs (in order)."""
    need = list(names)
    if "retail_lines_dup" in need and "retail_lines" not in need:
        need.insert(0, "retail_lines")
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in need)
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{sql[15:]}"
    if sql.upper().startswith("WITH "):
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"


__all__ = ["table", "with_views", "VIEWS", "VIEW_SQL"]
