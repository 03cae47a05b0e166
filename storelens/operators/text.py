"""Text operators: product curation, prompts, reply parsing, routing
(R16-R18, R22, R23).

All are column expressions over whole texts (no truncation beyond what the
rule itself specifies), so they run inside the scan's codegen stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.functions.exprs import ordered_when, py_round
from storelens.functions.sizing import spread

# Product-text curation limits and removals.
MIN_CHARS = 300
CEILING_CHARS = 1120            # 160 tokens x 7 characters
FALLBACK_CHARS = CEILING_CHARS // 2
REMOVALS = ['"Batteries Included?": "No"', '"Batteries Included?": "Yes"',
            '"Batteries Required?": "No"', '"Batteries Required?": "Yes"', "By Manufacturer",
            "Item", "Date First", "Package", ":", "Number of", "Best Sellers", "Number", "Product "]
ITEM_QUESTION = "How much does this cost to the nearest dollar?"
RETAIL_QUESTION = "How much does this retail item cost to the nearest dollar?"
PRICE_PREFIX = "Price is $"

# Python's str whitespace (what ``re`` \s and ``str.split()`` use), spelled
# out so that Java and RE2 match the same characters.
PY_WS = (r"\t\n\x0b\x0c\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
SCRUB_CLASS = r'[:\[\]"{}【】' + PY_WS + "]+"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` (all Unicode whitespace, both ends)."""
    return F.regexp_replace(c, f"^[{PY_WS}]+|[{PY_WS}]+$", "")


def scrub(c: Column) -> Column:
    """Collapse separators to one space, repair commas, drop words of 7+
    characters that hold a digit."""
    s = strip_ws(F.regexp_replace(c, SCRUB_CLASS, " "))
    s = F.replace(F.replace(F.replace(s, F.lit(" ,"), F.lit(",")), F.lit(",,,"), F.lit(",")),
                  F.lit(",,"), F.lit(","))
    kept = F.filter(F.split(s, " "), lambda w: (F.length(w) < 7) | ~w.rlike("[0-9]"))
    return F.array_join(kept, " ")


def scrub_details(c: Column) -> Column:
    out = c
    for r in REMOVALS:
        out = F.replace(out, F.lit(r), F.lit(""))
    return out


def curate_items(df: DataFrame, title: str = "title", description: str = "description",
                 features: str = "features", details: str = "details") -> DataFrame:
    """Curated product text (R16), character-based path.

    contents = description lines + feature lines + scrubbed details (each
    block newline-terminated); kept when longer than 300 characters, cut to
    1120, text = scrub(title) + newline + scrub(contents); included when text
    is longer than 300 characters; ``text`` keeps the first 560 characters,
    ``token_count`` = len(full text) div 4.
    """
    df = spread(df)
    desc = F.array_join(F.coalesce(F.col(description), F.array().cast("array<string>")), "\n")
    feat = F.array_join(F.coalesce(F.col(features), F.array().cast("array<string>")), "\n")
    det = F.col(details)
    contents = F.concat(
        F.when(desc != "", F.concat(desc, F.lit("\n"))).otherwise(""),
        F.when(feat != "", F.concat(feat, F.lit("\n"))).otherwise(""),
        F.when(det.isNotNull() & (det != ""), F.concat(scrub_details(det), F.lit("\n"))).otherwise(""))
    full = F.concat(scrub(F.col(title)), F.lit("\n"), scrub(F.substring(contents, 1, CEILING_CHARS)))
    include = (F.length(contents) > MIN_CHARS) & (F.length(full) > MIN_CHARS)
    return df.withColumns({
        "include": include,
        "text": F.when(include, F.substring(full, 1, FALLBACK_CHARS)),
        "token_count": F.when(include, F.floor(F.length(full) / 4).cast("int")),
    })


def price_prompts(df: DataFrame, text: str = "text", price: str = "price") -> DataFrame:
    """Training prompt, test prompt and chat-format prompt.

    The price is rounded half-even to a whole dollar, as Python ``round``.
    """
    dollars = py_round(price, 0).cast("bigint").cast("string")
    prompt = F.concat(F.lit(ITEM_QUESTION + "\n\n"), F.col(text), F.lit("\n\n" + PRICE_PREFIX), dollars, F.lit(".00"))
    base = F.substring_index(prompt, PRICE_PREFIX, 1)
    return df.withColumns({
        "prompt": prompt,
        "test_prompt": F.concat(base, F.lit(PRICE_PREFIX)),
        "chat_prompt": F.concat(F.lit("<|im_start|>user\n"), base,
                                F.lit("<|im_end|>\n<|im_start|>assistant\n" + PRICE_PREFIX)),
    })


def instruction_dataset(df: DataFrame, text: str = "description", price: str = "price",
                        n: int | None = None, key: str | None = None, seed: int = 42) -> DataFrame:
    """Instruction / response pairs and chat text for fine-tuning.

    All rows by default; with ``n`` a stable seeded sample of at most n rows
    (by ``key``) is taken first, as the reference samples 10,000 rows.
    """
    if n is not None:
        from storelens.operators.clean import stable_sample

        df = stable_sample(df, key or text, n, seed)
    instr = F.concat(F.lit(RETAIL_QUESTION + "\n\n"), F.col(text))
    resp = F.concat(F.lit(PRICE_PREFIX), F.format_string("%.2f", py_round(price, 2)))
    return df.withColumns({
        "instruction": instr, "response": resp,
        "chat_text": F.concat(F.lit("<|im_start|>user\n"), instr, F.lit("<|im_end|>\n<|im_start|>assistant\n"),
                              resp, F.lit("<|im_end|>")),
    })


# Chat routing words and description prefixes, in order.
SEGMENT_WORD = "segment"
PRICE_WORDS = ["price", "cost", "worth"]
HELP_WORD = "help"
REQUEST_PREFIXES = ["how much is", "price for", "predict price for", "price of", "cost of", "value of"]


def route_messages(df: DataFrame, text: str = "text") -> DataFrame:
    """Intent of a chat message and the product description to price.

    empty -> greeting; 'segment' -> segment; price/cost/worth -> price (the
    text after the first listed prefix found, lower-cased and stripped, else
    the message); 'help' -> help; else unknown.
    """
    t = F.col(text)
    low = F.lower(t)
    route = ordered_when([
        (t.isNull() | (t == ""), "greeting"),
        (low.contains(SEGMENT_WORD), "segment"),
        (low.contains(PRICE_WORDS[0]) | low.contains(PRICE_WORDS[1]) | low.contains(PRICE_WORDS[2]), "price"),
        (low.contains(HELP_WORD), "help"),
    ], "unknown")
    after = ordered_when(
        [(low.contains(p), strip_ws(F.substring(low, F.instr(low, p) + len(p), F.lit(1 << 30))))
         for p in REQUEST_PREFIXES], t)
    return df.withColumns({"route": route, "description": F.when(route == "price", after)})


REQUIRED_KEYS = ["renamed_clusters", "descriptions", "strategies"]


@F.pandas_udf(T.BooleanType())
def _json_valid(s):
    """Strict JSON validity, as Python ``json.loads`` decides it.

    Spark's own parsers stop after the first value and accept trailing text,
    which the reference treats as invalid.  Arrow-batched; a small helper.
    """
    import json

    import pandas as pd

    def ok(x):
        if x is None:
            return None
        try:
            json.loads(x)
            return True
        except ValueError:
            return False

    return pd.Series([ok(x) for x in s], dtype="object")


def extract_json(df: DataFrame, col: str = "text", out: str = "json_text") -> DataFrame:
    """Lenient JSON extraction from a model reply.

    The whole text if it is valid JSON; else the span from the first '{' to
    the last '}' if valid (else NULL); else first '[' to last ']' if valid;
    else NULL.  ``has_required`` tells whether it is an object holding
    renamed_clusters, descriptions and strategies.
    """
    t = F.col(col)
    obj = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    arr = F.regexp_extract(t, r"(?s)(\[.*\])", 1)

    def valid(x):
        return _json_valid(x)

    chosen = F.when(valid(t), t).when(obj != "", F.when(valid(obj), obj)) \
              .when(arr != "", F.when(valid(arr), arr))
    keys = F.json_object_keys(F.col(out))
    has = F.lit(True)
    for k in REQUIRED_KEYS:
        has = has & F.coalesce(F.array_contains(keys, k), F.lit(False))
    return df.withColumn(out, chosen).withColumn("has_required", has)
