"""Domain tables as views on the driver's tables, for Spark and as SQL.

``as_of`` is fixed, so that results repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-03-15 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _articles(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    kind = F.col("event_type")
    score = F.floor((F.col("value") - 245) / 246 * 10000 + 0.5) / 10000
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("symbol_id"),
        F.col("ts").cast("timestamp").alias("published_at"),
        F.when(kind != "view", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))).alias("score"),
        F.when(kind == "purchase", "10-K").when(kind == "signup", "8-K").when(kind == "error", "NT 10-K").alias("form_type"),
        kind.alias("source_name"),
        "props",
        *more,
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored and unscored articles, from ``events``."""
    return _articles(spark, sf_dir)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols from ``customer``; the industry is a word of a part's name."""
    industry = table(spark, sf_dir, "part").select("p_partkey", F.get(F.split("p_name", " "), F.lit(1)).alias("industry"))
    return (
        table(spark, sf_dir, "customer").join(industry, F.col("c_custkey") == F.col("p_partkey"), "left")
        .select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("company_name"), (F.col("c_acctbal") > 0).alias("status"),
            F.col("c_nationkey").alias("exchange"), "industry", F.col("c_mktsegment").alias("sector"), F.col("c_acctbal").alias("balance"),
        )
    )


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds from ``orders``; the priority gives type and address."""
    kind, key = F.left("o_orderpriority", F.lit(1)), F.col("o_orderkey")
    path = F.when(kind == "1", "press/rss").when(kind == "2", "atom.xml").when(kind == "3", "investors").when(kind == "4", "nasdaq.com/market-activity").otherwise("news")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_custkey").alias("symbol_id"), (F.col("o_orderstatus") != "F").alias("is_active"),
        F.when(kind == "2", "atom").when(kind == "3", "html").otherwise("rss").alias("feed_type"),
        F.concat(F.lit("https://www"), key % 7, F.lit(".example."), F.when(key % 2 == 0, "com").otherwise("net"), F.lit("/"), path, F.lit("/"), key).alias("feed_url"),
        F.col("o_orderdate").alias("added_at"),
    )


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued symbols: the customers of highest balance."""
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 8000")
    return rich.select(F.col("c_custkey").alias("id"), (F.floor(F.col("c_acctbal")) % 50 + 1).cast("int").alias("rank"), as_of().alias("added_at"))


#: Forms that ``filings`` gives out in turn.
FORMS = ("10-K", "10-Q", "8-K", "8-K/A", "4", "SC 13D", "SC 13G/A", "S-3", "424B5", "NT 10-K", "NT 10-Q", "10-K/A")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings from ``events``, of all forms in turn."""
    key, value = F.col("id"), F.col("value")
    form = F.get(F.array(*map(F.lit, FORMS)), (key % len(FORMS)).cast("int"))
    return _articles(spark, sf_dir, "value").select(
        "id", "symbol_id", form.alias("form_type"), "published_at", "score", F.concat(form, F.lit(" of "), key).alias("title"), F.col("source_name").alias("article_summary"),
        F.when(F.col("source_name") == "purchase", value * 10_000).otherwise(0.0).alias("bought"), F.when(F.col("source_name") == "error", value * 10_000).otherwise(0.0).alias("sold"),
        F.concat(F.lit('{"Revenue":"$'), F.floor(value).cast("long"), F.lit('M","operating_cash_flow":"'), key % 500, F.lit('","capex":"2B","_note":"9"}')).alias("extracted_facts"),
    )


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News and filings: of five articles, three are filings."""
    form = F.when(F.col("id") % 5 < 3, F.col("form_type"))
    return filings(spark, sf_dir).select("id", "symbol_id", form.alias("form_type"), "published_at", "score")


def rated_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with a stored multiplier of their own, for some, and the date of the last annual report."""
    key = F.col("id")
    ai = F.when(key % 7 > 0, 1 + (key % 9) * 0.05)
    return symbols(spark, sf_dir).withColumns({"ai_multiplier": ai, "last_10k_filed": F.when(key % 3 > 0, as_of() - F.make_dt_interval((key % 1100).cast("int")))})


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with text, from ``documents``, one an hour."""
    key = F.col("doc_id")
    return documents(spark, sf_dir).select(
        key.alias("id"), (key % 97).alias("symbol_id"), (key * 7).alias("feed_id"), "title", F.col("text").alias("full_text"), F.left("text", F.lit(300)).alias("summary"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), key)).alias("published_at"), F.col("source").alias("source_name"), "lang",
        F.concat(F.lit("https://news.example.org/0/"), F.col("lang"), F.lit("/"), F.sha2("text", 256)).alias("url"), ((F.col("n_chars") % 201 - 100) / 100).alias("score"),
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector and industry multipliers, from ``part``."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("sector_name"), F.col("p_name").alias("industry_name")).agg(
        (1 + F.max("p_size") / 1000.0).alias("multiplier")
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a title (the first line) and a place in time."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", "source", "n_chars", F.get(F.split("text", "\n"), F.lit(0)).alias("title")
    )


SQL = f"""WITH articles AS (
  SELECT event_id AS id, user_id AS symbol_id, ts AS published_at, event_type AS source_name, props,
    CASE WHEN event_type <> 'view' THEN greatest(-1.0, least(1.0, floor((value - 245) / 246 * 10000 + 0.5) / 10000)) END AS score,
    CASE event_type WHEN 'purchase' THEN '10-K' WHEN 'signup' THEN '8-K' WHEN 'error' THEN 'NT 10-K' END AS form_type
  FROM events),
symbols AS (
  SELECT c_custkey AS id, c_name AS company_name, c_acctbal > 0 AS status, c_nationkey AS exchange,
    split_part(p_name, ' ', 2) AS industry, c_mktsegment AS sector, c_acctbal AS balance
  FROM customer LEFT JOIN part ON p_partkey = c_custkey),
feeds AS (
  SELECT o_orderkey AS id, o_custkey AS symbol_id, o_orderstatus <> 'F' AS is_active, CASE left(o_orderpriority, 1) WHEN '2' THEN 'atom' WHEN '3' THEN 'html' ELSE 'rss' END AS feed_type,
    'https://www' || o_orderkey % 7 || '.example.' || CASE WHEN o_orderkey % 2 = 0 THEN 'com' ELSE 'net' END || '/' || CASE left(o_orderpriority, 1) WHEN '1' THEN 'press/rss' WHEN '2' THEN 'atom.xml'
      WHEN '3' THEN 'investors' WHEN '4' THEN 'nasdaq.com/market-activity' ELSE 'news' END || '/' || o_orderkey AS feed_url, o_orderdate AS added_at
  FROM orders),
queue AS (SELECT c_custkey AS id, (floor(c_acctbal)::BIGINT % 50 + 1)::INT AS rank, TIMESTAMP '{AS_OF}' AS added_at FROM customer WHERE c_acctbal > 8000),
macro AS (SELECT p_type AS sector_name, p_name AS industry_name, 1 + max(p_size) / 1000.0 AS multiplier FROM part GROUP BY 1, 2),
docs AS (SELECT doc_id, text, lang, source, n_chars, split_part(text, chr(10), 1) AS title FROM documents),
stories AS (
  SELECT doc_id AS id, doc_id % 97 AS symbol_id, doc_id * 7 AS feed_id, title, text AS full_text, left(text, 300) AS summary, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS published_at, source AS source_name, lang,
    'https://news.example.org/0/' || lang || '/' || sha256(text) AS url, (n_chars % 201 - 100) / 100 AS score
  FROM docs),
filings AS (
  SELECT id, symbol_id, form_type, published_at, score, form_type || ' of ' || id AS title, source_name AS article_summary, CASE WHEN source_name = 'purchase' THEN value * 10000 ELSE 0 END AS bought,
    CASE WHEN source_name = 'error' THEN value * 10000 ELSE 0 END AS sold, floor(value)::BIGINT AS revenue, id % 500 AS cash_flow
  FROM (SELECT * REPLACE (({list(FORMS)!r})[id % {len(FORMS)} + 1] AS form_type), value FROM articles JOIN events ON event_id = id)),
mixed AS (SELECT id, symbol_id, CASE WHEN id % 5 < 3 THEN form_type END AS form_type, published_at, score FROM filings),
rated_symbols AS (
  SELECT *, CASE WHEN id % 7 > 0 THEN 1 + (id % 9) * 0.05::DOUBLE END AS ai_multiplier, CASE WHEN id % 3 > 0 THEN TIMESTAMP '{AS_OF}' - to_days((id % 1100)::INT) END AS last_10k_filed FROM symbols),
aged AS (SELECT *, date_diff('microsecond', published_at, TIMESTAMP '{AS_OF}') / 1e6 / 3600 AS hours FROM articles),
weighted AS (SELECT *, CASE WHEN hours <= 730.56 THEN 1.0 ELSE exp(-0.0007 * (hours - 730.56)) END AS w FROM aged)
"""
