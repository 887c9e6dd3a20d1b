"""Facts from model output: JSON of varying shape, figures and sections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from ..functions import text as T

FIGURES = "array<struct<metric:string,value:string,period:string>>"


def model_json(col: Column | str) -> Column:
    """JSON text inside a model's answer: without fences, cut to the outer braces.

    Where closers lack, a list's and an object's are tried; null if none helps.
    """
    c = F.col(col) if isinstance(col, str) else col
    bare = F.regexp_replace(c, r"```[A-Za-z]*", "")
    cut = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    rest = F.rtrim(F.regexp_extract(bare, r"(?s)(\{.*)", 1))
    tries = [cut, *(F.concat(rest, F.lit(x)) for x in ("}", "]}", '"}', "}]}", '"]}'))]
    return F.coalesce(*(F.when((t != "") & F.try_parse_json(t).isNotNull(), t) for t in tries))


def extract_figures(df: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """Figures in millions of facts: an array, a flat object, or the top level.

    Keys that start with ``_`` are skipped; the first figure of a metric counts;
    a metric matches a key if either contains the other; numbers only.
    """
    keep = [c for c in df.columns if c != json_col]
    j = F.col(json_col)
    listed = F.from_json(F.get_json_object(j, "$.financial_figures"), FIGURES)
    listed = F.when(F.get_json_object(j, "$.financial_figures").startswith("["), listed)
    flat = lambda c: F.transform(F.map_entries(F.from_json(c, "map<string,string>")), lambda e: F.struct(e["key"].alias("metric"), e["value"].alias("value"), F.lit(None).cast("string").alias("period")))
    inner = F.get_json_object(j, "$.financial_figures")
    figures = F.coalesce(listed, F.when(inner.startswith("{"), flat(inner)), F.when(inner.isNull(), flat(j)))
    metric = F.lower(F.trim("f.metric"))
    rows = df.select(*keep, F.posexplode(figures).alias("position", "f")).select(*keep, "position", metric.alias("metric"), "f.value", "f.period").filter("metric <> '' AND NOT startswith(metric, '_')")
    wanted = F.array(*(F.lit(k.lower()) for k in keys))
    key = F.get(F.filter(wanted, lambda k: F.contains(F.col("metric"), k) | F.contains(k, F.col("metric"))), F.lit(0))
    rows = rows.withColumns({"key": key, "amount": T.parse_figure("value")}).filter("key IS NOT NULL AND amount IS NOT NULL")
    return rows.groupBy(*keep, "key").agg(F.min_by(F.struct("metric", "amount", "period"), "position").alias("x")).select(*keep, "key", "x.*")


def sections(df: DataFrame, text_col: str, table: list[tuple[str, str, str, int]]) -> DataFrame:
    """Named sections of each text, from one pass over its lines; ``table``: name, start, end, budget.

    Lines are compared trimmed and in upper case.
    """
    keep = [c for c in df.columns if c != text_col]
    found = T.find_sections(text_col, *T.section_marks(table), clean=lambda x: x)
    return df.select(*keep, F.explode(found).alias("x")).select(*keep, F.col("x.name").alias("section"), "x.body")


def filing_title(text: Column | str, fallback: Column, boilerplate: str = r"(?i)securities and exchange|washington|form \d|united states|commission file", form: Column | None = None) -> Column:
    """The first telling line after five non-blank ones, else the fallback.

    Where ``form`` says that the text is an insider's report, its title names the
    company, the insider and whether the first deal bought or sold on the market.
    """
    c = F.col(text) if isinstance(text, str) else text
    if form is not None:
        return F.when(form == "4", F.coalesce(_insider_title(c), fallback)).otherwise(filing_title(c, fallback, boilerplate))
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    good = F.filter(F.slice(lines, F.lit(6), F.greatest(F.size(lines), F.lit(1))), lambda x: (F.length(x) >= 20) & (F.length(x) <= 250) & ~x.rlike(boilerplate) & x.rlike("[a-z]"))
    return F.coalesce(F.left(F.get(good, F.lit(0)), F.lit(200)), fallback)


def _insider_title(report: Column) -> Column:
    """The title of what ``form4_text`` wrote; null where the first deal is neither a purchase nor a sale."""
    part = lambda pattern: F.regexp_extract(report, pattern, 1)
    deal = F.when(part(r"(?m)^(?:\d{4}-\d\d-\d\d)? ?(purchase|sale):") == "purchase", "Buy").when(part(r"(?m)^(?:\d{4}-\d\d-\d\d)? ?(purchase|sale):") == "sale", "Sale")
    first = part(r"(?m)^(?:\d{4}-\d\d-\d\d)? ?([a-z]+):").isin("purchase", "sale")
    company, insider = F.left(part(r"(?m)^Company: (.*)$"), F.lit(40)), F.left(part(r"(?m)^Insider: (.*)$"), F.lit(30))
    return F.when(first & deal.isNotNull(), F.concat(company, F.lit(" — Insider "), deal, F.lit(" by "), insider))


def form4_text(df: DataFrame, key: str | list[str]) -> DataFrame:
    """A report of each filing's transactions, and its totals bought and sold on the market.

    Derivatives are listed but do not count. Company and insider head the report
    where ``df`` has them.
    """
    day = F.coalesce(F.date_format("traded_at", "yyyy-MM-dd"), F.lit(""))
    held = [F.when(F.col("ownership").isNotNull(), F.concat(F.lit(" ("), "ownership", F.lit(")")))] if "ownership" in df.columns else []
    line = F.concat_ws("", F.format_string("%s %s: %s shares at %s", day, F.col("kind"), F.col("shares").cast("string"), F.col("price").cast("string")), *held)
    lines = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    heads = [F.when(F.max(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.max(c))) for c, name in (("company", "Company"), ("insider", "Insider")) if c in df.columns]
    market = ~F.col("derivative") if "derivative" in df.columns else F.lit(True)
    total = lambda code: F.coalesce(F.sum(F.when((F.col("code") == code) & market, F.col("value"))), F.lit(0.0))
    return df.groupBy(key).agg(F.concat_ws("\n", *heads, lines).alias("report"), total("P").alias("bought"), total("S").alias("sold"), F.count("*").alias("n_transactions"))


def longest_body(full: str, summary: str) -> Column:
    """The longer cleaned text, and the other where it differs."""
    a, b = F.coalesce(T.strip_html(full), F.lit("")), F.coalesce(T.strip_html(summary), F.lit(""))
    first = F.length(a) >= F.length(b)
    body, other = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    return F.struct(body.alias("body"), F.when((other != body) & (other != ""), other).alias("other"))


def scoring_payload(*columns: str) -> Column:
    """The article as JSON, without nulls and without numbers that are none."""
    return F.to_json(F.struct(*columns))


def clean_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of any shape (numbers, arrays, structs, maps) without NaN and infinite numbers."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: clean_number(F.col(c), kinds[c]) for c in columns})


def clean_number(value: Column, kind: DataType) -> Column:
    """``value`` with every NaN or infinite number inside as null."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: clean_number(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: clean_number(x, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*(clean_number(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return value


def score_articles(df: DataFrame, score: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The caller's pure scoring function, batch by batch."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield score(batch)

    return df.mapInPandas(each, schema)


def violations(summary: str, score: str, calibration: str, forecast: str, previous: Column | None = None) -> Column:
    """What is wrong with a scored row; an empty list if nothing is.

    The summary must be there and, after a former one, hold 100 signs and a
    quarter of that; the score must be a number from -1 to 1, with a calibration
    unless it is zero; the forecast must be there.
    """
    own = F.coalesce(F.trim(summary), F.lit(""))
    short = own == ""
    if previous is not None:
        before = F.length(F.coalesce(previous, F.lit("")))
        short = short | ((before > 0) & (F.length(own) < F.greatest(F.lit(100), F.floor(before / 4))))
    s = F.col(score).try_cast("double")
    return F.array_compact(
        F.array(
            F.when(short, "summary"),
            F.when(s.isNull() | F.isnan(s) | (F.abs(s) > 1), "score"),
            F.when((s != 0) & F.col(calibration).isNull(), "calibration"),
            F.when(F.coalesce(F.trim(forecast), F.lit("")) == "", "forecast"),
        )
    )


def validate_result(df: DataFrame, *, previous: str | None = None, **columns: str) -> DataFrame:
    """Add ``violations`` and ``valid``; ``columns`` name what ``violations`` takes."""
    found = violations(**columns, previous=F.col(previous) if previous else None)
    return df.withColumn("violations", found).withColumn("valid", F.size("violations") == 0)
