"""Landed payloads as rows: feeds, listings, filings, pages."""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from html.parser import HTMLParser
from itertools import accumulate
from operator import itemgetter
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

ITEM = "title string, link string, pubDate string, updated string, description string, category array<struct<_VALUE:string,_domain:string>>"
ENTRY = "title string, link struct<_href:string>, published string, updated string, summary string"
TIMES = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMM d, yyyy", "MM/dd/yyyy")


def to_utc(value: Column) -> Column:
    """The first of the known time formats that fits; null if none does.

    A weekday before a comma is left out.
    """
    bare = F.regexp_replace(value, r"^[A-Za-z]{3,9},\s*", "")
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(p)) for p in TIMES))


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def read_source_list(spark: SparkSession, path: str) -> DataFrame:
    """Organisation and url from a ragged CSV, one row per url."""
    rows = spark.read.schema("organization string, url string, extra string").option("header", True).option("enforceSchema", True).csv(path)
    return rows.filter("url IS NOT NULL").groupBy("url").agg(F.min("organization").alias("organization"))


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Tickers and their feed links from a JSON array; links may be text or a list.

    Links are read as a variant: a list read as a string makes Spark go back into
    the file for each entry.
    """
    raw = spark.read.schema("symbol string, company_name string, exchange string, status string, rss_links variant").option("multiLine", True).json(path)
    raw = raw.withColumn("rss_links", F.try_variant_get("rss_links", "$", "string"))
    listed = F.from_json("rss_links", "array<string>")
    links = F.filter(F.coalesce(listed, F.array("rss_links")), lambda x: x.isNotNull() & (F.trim(x) != "") & (x != "#"))
    good = raw.filter("symbol IS NOT NULL AND NOT contains(symbol, ' ') AND length(symbol) <= 20")
    return good.select(F.upper(F.trim("symbol")).alias("symbol"), "company_name", "exchange", (F.lower("status") == "true").alias("status"), F.explode_outer(links).alias("feed_url"))


def parse_feed_xml(df: DataFrame, xml_col: str, fallback: Column | None = None) -> DataFrame:
    """Articles of landed RSS or Atom documents; title and link are required.

    The time is the published one, else the updated one, else ``fallback``;
    rows without any are dropped.
    """
    rss = F.from_xml(xml_col, f"channel struct<item:array<struct<{_struct(ITEM)}>>>")["channel"]["item"]
    atom = F.from_xml(xml_col, f"entry array<struct<{_struct(ENTRY)}>>")["entry"]
    keep = [c for c in df.columns if c != xml_col]
    one = df.select(*keep, F.explode(rss).alias("i")).select(
        *keep, F.trim("i.title").alias("title"), F.trim("i.link").alias("url"), F.coalesce(to_utc(F.col("i.pubDate")), to_utc(F.col("i.updated"))).alias("published_at"),
        F.col("i.description").alias("summary"), F.col("i.category").alias("category"),
    )
    two = df.select(*keep, F.explode(atom).alias("i")).select(
        *keep, F.trim("i.title").alias("title"), F.col("i.link._href").alias("url"), F.coalesce(to_utc(F.col("i.published")), to_utc(F.col("i.updated"))).alias("published_at"),
        F.col("i.summary").alias("summary"), F.lit(None).cast("array<struct<_VALUE:string,_domain:string>>").alias("category"),
    )
    out = one.unionByName(two).filter("title <> '' AND url <> ''")
    when = F.coalesce("published_at", fallback) if fallback is not None else F.col("published_at")
    return out.withColumn("published_at", when).filter("published_at IS NOT NULL")


def _struct(fields: str) -> str:
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", fields)


def parse_feed_tickers(articles: DataFrame) -> DataFrame:
    """Upper-case tickers from stock categories such as ``EXCH:TICK``."""
    tags = F.filter("category", lambda c: F.contains(F.lower(c["_domain"]), F.lit("rss/stock")) & F.contains(c["_VALUE"], F.lit(":")))
    return articles.withColumn("ticker", F.explode(F.transform(tags, lambda c: F.upper(F.trim(F.split_part(c["_VALUE"], F.lit(":"), F.lit(2))))))).filter("ticker <> ''")


def parse_press_json(df: DataFrame, json_col: str, dialect: str, publishers: list[str] | None = None) -> DataFrame:
    """Articles of a landed JSON listing: ``nasdaq``, ``yahoo`` or ``q4``."""
    keep, j = [c for c in df.columns if c != json_col], F.col(json_col)
    if dialect == "nasdaq":
        rows = F.from_json(j, "data struct<rows:array<struct<title:string,url:string,created:string,date:string>>>")["data"]["rows"]
        i = lambda c: F.col(f"i.{c}")
        out = df.select(*keep, F.explode(rows).alias("i")).select(*keep, i("title").alias("title"), i("url").alias("url"), to_utc(F.coalesce(i("created"), i("date"))).alias("published_at"))
    elif dialect == "yahoo":
        rows = F.from_json(j, "news array<struct<title:string,link:string,publisher:string,providerPublishTime:long>>")["news"]
        out = df.select(*keep, F.explode(rows).alias("i"))
        if publishers is not None:
            out = out.filter(F.lower("i.publisher").isin([p.lower() for p in publishers]))
        out = out.select(*keep, F.col("i.title").alias("title"), F.col("i.link").alias("url"), F.timestamp_seconds("i.providerPublishTime").alias("published_at"))
    elif dialect == "q4":
        item = "array<struct<Headline:string,LinkToDetailPage:string,Body:string,PressReleaseDate:string>>"
        whole = F.from_json(j, f"items {item}, GetPressReleaseListResult {item}")
        rows = F.coalesce(F.when(F.ltrim(j).startswith("["), F.from_json(j, item)), whole["items"], whole["GetPressReleaseListResult"])
        out = df.select(*keep, F.explode(rows).alias("i")).select(*keep, F.col("i.Headline").alias("title"), F.col("i.LinkToDetailPage").alias("url"), to_utc(F.col("i.PressReleaseDate")).alias("published_at"))
    else:
        raise ValueError(f"no such dialect: {dialect}")
    return out.filter("title <> '' AND url <> ''")


def parse_submissions(df: DataFrame, json_col: str, base_url: str) -> DataFrame:
    """Filings from parallel arrays, in their order; those without a document go."""
    recent = F.from_json(json_col, "filings struct<recent:struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,primaryDocument:array<string>>>")["filings"]["recent"]
    keep = [c for c in df.columns if c != json_col]
    rows = df.select(*keep, recent.alias("r")).select(*keep, F.posexplode(F.arrays_zip("r.form", "r.filingDate", "r.accessionNumber", "r.primaryDocument")).alias("position", "f"))
    bare = F.replace(F.col("f.accessionNumber"), F.lit("-"), F.lit(""))
    return rows.filter("f.accessionNumber <> '' AND f.primaryDocument <> ''").select(
        *keep, "position", F.col("f.form").alias("form_type"), F.col("f.filingDate").try_cast("date").alias("filed_at"), F.concat(F.lit(base_url), bare, F.lit("/"), F.col("f.primaryDocument")).alias("url")
    )


def build_cik_map(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """ticker to ten-digit number; the first source wins."""
    own = lambda df, rank: df.select(F.upper(F.trim("ticker")).alias("ticker"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), F.lit(rank).alias("rank"))
    return own(primary, 0).unionByName(own(secondary, 1)).groupBy("ticker").agg(F.min_by("cik", F.struct("rank", "cik")).alias("cik"))


# Transaction code and what it says.
FORM4_CODES = {"P": "purchase", "S": "sale", "A": "grant", "M": "exercise", "F": "tax", "G": "gift", "D": "disposition", "C": "conversion"}


# How shares are held.
OWNERSHIP = {"D": "Direct", "I": "Indirect"}


# Elements of an insider's report that are read; ``_insider_report`` knows their places.
FORM4_NAMES = (
    "issuer issuerName issuerTradingSymbol periodOfReport reportingOwner reportingOwnerId rptOwnerName reportingOwnerRelationship isDirector isTenPercentOwner officerTitle "
    "nonDerivativeTable nonDerivativeTransaction derivativeTable derivativeTransaction transactionDate transactionCoding transactionCode conversionOrExercisePrice exercisePrice "
    "transactionAmounts transactionShares transactionPricePerShare postTransactionAmounts sharesOwnedFollowingTransaction ownershipNature directOrIndirectOwnership value"
).split()
FORM4_KNOWN, FORM4_FOLDED = frozenset(FORM4_NAMES), frozenset(n.lower() for n in FORM4_NAMES)
FORM4_HEADS = ("company", "ticker", "period", "owner", "director", "holder", "title")
FORM4_DEAL = ("traded", "code", "conversion", "exercise", "shares", "price", "owned", "held")
#: Tags up to which a report is plain: Spark's reader ends at elements 1,000 deep.
FORM4_TAGS = 2_000
BLANK = " \t\n"
PROLOG = re.compile(rb"<\?xml version=[\"']1\.0[\"'](?: encoding=[\"'](?:UTF-8|utf-8)[\"'])? ?\?>")
#: All bytes but marks of tags and references, and those that text cannot hold as they are.
HARMLESS = bytes(b for b in range(256) if b not in b"<>&" and (b >= 32 or b in b"\t\n"))


class OddReport(Exception):
    """A report that is left to Spark's reader."""


def _inner(parent: dict, name: str) -> dict:
    """Children of an element by name; of equal names the last counts."""
    found = parent.get(name)
    return {} if found is None else {e.tag: e for e in found}


def _leaf(parent: dict, name: str) -> str | None:
    found = parent.get(name)
    if found is None:
        return None
    if len(found):
        raise OddReport
    return (found.text or "").strip(BLANK)


def _insider_report(report: ElementTree.Element) -> tuple[tuple, list[tuple]]:
    """Heads and deals of a report, as ``FORM4_HEADS`` and ``FORM4_DEAL`` name them, and whether the deal is in derivatives."""
    top = {e.tag: e for e in report}
    issuer, owner, deals = _inner(top, "issuer"), _inner(top, "reportingOwner"), []
    role = _inner(owner, "reportingOwnerRelationship")
    heads = (
        _leaf(issuer, "issuerName"), _leaf(issuer, "issuerTradingSymbol"), _leaf(top, "periodOfReport"), _leaf(_inner(owner, "reportingOwnerId"), "rptOwnerName"),
        _leaf(role, "isDirector"), _leaf(role, "isTenPercentOwner"), _leaf(role, "officerTitle"),
    )
    for kind, derivative in (("nonDerivative", False), ("derivative", True)):
        table = top.get(f"{kind}Table")
        for deal in () if table is None else table.findall(f"{kind}Transaction"):
            d = {e.tag: e for e in deal}
            amounts = _inner(d, "transactionAmounts")
            deals.append((
                _leaf(_inner(d, "transactionDate"), "value"), _leaf(_inner(d, "transactionCoding"), "transactionCode"), _leaf(_inner(d, "conversionOrExercisePrice"), "value"), _leaf(_inner(d, "exercisePrice"), "value"),
                _leaf(_inner(amounts, "transactionShares"), "value"), _leaf(_inner(amounts, "transactionPricePerShare"), "value"),
                _leaf(_inner(_inner(d, "postTransactionAmounts"), "sharesOwnedFollowingTransaction"), "value"), _leaf(_inner(_inner(d, "ownershipNature"), "directOrIndirectOwnership"), "value"), derivative,
            ))
    return heads, deals


@lru_cache(maxsize=256)
def _insider_places(tags: tuple[str, ...]) -> tuple | None:
    """For reports of these tags: which of their pieces are heads and deals; None for those left to Spark's reader.

    The tags are parsed with the numbers of the texts in the texts' places; texts and
    tags take turns. Of the pieces, the last but one stands for an empty element, the
    last for none.
    """
    try:
        report = ElementTree.fromstring("".join(f"<{tag}>{i}" for i, tag in enumerate(tags, 1)).removesuffix(str(len(tags))))
        odd = any("{" in n or n.lower() in FORM4_FOLDED for n in {e.tag for e in report.iter()} - FORM4_KNOWN)
        if odd or any(tag[:1] in ("!", "?") for tag in tags):
            return None
        heads, deals = _insider_report(report)
    except (ElementTree.ParseError, OddReport):
        return None
    places = lambda values: itemgetter(*(-1 if v is None else -2 if v == "" else 2 * int(v) for v in values))
    return places(heads), [(places(d[:-1]), d[-1]) for d in deals]


def _plain_report(report: bytes | None) -> tuple[list, list[list]] | None:
    """``_insider_report`` of a report's bytes; None for those left to Spark's reader."""
    if report is None:
        return None
    if report.startswith(b"<?xml"):
        report = PROLOG.sub(b"", report, count=1)
    marks = report.translate(None, HARMLESS)
    n = len(marks) // 2
    if n > FORM4_TAGS or marks != b"<>" * n or b"\xef\xbf\xbe" in report or b"\xef\xbf\xbf" in report:
        return None
    try:
        pieces = report.decode().replace(">", "<").split("<")
    except UnicodeDecodeError:
        return None
    found = _insider_places(tuple(pieces[1::2]))
    if found is None or pieces[0].strip(BLANK) or pieces[-1].strip(BLANK):
        return None
    heads, deals = found
    pieces += ("", None)
    return [x and x.strip(BLANK) for x in heads(pieces)], [[*(x and x.strip(BLANK) for x in at(pieces)), derivative] for at, derivative in deals]


def _read_reports(reports: pa.Array) -> pa.Array:
    found = [_plain_report(r) for r in reports.to_pylist()]
    none = ((None,) * len(FORM4_HEADS), ())
    heads = list(zip(*(h for h, _ in (f or none for f in found)))) or [()] * len(FORM4_HEADS)
    counts = [len(f[1]) if f else 0 for f in found]
    deals = list(zip(*(d for f in found if f for d in f[1]))) or [()] * (len(FORM4_DEAL) + 1)
    kinds = [pa.string()] * len(FORM4_DEAL) + [pa.bool_()]
    struct = pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(deals, kinds)], [*FORM4_DEAL, "derivative"])
    listed = pa.ListArray.from_arrays(pa.array([0, *accumulate(counts)], pa.int32()), struct)
    return pa.StructArray.from_arrays([*(pa.array(v, pa.string()) for v in heads), listed], [*FORM4_HEADS, "deals"], mask=pa.array([f is None for f in found], pa.bool_()))


def _plain_report_of(xml: Column) -> Column:
    """What a plain report says, as text; null for those left to Spark's reader.

    Marked as not deterministic, so that filters on the deals do not run it anew.
    """
    texts = lambda names: ",".join(f"{n}:string" for n in names)
    read = F.arrow_udf(_read_reports, f"struct<{texts(FORM4_HEADS)},deals:array<struct<{texts(FORM4_DEAL)},derivative:boolean>>>")
    return read.asNondeterministic()(xml.cast("binary"))


def _insider_report_of(xml: Column) -> Column:
    """The same by Spark's reader, of any report."""
    value = "struct<value:string>"
    deal = (
        f"struct<transactionDate:{value},transactionCoding:struct<transactionCode:string>,conversionOrExercisePrice:{value},exercisePrice:{value},transactionAmounts:struct<transactionShares:{value},transactionPricePerShare:{value}>,"
        f"postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{value}>,ownershipNature:struct<directOrIndirectOwnership:{value}>>"
    )
    schema = (
        f"issuer struct<issuerName:string,issuerTradingSymbol:string>, periodOfReport string, nonDerivativeTable struct<nonDerivativeTransaction:array<{deal}>>, derivativeTable struct<derivativeTransaction:array<{deal}>>, "
        "reportingOwner struct<reportingOwnerId:struct<rptOwnerName:string>,reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,isTenPercentOwner:string,officerTitle:string>>"
    )

    def told(x: Column) -> Column:
        inside = ("transactionDate.value", "transactionCoding.transactionCode", "conversionOrExercisePrice.value", "exercisePrice.value", "transactionAmounts.transactionShares.value", "transactionAmounts.transactionPricePerShare.value",
                  "postTransactionAmounts.sharesOwnedFollowingTransaction.value", "ownershipNature.directOrIndirectOwnership.value")
        at = lambda c, path: reduce(lambda y, name: y[name], path.split("."), c)
        flat = lambda c, derivative: F.transform(F.coalesce(c, F.array().cast(f"array<{deal}>")), lambda t: F.struct(*(at(t, p).alias(n) for p, n in zip(inside, FORM4_DEAL)), F.lit(derivative).alias("derivative")))
        deals = F.concat(flat(at(x, "nonDerivativeTable.nonDerivativeTransaction"), False), flat(at(x, "derivativeTable.derivativeTransaction"), True))
        owner = "reportingOwner.reportingOwnerRelationship"
        heads = ("issuer.issuerName", "issuer.issuerTradingSymbol", "periodOfReport", "reportingOwner.reportingOwnerId.rptOwnerName", f"{owner}.isDirector", f"{owner}.isTenPercentOwner", f"{owner}.officerTitle")
        return F.struct(*(at(x, p).alias(n) for p, n in zip(heads, FORM4_HEADS)), deals.alias("deals"))

    return T.once(F.from_xml(xml, schema), told)


def parse_form4(df: DataFrame, xml_col: str) -> DataFrame:
    """Insider transactions with company, insider, code, shares, price, value, ownership and date.

    ``derivative`` tells options and the like, which are priced by their exercise,
    from the rest. A deal without a date takes the period of the report; ownership
    is direct unless it says otherwise. Plain reports share the parse of their tags with
    others of the same tags; the rest go to Spark's reader, which takes longer for each.
    """
    keep = [c for c in df.columns if c != xml_col]
    plain = df.select(*keep, F.col(xml_col).alias("_xml"), _plain_report_of(F.col(xml_col)).alias("_plain"))
    x = plain.select(*keep, F.when(F.col("_plain").isNotNull(), F.col("_plain")).otherwise(_insider_report_of(F.col("_xml"))).alias("x"))
    number = lambda c: F.regexp_replace(F.col(f"d.{c}"), ",", "").try_cast("double")
    exercise = F.when(F.col("d.derivative"), F.coalesce(number("exercise"), number("conversion")))
    shares, price = number("shares"), F.coalesce(exercise, number("price"), F.lit(0.0))
    labels = lambda table, c: F.element_at(F.create_map(*(F.lit(v) for pair in table.items() for v in pair)), c)
    flag = lambda c: F.lower(F.col(f"x.{c}")).isin("1", "true")
    role = F.coalesce(F.col("x.title"), F.when(flag("director"), "Director"), F.when(flag("holder"), "10% owner"), F.lit("Insider"))
    company = F.concat("x.company", F.lit(" ("), F.coalesce("x.ticker", F.lit("")), F.lit(")"))
    heads = x.select(*keep, company.alias("company"), F.col("x.owner").alias("owner"), role.alias("role"), F.col("x.period").try_cast("date").alias("_period"), F.explode("x.deals").alias("d"))
    held = F.coalesce(labels(OWNERSHIP, F.upper(F.trim("d.held"))), F.lit("Direct"))
    return heads.select(
        *keep, "company", F.concat("owner", F.lit(" ("), "role", F.lit(")")).alias("insider"), "owner", "role", F.col("d.derivative").alias("derivative"), F.col("d.code").alias("code"),
        F.coalesce(labels(FORM4_CODES, F.col("d.code")), F.lit("other")).alias("kind"), shares.alias("shares"), price.alias("price"), (shares * price).alias("value"), held.alias("ownership"),
        number("owned").alias("owned_after"), F.coalesce(F.col("d.traded").try_cast("date"), "_period").alias("traded_at"),
    )


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Distinct link targets of each page."""
    return pages.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(html_col, F.lit(r'href="([^"]+)"'), F.lit(1)))).alias("href"))


def release_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Links to press releases, which end in a number."""
    return links(pages, id_col, html_col).filter(F.col("href").rlike(r"/press-?releases/[^/]*-\d+/?$"))


def absolute(base: Column, href: Column) -> Column:
    root = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+)", 1)
    return F.when(href.rlike("^[A-Za-z]+://"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z]+:)", 1), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(
        F.concat(F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"/[^/]*$", "/"), href)
    )


def discover_feed_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Alternate RSS and Atom links of each page, as absolute addresses."""
    tags = F.regexp_extract_all(html_col, F.lit(r"(?i)(<link\b[^>]*>)"), F.lit(1))
    rows = pages.select(id_col, url_col, F.explode(tags).alias("tag")).filter(F.col("tag").rlike(r"(?i)rel=.?alternate") & F.col("tag").rlike(r"(?i)type=.?application/(rss|atom)"))
    href = F.regexp_extract("tag", r"""(?i)href=["']?([^"'\s>]+)""", 1)
    return rows.select(id_col, absolute(F.col(url_col), href).alias("feed_url"), F.when(F.col("tag").rlike("(?i)atom"), "atom").otherwise("rss").alias("feed_type")).distinct()


# How a release host's pages name the feeds of an organisation.
ORGANISATION_FEEDS = (("rss", "/rssfeed/organization/"), ("atom", "/atomfeed/organization/"))


def organisation_feeds(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", feeds: tuple[tuple[str, str], ...] = ORGANISATION_FEEDS) -> DataFrame:
    """``feed_url``, ``feed_type`` and ``org_id``: feeds of the organisation that a page belongs to.

    The paths stand in escaped JSON beside their key, or in links; the escaped one
    counts first. A page of which only the number is known gives one row without a
    feed. Null pages give none.
    """
    html, number = F.col(html_col), F.regexp_extract(html_col, r"ContextOrgId\s*:\s*(\d+)", 1).try_cast("long")
    found = []
    for kind, path in feeds:
        named = F.regexp_extract(html, rf'\\"Key\\":\\"{kind}\\"[^}}]*\\"Url\\":\\"({path}[^\\]+)\\"', 1)
        linked = F.regexp_extract(html, rf'href="({path}[^"]+)"', 1)
        own = F.coalesce(F.nullif(named, F.lit("")), F.nullif(linked, F.lit("")))
        found.append(F.when(own.isNotNull(), F.struct(absolute(F.col(url_col), own).alias("feed_url"), F.lit(kind).alias("feed_type"))))
    none = F.struct(F.lit(None).cast("string").alias("feed_url"), F.lit(None).cast("string").alias("feed_type"))
    listed = F.array_compact(F.array(*found))
    rows = F.when(F.size(listed) > 0, listed).when(number.isNotNull(), F.array(none))
    return pages.select(id_col, number.alias("org_id"), F.explode(rows).alias("f")).select(id_col, "f.feed_url", "f.feed_type", "org_id")


# A screener's field and the column it fills.
SCREENER_FIELDS = {
    "close": "close_price", "change": "price_change", "price_earnings_ttm": "price_earnings_ttm", "price_book_fq": "price_book_ratio",
    "earnings_per_share_diluted_ttm": "earnings_per_share_basic_ttm", "price_earnings_growth_ttm": "price_earnings_growth_ttm", "total_revenue": "total_revenue",
    "net_income": "net_income", "gross_margin": "gross_margin", "operating_margin": "operating_margin", "net_margin": "net_margin", "return_on_equity": "return_on_equity",
    "debt_to_equity": "debt_to_equity", "current_ratio_mrq": "current_ratio", "RSI": "rsi", "SMA200": "sma200", "High.52W": "price_52_week_high",
    "relative_volume_10d_calc": "relative_volume_10d_calc", "average_volume_30d_calc": "average_volume_30d_calc", "earnings_release_next_date": "earnings_release_date",
    "Dividends.Yield.Current": "dividend_yield_recent", "number_of_employees": "number_of_employees", "market_cap_calc": "market_cap_formatted",
}
TEXT_FIELDS, WHOLE_FIELDS, TIME_FIELDS = ("market_cap_formatted",), ("number_of_employees",), ("earnings_release_date",)


def finite(value: Column) -> Column:
    """A number, or null for what is none, not a number, or infinite."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def normalize_screener(df: DataFrame, wanted: DataFrame, fields: dict[str, str] = SCREENER_FIELDS) -> DataFrame:
    """Market rows of wanted tickers, under the library's names.

    Tickers lose their exchange. Bad numbers become null; times come as
    milliseconds since 1970 or as text; names and industries are trimmed.
    Fields that ``df`` lacks are left out.
    """
    bare = F.upper(F.element_at(F.split("ticker", ":"), -1))
    columns = []
    for field, name in fields.items():
        if field not in df.columns:
            continue
        c = F.col(f"`{field}`")
        if name in TEXT_FIELDS:
            c = F.left(c.cast("string"), F.lit(50))
        elif name in WHOLE_FIELDS:
            c = finite(c).cast("long")
        elif name in TIME_FIELDS:
            millis = c.try_cast("double")
            c = F.coalesce(F.timestamp_millis(millis.cast("long")), to_utc(c.cast("string")))
        else:
            c = finite(c)
        columns.append(c.alias(name))
    others = [F.trim(c).alias(c) for c in ("sector", "industry") if c in df.columns]
    rows = df.select(bare.alias("ticker"), *others, *columns)
    return rows.join(wanted.select(F.upper("ticker").alias("ticker")), "ticker", "left_semi")


# Parts of a page that are no text, and what may hold an article, in this order: element, or attribute and a part of its value.
NO_TEXT = ("script", "style", "nav", "footer", "header", "aside")
BODIES = (
    ("article", ""), ("class", "article-body"), ("class", "news-body"), ("class", "press-release"), ("class", "body__content"),
    ("data-testid", "content"), ("main", ""), (".class", "content"), (".id", "content"),
)
LONGEST_BODY, LEAST_BODY, LEAST_PARAGRAPH = 100_000, 200, 40
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements before which an open paragraph ends.
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class _PageText(HTMLParser):
    """Text of the first element of each of ``BODIES``, and of all paragraphs, each up to its own end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list]] = []
        self.open: dict[str, int] = {}
        self.hidden = 0
        self.bodies: dict[int, list[str]] = {}
        self.paragraphs: list[list[str]] = []
        self.taking: list[list[str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCKS and self.open.get("p"):
            self.handle_endtag("p")
        if tag in _VOID:
            return
        taken = []
        if not self.hidden and tag not in NO_TEXT:
            given = {k: v or "" for k, v in attrs}
            for i, (name, part) in enumerate(BODIES):
                if i not in self.bodies and (part in given.get(name[1:], "").split() if name[0] == "." else part in given.get(name, "") if part else tag == name):
                    self.bodies[i] = []
                    taken.append(self.bodies[i])
            if tag == "p":
                self.paragraphs.append([])
                taken.append(self.paragraphs[-1])
        self.hidden += tag in NO_TEXT
        self.taking += taken
        self.stack.append((tag, taken))
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        while self.open.get(tag):
            last, taken = self.stack.pop()
            self.open[last] -= 1
            self.hidden -= last in NO_TEXT
            if taken:
                self.taking = self.taking[: -len(taken)]
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            for pieces in self.taking:
                pieces.append(data)


def page_text(html: str | None) -> str | None:
    """An article's text: of the first of ``BODIES`` that is long enough, else its long paragraphs; None if there is none."""
    page = _PageText()
    page.feed(html or "")
    page.close()
    joined = lambda pieces: " ".join(" ".join(pieces).split())
    bodies = (joined(page.bodies[i]) for i in sorted(page.bodies))
    paragraphs = (p for p in map(joined, page.paragraphs) if len(p) > LEAST_PARAGRAPH)
    found = next((b for b in bodies if len(b) > LEAST_BODY), None) or " ".join(paragraphs)
    return found[:LONGEST_BODY] if len(found) > LEAST_BODY else None


def body_text(html: Column | str) -> Column:
    """``page_text`` of a column, in Arrow batches: a block ends at its own closing tag, however deep others nest in it."""

    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(page_text)

    return read(F.col(html) if isinstance(html, str) else html)


def html_to_text(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Replace ``html_col`` by ``body``; null where there is no article."""
    return df.withColumn("body", body_text(html_col)).drop(html_col)


def strip(df: DataFrame, html_col: str) -> DataFrame:
    return df.withColumn(html_col, T.strip_html(html_col))
