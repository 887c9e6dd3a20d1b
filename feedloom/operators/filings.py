"""Filings: the registry of forms, their sections, and their ingestion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..sources import parse
from . import facts, joins, upsert
from .aggregates import run_summary, sec_modifier
from .dedup import keep_first


@dataclass(frozen=True)
class Form:
    """How a form is fetched and weighed."""

    form: str
    tier: int
    weight: float
    max_per_run: int
    all_symbols: bool
    lookback_months: int


# Form, tier, weight, most per run, for all symbols, months back.
REGISTRY = tuple(
    Form(*row)
    for row in (
        ("10-K", 1, 2.5, 5, True, 60), ("10-K/A", 1, 2.5, 5, True, 60), ("10-Q", 1, 2.0, 5, True, 15), ("10-Q/A", 1, 2.0, 5, True, 15),
        ("8-K", 1, 1.5, 40, False, 24), ("8-K/A", 1, 1.5, 10, False, 24), ("S-3", 2, 1.8, 10, True, 36), ("S-3/A", 2, 1.8, 10, True, 36),
        ("424B1", 2, 1.8, 10, True, 36), ("424B3", 2, 1.8, 10, True, 36), ("424B4", 2, 1.8, 10, True, 36), ("424B5", 2, 1.8, 10, True, 36),
        ("NT 10-K", 2, 1.6, 6, True, 24), ("NT 10-Q", 2, 1.6, 6, True, 24), ("4", 3, 1.2, 50, True, 12), ("SC 13D", 3, 1.5, 10, True, 36),
        ("SC 13D/A", 3, 1.5, 10, True, 36), ("SC 13G", 3, 1.3, 10, True, 24), ("SC 13G/A", 3, 1.3, 10, True, 24),
    )
)


def active_registry(tiers: list[int] | None = None, forms: list[str] | None = None, registry: tuple[Form, ...] = REGISTRY) -> list[Form]:
    """The forms of a run: of the tiers, and among the forms, where these are given."""
    return [r for r in registry if (not tiers or r.tier in tiers) and (not forms or r.form in forms)]


def registry_table(spark, registry: list[Form] | tuple[Form, ...] = REGISTRY) -> DataFrame:
    rows = [(r.form, r.tier, r.weight, r.max_per_run, r.all_symbols, r.lookback_months) for r in registry]
    return spark.createDataFrame(rows, "form string, tier int, weight double, max_per_run int, all_symbols boolean, lookback_months int")


def of_form(registry: list[Form] | tuple[Form, ...], field: str, form: Column | str = "form_type") -> Column:
    """A field of the registry for a row's form, as an expression; null for other forms."""
    pairs = [F.lit(v) for r in registry for v in (r.form, getattr(r, field))]
    return F.element_at(F.create_map(*pairs), F.col(form) if isinstance(form, str) else form)


def _item(number: str) -> str:
    return rf"ITEM\s+{number}[\.\s]"


# By the beginning of the form, its budget and its sections: name,
# lines that begin it, lines that end it, budget.
SECTIONS = {
    "10-K": (58_000, (
        ("RISK FACTORS (Item 1A)", (_item("1A"), r"RISK\s+FACTORS"), (_item("1B"), _item("2"), r"UNRESOLVED"), 8_000),
        ("MANAGEMENT DISCUSSION & ANALYSIS (Item 7)", (_item("7"), r"MANAGEMENT.{0,20}DISCUSSION"), (_item("7A"), _item("8"), r"QUANTITATIVE"), 25_000),
        ("MARKET RISK (Item 7A)", (_item("7A"), r"QUANTITATIVE.*QUALITATIVE"), (_item("8"), r"FINANCIAL\s+STATEMENTS"), 3_000),
        ("INCOME STATEMENT", (r"CONSOLIDATED\s+STATEMENTS?\s+OF\s+(OPERATIONS|INCOME|EARNINGS)", r"STATEMENTS?\s+OF\s+COMPREHENSIVE"), (r"CONSOLIDATED\s+BALANCE", r"STATEMENTS?\s+OF\s+FINANCIAL"), 6_000),
        ("BALANCE SHEET", (r"CONSOLIDATED\s+BALANCE\s+SHEET", r"STATEMENTS?\s+OF\s+FINANCIAL\s+POSITION"), (r"CONSOLIDATED\s+STATEMENTS?\s+OF\s+(CASH|EQUITY)", r"STATEMENTS?\s+OF\s+STOCKHOLDERS"), 6_000),
        ("CASH FLOW STATEMENT", (r"CONSOLIDATED\s+STATEMENTS?\s+OF\s+CASH", r"CASH\s+FLOWS?\s+FROM\s+OPERATING"), (r"NOTES\s+TO\s+(CONSOLIDATED\s+)?FINANCIAL", _item("9")), 6_000),
        ("GOING CONCERN / DEBT NOTES", (r"GOING\s+CONCERN", r"SUBSTANTIAL\s+DOUBT", r"NOTE\s+\d+.*DEBT", r"LONG.TERM\s+DEBT"), (r"NOTE\s+\d+\.", r"ITEM\s+\d+[\.\s]"), 5_000),
    )),
    "10-Q": (45_000, (
        ("FINANCIAL STATEMENTS (Part I, Item 1)", (_item("1"), r"FINANCIAL\s+STATEMENTS"), (_item("2"), r"MANAGEMENT.{0,20}DISCUSSION"), 20_000),
        ("MD&A (Part I, Item 2)", (_item("2"), r"MANAGEMENT.{0,20}DISCUSSION"), (_item("3"), r"QUANTITATIVE"), 15_000),
        ("MARKET RISK (Part I, Item 3)", (_item("3"), r"QUANTITATIVE.*QUALITATIVE"), (_item("4"), r"CONTROLS"), 3_000),
        ("RISK FACTOR UPDATES (Part II, Item 1A)", (r"PART\s+II.*ITEM\s+1A", r"RISK\s+FACTORS"), (_item("2"), r"UNREGISTERED"), 5_000),
        ("UNREGISTERED SALES / DILUTION (Part II, Item 2)", (_item("2") + ".*UNREGISTERED", r"UNREGISTERED\s+SALES"), (_item("3"), _item("4"), r"DEFAULTS"), 2_000),
    )),
    "S-3": (33_000, _PROSPECTUS := (
        ("PROSPECTUS SUMMARY", (r"PROSPECTUS\s+SUMMARY", r"SUMMARY\s+OF\s+OFFERING", r"SUMMARY\s+OF\s+THE\s+OFFERING"), (r"RISK\s+FACTORS", r"USE\s+OF\s+PROCEEDS"), 8_000),
        ("THE OFFERING", (r"THE\s+OFFERING", r"OFFERING\s+OVERVIEW"), (r"RISK\s+FACTORS", r"USE\s+OF\s+PROCEEDS", r"PLAN\s+OF\s+DISTRIBUTION"), 6_000),
        ("USE OF PROCEEDS", (r"USE\s+OF\s+PROCEEDS",), (r"RISK\s+FACTORS", r"DILUTION", r"DIVIDEND"), 4_000),
        ("DILUTION", (r"DILUTION",), (r"PLAN\s+OF\s+DISTRIBUTION", r"SELLING\s+STOCKHOLDER", r"DESCRIPTION\s+OF\s+(CAPITAL\s+STOCK|SECURITIES)"), 5_000),
        ("RISK FACTORS", (r"RISK\s+FACTORS",), (r"USE\s+OF\s+PROCEEDS", r"DILUTION", r"DESCRIPTION\s+OF\s+(CAPITAL|SECURITIES)"), 10_000),
    )),
    "424B": (33_000, _PROSPECTUS),
    "SC 13D": (20_000, (
        ("Item 3: Source of Funds", (_item("3"), r"SOURCE\s+(AND\s+AMOUNT\s+OF\s+)?FUNDS"), (_item("4"),), 3_000),
        ("Item 4: Purpose of Transaction", (_item("4"), r"PURPOSE\s+OF\s+TRANSACTION"), (_item("5"),), 8_000),
        ("Item 5: Interest in Securities", (_item("5"), r"INTEREST\s+IN\s+SECURITIES"), (_item("6"),), 4_000),
        ("Item 6: Contracts/Arrangements", (_item("6"), r"CONTRACTS.*ARRANGEMENTS"), (_item("7"), r"SIGNATURES"), 5_000),
    )),
    "SC 13G": (12_000, (
        ("Item 5: Interest in Securities (Ownership %)", (_item("5"),), (_item("6"), r"SIGNATURES"), 5_000),
        ("Item 4: Ownership / Citizenship", (_item("4"),), (_item("5"), r"SIGNATURES"), 3_000),
        ("Item 6: Ownership of More than 5%", (_item("6"),), (_item("7"), r"SIGNATURES"), 3_000),
        ("Item 7: Identification of Subsidiaries", (_item("7"),), (_item("8"), r"SIGNATURES"), 2_000),
    )),
}
# Numbers and names of the items of a current report.
EVENT_ITEMS = (
    ("1.01", "Entry into Material Agreement"), ("1.02", "Termination of Material Agreement"), ("1.03", "Bankruptcy/Receivership"), ("2.01", "Completion of Acquisition"),
    ("2.02", "Results of Operations"), ("2.03", "Creation of Direct Financial Obligation"), ("2.05", "Departure of Directors / Officers"), ("2.06", "Material Impairment"),
    ("3.01", "Delisting"), ("4.01", "Auditor Change"), ("4.02", "Non-Reliance on Financial Statements"), ("5.01", "Changes in Control"), ("5.02", "Director/Officer Changes"),
    ("5.03", "Amendments to Articles"), ("7.01", "Regulation FD Disclosure"), ("8.01", "Other Events"), ("9.01", "Financial Statements and Exhibits"),
)
EVENT_WHOLE, EVENT_BUDGET, LATE_BUDGET = 30_000, 5_000, 8_000


def event_items() -> list[tuple[str, str, str, str, int]]:
    """Numbered items of a current report: number, name, start, end, budget."""
    return [(n, name, rf"ITEM\s+{n.replace('.', '[.]')}", r"ITEM\s+\d+\.\d+|SIGNATURES|EXHIBIT", EVENT_BUDGET) for n, name in EVENT_ITEMS]


def section_table() -> list[tuple[str, int, int, list[tuple[str, str, str, int]]]]:
    """By the beginning of the form: budget, length up to which a text stays whole, and its sections."""
    out = [(prefix, budget, 0, [(name, "|".join(starts), "|".join(ends), most) for name, starts, ends, most in rows]) for prefix, (budget, rows) in SECTIONS.items()]
    return [*out, ("8-K", EVENT_WHOLE, EVENT_WHOLE, [(f"Item {n}: {name}", *marks) for n, name, *marks in event_items()]), ("NT", LATE_BUDGET, LATE_BUDGET, [])]


def filing_text(form: Column | str, body: Column | str, table: list | None = None) -> Column:
    """What is kept of a filing by its form: telling sections within the form's budget.

    Short current reports and late notices come whole within their budgets, and so
    do other forms; where no section is found, the text's beginning stands in. The
    ``table`` (of ``section_table``) is data: the text is read once for all sections.
    """
    f, b = (F.col(x) if isinstance(x, str) else x for x in (form, body))
    rows = section_table() if table is None else table
    ordered = sorted(rows, key=lambda r: -len(r[0]))
    pick = lambda value, default: F.coalesce(*(F.when(f.startswith(r[0]), F.lit(value(r))) for r in ordered), F.lit(default))
    budget, whole = pick(lambda r: r[1], EVENT_WHOLE), pick(lambda r: r[2], EVENT_WHOLE)
    marks = {r[0]: text.section_marks(r[3]) for r in ordered if r[3]}

    def sections(family: Column) -> Column:
        of = lambda value: F.coalesce(*(F.when(family == p, value(m)) for p, m in marks.items()))
        return F.when(F.length(b) > whole, text.find_sections(b, of(lambda m: m[0]), lambda line: of(lambda m: m[1](line))))

    known = pick(lambda r: r[0] if r[3] else "", "")
    found = text.once(known, lambda family: F.when(family != "", sections(family)))
    joined = F.array_join(F.transform(F.filter(found, lambda x: x["body"] != ""), lambda x: F.concat(F.lit("=== "), x["name"], F.lit(" ===\n"), x["body"])), "\n\n")
    cut = text.once(joined, lambda j: F.when(j != "", F.left(j, budget)))
    return text.once(F.coalesce(cut, text.clean_text(F.left(b, budget))), lambda t: F.when(t != "", t))


def eight_k_items(df: DataFrame, text_col: str, items: list[str] | None = None, whole: int = EVENT_WHOLE) -> DataFrame:
    """Short current reports whole; of longer ones the numbered items, ``items`` or all known ones."""
    table = [(n, *marks) for n, _, *marks in event_items() if items is None or n in items]
    long = facts.sections(df.filter(F.length(text_col) > whole), text_col, table)
    keep = [c for c in df.columns if c != text_col]
    return df.filter(F.length(text_col) <= whole).select(*keep, F.lit("whole").alias("section"), F.col(text_col).alias("body")).unionByName(long)


def insider_reports(documents: DataFrame, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """``keys``, ``report, bought, sold`` of insiders' reports in XML, given as ``keys`` and ``body``."""
    return facts.form4_text(parse.parse_form4(documents.select(*keys, "body"), "body"), list(keys)).select(*keys, "report", "bought", "sold")


def recent_filings(listed: DataFrame, registry: list[Form], as_of: Column) -> DataFrame:
    """Listed filings that a run takes up: of assigned forms, within their lookback, up to the cap of each form.

    ``listed`` has ``ticker, symbol_id, lonely, form_type, filed_at, position, url``,
    as ``joins.lonely_symbols`` tells active symbols; of those that are not lonely,
    the forms for all symbols are assigned. The cap counts in the order of the
    listing. A symbol has one ticker, so rows that met by it are not moved again.
    """
    wanted = listed.filter(of_form(registry, "all_symbols") | F.col("lonely"))
    recent = wanted.filter(scoring.age_days("filed_at", as_of) <= of_form(registry, "lookback_months") * scoring.DAYS_PER_MONTH)
    place = F.row_number().over(Window.partitionBy("ticker", "symbol_id", "form_type").orderBy("position", "url"))
    return recent.withColumn("_place", place).filter(F.col("_place") <= of_form(registry, "max_per_run")).select("symbol_id", "ticker", "url", "form_type", "filed_at")


# Form, signal and what it adds.
SIGNALS = (
    ("NT 10-K", "late_annual", -0.05), ("NT 10-Q", "late_quarterly", -0.03), ("SC 13D", "stake", 0.05), ("SC 13D/A", "stake_change", 0.02),
    ("SC 13G", "passive_stake", 0.02), ("SC 13G/A", "passive_stake_change", 0.01), ("S-3", "shelf", -0.02),
)
OFFERING, INSIDER_SELL = -0.04, -0.01


def filing_signals(filings: DataFrame) -> DataFrame:
    """Rule-based signals of filings, one row for each rule that fires.

    ``filings`` has ``id, symbol_id, form_type, published_at`` and, where insider
    reports are in, ``bought`` and ``sold``: such a report can give two rows.
    """
    form = F.col("form_type")
    row = lambda name, value, modifier: F.struct(F.lit(name).alias("signal_type"), value.cast("double").alias("signal_value"), modifier.cast("double").alias("modifier"))
    none = F.lit(None).cast("double")
    fired = [F.when(form == f, row(name, none, F.lit(m))) for f, name, m in SIGNALS] + [F.when(form.startswith("424B"), row("offering", none, F.lit(OFFERING)))]
    if "bought" in filings.columns:
        fired.append(F.when((form == "4") & (F.col("bought") > 0), row("insider_buy", F.col("bought"), scoring.insider_modifier("bought"))))
        fired.append(F.when((form == "4") & (F.col("sold") > 0), row("insider_sell", F.col("sold"), F.lit(INSIDER_SELL))))
    return filings.select("id", "symbol_id", F.col("published_at").alias("filed_at"), F.explode(F.array_compact(F.array(*fired))).alias("s")).select("id", "symbol_id", "filed_at", "s.*")


SIGNAL_COLUMNS = ["id", "symbol_id", "filed_at", "signal_type", "signal_value", "modifier", "is_active"]


def ingest_filings(
    listed: DataFrame, documents: DataFrame, symbols: DataFrame, feeds: DataFrame, stored: DataFrame, as_of: Column, *,
    tiers: list[int] | None = None, forms: list[str] | None = None, stored_signals: DataFrame | None = None, table: list | None = None, reports: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """One run over landed listings and documents, as tables.

    ``listed``: ``ticker, form_type, filed_at, position, url`` (``parse_submissions``);
    ``documents``: ``url, body``, the body of an insider's report as XML; ``reports``:
    the same for insiders' reports alone, where these are landed apart; ``symbols``:
    ``id, symbol, company_name, status, last_10k_filed, last_10q_filed``; ``stored``:
    ``symbol_id, url, title, full_text, article_hash, form_type, filing_tier,
    sec_source_weight, published_at``; ``stored_signals``: ``SIGNAL_COLUMNS``. A
    document that is stored, or whose text is empty, uses up the cap of its form.
    Gives ``filings`` (the stored ones after the run, the longer text kept), ``new``,
    ``symbols`` with dates moved forward, ``signals`` (the stored ones with the
    run's), ``modifiers`` over all of them and the ``summary`` by form.
    """
    registry = active_registry(tiers, forms)
    active = joins.lonely_symbols(symbols, feeds.filter("is_active"))
    own = listed.join(active.select(F.col("id").alias("symbol_id"), F.upper("symbol").alias("ticker"), "lonely"), "ticker")
    taken = recent_filings(own, registry, as_of)
    insiders = F.col("form_type") == "4"
    none = F.lit(None).cast("double")
    # A generated row is computed once; as a column it would be computed anew by each filter on it.
    kept_text = F.explode(F.array_compact(F.array(filing_text("form_type", "body", table)))).alias("full_text")
    texts = taken.filter(~insiders).join(documents.select("url", "body"), "url").select(*taken.columns, none.alias("bought"), none.alias("sold"), kept_text)
    # a report keeps its filing's columns, so that neither bodies nor filings are read a second time
    landed = taken.filter(insiders).join((documents if reports is None else reports).select("url", "body"), "url").distinct()
    told = insider_reports(landed, tuple(taken.columns)).select(*taken.columns, "bought", "sold", F.col("report").alias("full_text"))
    stub = F.concat_ws(" ", "ticker", "form_type", F.date_format("filed_at", "yyyy-MM-dd"))
    named = texts.unionByName(told).withColumns({"published_at": F.col("filed_at").cast("timestamp"), "title": facts.filing_title("full_text", stub, form=F.col("form_type"))}).withColumns(
        {
            "article_hash": text.article_hash("url", "title", "published_at"),
            "filing_tier": of_form(registry, "tier"),
            "sec_source_weight": of_form(registry, "weight"),
        }
    )
    columns = ["symbol_id", "url", "title", "full_text", "article_hash", "form_type", "filing_tier", "sec_source_weight", "published_at"]
    with_deals = [*columns, "bought", "sold"]
    new = keep_first(named.select(*with_deals), ["article_hash"], [F.col("symbol_id"), F.col("url")]).join(stored.select("article_hash"), "article_hash", "left_anti").select(*with_deals)
    kept = upsert.keep_longer(stored.select(*columns), new.select(*columns), ["symbol_id", "url"], "full_text", [c for c in columns if c not in ("symbol_id", "url", "full_text")]).select(*columns)
    annual = upsert.advance_date(symbols, _dates(new, "10-K", "last_10k_filed"), "id", "last_10k_filed")
    dated = upsert.advance_date(annual, _dates(new, "10-Q", "last_10q_filed"), "id", "last_10q_filed")
    signals = filing_signals(new.withColumn("id", F.col("article_hash"))).withColumn("is_active", F.lit(True)).select(*SIGNAL_COLUMNS)
    if stored_signals is not None:
        known = stored_signals.select(*SIGNAL_COLUMNS)
        signals = known.unionByName(signals.join(known.select("id", "signal_type"), ["id", "signal_type"], "left_anti"))
    return {
        "filings": kept, "new": new.select(*columns), "symbols": dated, "signals": signals, "modifiers": sec_modifier(signals, dated, as_of), "summary": run_summary(new),
    }


def _dates(new: DataFrame, family: str, column: str) -> DataFrame:
    return new.filter(F.col("form_type").startswith(family)).select(F.col("symbol_id").alias("id"), F.col("published_at").alias(column))
