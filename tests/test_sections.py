"""Sections of filings in one pass against a plain reading, and insiders' reports."""

import random
import re

from pyspark.sql import functions as F

from feedloom.functions import text
from feedloom.operators import facts, filings
from feedloom.plans import catalog_landed
from feedloom.sources import parse


def plain_section(body, starts, ends, most):
    lines = body.split("\n")
    seen = [x.strip(" ").upper() for x in lines]
    start = next((i for i, x in enumerate(seen) if re.search(starts, x)), None)
    if start is None:
        return None
    end = next((i for i in range(start + 1, len(lines)) if re.search(ends, seen[i])), len(lines))
    cut = "\n".join(lines[start:end]).strip(" ")[:most]
    return re.sub(r"[ \t]{4,}", " ", re.sub(r"\n{3,}", "\n\n", cut)).strip(" \t\r\n")


def plain_text(form, body):
    for prefix, budget, whole, table in sorted(filings.section_table(), key=lambda r: -len(r[0])):
        if form.startswith(prefix):
            break
    else:
        budget, whole, table = filings.EVENT_WHOLE, filings.EVENT_WHOLE, []
    parts = []
    if len(body) > whole:
        for name, starts, ends, most in table:
            found = plain_section(body, starts, ends, most)
            if found:
                parts.append(f"=== {name} ===\n{found}")
    return "\n\n".join(parts)[:budget] or re.sub(r"[ \t]{4,}", " ", re.sub(r"\n{3,}", "\n\n", body[:budget])).strip(" \t\r\n") or None


def test_texts_equal_a_plain_reading(spark):
    rng = random.Random(4)
    heads = (
        "Item 1A. Risk Factors", "item 1b. none", "ITEM 7. Management's Discussion", "Item 7A. Quantitative and Qualitative", "Item 8. Financial Statements", "Consolidated Statements of Cash Flows", "Going concern",
        "Note 7. Debt", "Prospectus Summary", "Use of proceeds", "Dilution", "Plan of distribution", "Item 4. Purpose of Transaction", "Item 5. Interest", "Signatures", "Item 2.02 Results", "Item 9.01 Exhibits", "Part II. Item 1A", "", "",
    )
    rows = []
    for i in range(120):
        lines = [rng.choice(heads) if rng.random() < 0.3 else "some    text of " + rng.choice(("it", "discussion", "the offering")) * rng.randint(1, 40) for _ in range(rng.randint(0, 60))]
        form = rng.choice(("10-K", "10-K/A", "10-Q", "S-3", "424B5", "SC 13D", "SC 13G/A", "8-K", "NT 10-K", "6-K"))
        rows.append((i, form, "\n".join(lines) * (400 if form == "8-K" and i % 2 else 1)))
    df = spark.createDataFrame(rows, "id int, f string, t string")
    got = {r.id: r.x for r in df.select("id", filings.filing_text("f", "t").alias("x")).collect()}
    assert got == {i: plain_text(f, t) for i, f, t in rows}
    assert sum("===" in (x or "") for x in got.values()) > 50


def test_the_plan_does_not_grow_with_the_sections(spark):
    df = spark.createDataFrame([("10-K", "x")], "f string, t string").select(filings.filing_text("f", "t").alias("x")).filter("x IS NOT NULL")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2 * len(filings.SECTIONS) and len(plan) < 150_000


def test_first_words():
    assert text.first_words(["STATEMENTS?\\s", "ABC(D|E)|XYZ"]) == ["ABC", "XYZ", "STATEMENT"]
    assert text.first_words(["\\d", "ITEM"]) == [] and text.first_words(["AB*", "ITEM"]) == []
    for _, _, _, table in filings.section_table():
        patterns = [x for _, a, b, _ in table for x in (a, b)]
        words = text.first_words(patterns)
        for line in ("ITEM 7. RESULTS", "THE OFFERING", "NOTE 3. LONG-TERM DEBT", "ITEM  2.02", "USE OF PROCEEDS", "ITEM 4 ", "SIGNATURES", "CONSOLIDATED STATEMENTS OF CASH"):
            if any(re.search(p, line) for p in patterns):
                assert any(w in line for w in words)


DEAL = "<transactionDate><value>{}</value></transactionDate><transactionCoding><transactionCode>{}</transactionCode></transactionCoding>"
AMOUNT = "<transactionAmounts><transactionShares><value>{}</value></transactionShares><transactionPricePerShare><value>{}</value></transactionPricePerShare></transactionAmounts>"


def report(code="P", owner="A Very Long Name Of An Insider Indeed"):
    return (
        f"<ownershipDocument><periodOfReport>2024-01-05</periodOfReport><issuer><issuerName>Big Co</issuerName><issuerTradingSymbol>BIG</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName>{owner}</rptOwnerName></reportingOwnerId></reportingOwner>"
        f"<nonDerivativeTable><nonDerivativeTransaction>{DEAL.format('2024-01-02', code)}{AMOUNT.format('1,000', 2.5)}<ownershipNature><directOrIndirectOwnership><value>I</value></directOrIndirectOwnership></ownershipNature></nonDerivativeTransaction></nonDerivativeTable>"
        f"<derivativeTable><derivativeTransaction>{DEAL.format('', 'P')}<conversionOrExercisePrice><value>7</value></conversionOrExercisePrice>{AMOUNT.format(10, 1)}</derivativeTransaction></derivativeTable></ownershipDocument>"
    )


def test_insider_reports_titles_and_ownership(spark):
    docs = spark.createDataFrame([("u", report()), ("v", report("S", "B")), ("w", report("A")), ("x", "<y/>")], "url string, body string")
    deals = sorted(parse.parse_form4(docs.filter("url = 'u'"), "body").collect(), key=lambda r: r.derivative)
    assert [(r.ownership, r.price, r.value, str(r.traded_at), r.derivative) for r in deals] == [("Indirect", 2.5, 2500.0, "2024-01-02", False), ("Direct", 7.0, 70.0, "2024-01-05", True)]
    told = filings.insider_reports(docs)
    got = {r.url: (r.title, r.bought, r.sold) for r in told.select("url", "bought", "sold", facts.filing_title("report", F.lit("?"), form=F.lit("4")).alias("title")).collect()}
    assert got == {"u": ("Big Co (BIG) — Insider Buy by A Very Long Name Of An Insider", 2500.0, 0.0), "v": ("Big Co (BIG) — Insider Sale by B (Insider)", 0.0, 2500.0), "w": ("?", 0.0, 0.0)}


def test_stored_signals_count_and_are_kept(spark):
    at = lambda c: F.lit("2024-03-01 00:00:00").cast("timestamp").alias(c)
    listed = spark.createDataFrame([("BIG", "4", "u", 0), ("BIG", "SC 13D", "z", 1)], "ticker string, form_type string, url string, position int").withColumn("filed_at", F.lit("2024-03-01").cast("date"))
    docs = spark.createDataFrame([("u", report()), ("z", "Item 4. Purpose of Transaction\nto own it")], "url string, body string")
    symbols = spark.createDataFrame([(1, "big", "Big Co", True)], "id long, symbol string, company_name string, status boolean").select("*", at("last_10k_filed"), at("last_10q_filed"))
    feeds = spark.createDataFrame([], "symbol_id long, is_active boolean")
    stored = spark.createDataFrame([], "symbol_id long, url string, title string, full_text string, article_hash string, form_type string, filing_tier int, sec_source_weight double, published_at timestamp")
    signals = spark.createDataFrame([("old", 1, "stake", None, 0.05, True), ("off", 1, "stake", None, 0.1, False)], "id string, symbol_id long, signal_type string, signal_value double, modifier double, is_active boolean").select("*", at("filed_at"))
    as_of = F.lit("2024-03-15").cast("timestamp")
    run = filings.ingest_filings(listed, docs, symbols, feeds, stored, as_of, stored_signals=signals)
    assert sorted(r.signal_type for r in run["signals"].collect()) == ["insider_buy", "stake", "stake", "stake"]
    assert [r.sec_modifier for r in run["modifiers"].collect()] == [0.11]
    again = filings.ingest_filings(listed, docs, symbols, feeds, run["filings"], as_of, stored_signals=run["signals"])
    assert again["new"].count() == 0 and again["signals"].count() == 4 and [r.sec_modifier for r in again["modifiers"].collect()] == [0.11]


def test_markup_is_written_after_the_lines_have_met(spark):
    plan = catalog_landed._ingested(spark, "/root/testdata/sf0.001")["new"]._jdf.queryExecution().optimizedPlan().toString()
    gathered = [line for line in plan.splitlines() if "collect_list(" in line and "l_linenumber" in line]
    assert gathered and not any("<transactionCode>" in line for line in gathered)


def test_bodies_and_lines_are_read_once(spark):
    plan = catalog_landed._ingested(spark, "/root/testdata/sf0.001")["new"]._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f"Relation [{key}#") for key in ("l_orderkey", "doc_id")] == [1, 1]


def test_reports_landed_apart(spark):
    rows = [("BIG", "4", "u", 0), ("BIG", "8-K", "e", 1), ("BIG", "X", "x", 2), ("FED", "8-K", "f", 0), ("FED", "NT 10-K", "n", 1), ("OFF", "4", "o", 0)]
    listed = spark.createDataFrame([*rows, rows[0]], "ticker string, form_type string, url string, position int").withColumn("filed_at", F.lit("2024-03-01").cast("date"))
    told = spark.createDataFrame([("u", report()), ("u", report()), ("u", report("S")), ("o", report())], "url string, body string")
    plain = spark.createDataFrame([(u, f"words of {u}") for u in "efnx"], "url string, body string")
    none = F.lit(None).cast("timestamp")
    symbols = spark.createDataFrame([(1, "big", "Big Co", True), (2, "fed", "Fed", True), (3, "off", "Off", False), (4, "odd", "Odd", None)], "id long, symbol string, company_name string, status boolean").withColumns({"last_10k_filed": none, "last_10q_filed": none})
    feeds = spark.createDataFrame([(2, True), (2, True), (1, False)], "symbol_id long, is_active boolean")
    stored = spark.createDataFrame([], "symbol_id long, url string, title string, full_text string, article_hash string, form_type string, filing_tier int, sec_source_weight double, published_at timestamp")
    run = lambda docs, **more: sorted(filings.ingest_filings(listed, docs, symbols, feeds, stored, F.lit("2024-03-15").cast("timestamp"), **more)["new"].collect())
    together = run(plain.unionByName(told))
    assert [(r.symbol_id, r.url, r.form_type) for r in together] == [(1, "e", "8-K"), (1, "u", "4"), (2, "n", "NT 10-K")]
    assert together[1].full_text.count("1000.0 shares") == 2
    # what else lies at a report's address is no report
    assert run(plain.unionByName(spark.createDataFrame([("u", "words")], plain.schema)), reports=told) == together
