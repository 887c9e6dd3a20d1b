"""Text, url and number parsing as columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity and character.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_html(text: Column | str) -> Column:
    """Tags and entities out, white space to single spaces, trimmed."""
    out = F.regexp_replace(_c(text), "<[^>]*>", " ")
    for entity, c in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def contains_ci(text: Column | str, needle: str) -> Column:
    """Substring, whatever the case; no wildcards."""
    return F.coalesce(F.contains(F.lower(_c(text)), F.lower(F.lit(needle))), F.lit(False))


def any_word(text: Column | str, words: list[str]) -> Column:
    """Whether any of the words stands in the text as a whole word."""
    import re

    return F.coalesce(_c(text).rlike(r"(?i)\b(" + "|".join(re.escape(w) for w in words) + r")\b"), F.lit(False)) if words else F.lit(False)


def has_word(text: Column, word: Column) -> Column:
    """Whether the text has the word or phrase of another column, as whole words, whatever the case."""
    quoted = F.concat(F.lit("(?i)\\b\\Q"), F.replace(word, F.lit("\\E"), F.lit("")), F.lit("\\E\\b"))
    return F.coalesce(F.regexp_like(text, quoted), F.lit(False))


RECIPES = {
    "url|title|time": lambda url, title, at: F.concat_ws("|", url, title, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")),
    "url|title": lambda url, title, at: F.concat_ws("|", url, title),
    "title|url": lambda url, title, at: F.concat_ws("|", title, url),
    "title+url": lambda url, title, at: F.concat(F.coalesce(title, F.lit("")), F.coalesce(url, F.lit(""))),
    "title|url|epoch": lambda url, title, at: F.concat_ws("|", title, url, F.unix_timestamp(at).cast("string")),
}


def article_hash(url: Column | str, title: Column | str, at: Column | str, recipe: str = "url|title|time") -> Column:
    return F.sha2(RECIPES[recipe](_c(url), _c(title), _c(at)), 256)


# Parts of an address that tell a feed.
ATOM_QUERIES = ("type=atom", "format=atom")
RSS_PARTS = ("/rss", "/atom", "/feed", "/feeds", "rss.xml", "atom.xml", "feed.xml", "news.xml", "rss/news", "rss/press", "atom/news")
RSS_QUERIES = ("pagetemplate=rss", "format=rss", "format=feed", "type=atom", "type=rss", "feed=rss", "feed=atom", "output=rss")


def _any_part(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def classify_feed_url(url: Column | str) -> Column:
    """``atom`` or ``rss`` by the shape of the address, else null.

    ``atom`` counts in the path or as a query, not in the host; then the signs
    of RSS in the whole address, in the query, or ``.xml`` at its end.
    """
    u = F.lower(_c(url))
    after = F.regexp_extract(u, r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return (
        F.when(after.contains("atom") | _any_part(query, ATOM_QUERIES), "atom")
        .when(_any_part(u, RSS_PARTS) | _any_part(query, RSS_QUERIES) | u.endswith(".xml"), "rss")
    )


def ticker_from_url(url: Column | str, symbol: Column | str) -> Column:
    """The ticker that a listing's address names, else the symbol; lower case."""
    u = F.lower(_c(url))
    named = F.coalesce(F.nullif(F.regexp_extract(u, r"/stocks/([^/]+)/press-releases", 1), F.lit("")), F.nullif(F.regexp_extract(u, r"symbol:([^|&]+)", 1), F.lit("")))
    return F.lower(F.coalesce(named, _c(symbol)))


# Lengths to which texts are cut, by use.
CLIPS = {"title": 200, "hint": 300, "reason": 500, "summary": 1_000, "forecast": 2_000, "facts": 4_000, "body": 100_000}


def clip_text(text: Column | str, most: int | str) -> Column:
    """The first signs of a text: so many, or what its use allows."""
    return F.left(_c(text), F.lit(CLIPS[most] if isinstance(most, str) else most))


def detect_platform(url: Column | str) -> Column:
    u = F.lower(_c(url))
    return (
        F.when(u.contains("default.aspx"), "q4ir").when(u.contains("nasdaq.com"), "nasdaq").when(u.contains("finance.yahoo"), "yahoo")
        .when(u.contains("mynewsdesk"), "mynewsdesk").when(u.isNotNull(), "generic")
    )


def parse_figure(text: Column | str) -> Column:
    """Number in millions of a written figure; percent as it is, bps as percent.

    The unit must follow the number; what is no number gives null.
    """
    t = F.regexp_replace(F.trim(_c(text)), r"[$€£,\s]", "")
    number = F.regexp_extract(t, r"^([+-]?[0-9]*\.?[0-9]+)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(t, r"^[+-]?[0-9]*\.?[0-9]+(%|[A-Za-z]+)?$", 1))
    scaled = (
        F.when(unit.isin("", "%", "m", "mn", "million"), number).when(unit == "bps", number / 100).when(unit.isin("t", "trillion"), number * 1e6)
        .when(unit.isin("b", "bn", "billion"), number * 1e3).when(unit.isin("k", "thousand"), number / 1e3)
    )
    return F.when(t.rlike(r"^[+-]?[0-9]*\.?[0-9]+(%|[A-Za-z]+)?$"), scaled)


def first_number(text: Column | str) -> Column:
    return F.regexp_extract(_c(text), r"[+-]?[0-9]+(\.[0-9]+)?", 0).try_cast("double")


def format_volume(n: Column | str) -> Column:
    """1.2M, 3K or the whole number."""
    c = _c(n).cast("double")
    return (
        F.when(c >= 1e6, F.format_string("%.1fM", c / 1e6)).when(c >= 1e3, F.format_string("%.0fK", c / 1e3)).when(c.isNotNull(), F.format_string("%d", c.cast("long")))
    )


def format_percent(share: Column | str) -> Column:
    """A share as percent, such as 12.3%."""
    c = _c(share).cast("double")
    return F.when(c.isNotNull(), F.format_string("%.1f%%", c * 100))


def first_line(text: Column | str) -> Column:
    return F.get(F.split(_c(text), "\n"), F.lit(0))


def clean_text(text: Column | str) -> Column:
    """Runs of blank lines and of blanks shortened, outer white space off."""
    out = F.regexp_replace(F.regexp_replace(_c(text), r"\n{3,}", "\n\n"), r"[ \t]{4,}", " ")
    return F.btrim(out, F.lit(" \t\r\n"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def find_section(text: Column | str, start: str, end: str, most: int, *, upper: bool = False) -> Column:
    """From the first line that matches ``start`` to the next that matches ``end``; null if none does.

    With ``upper`` the lines are compared trimmed and in upper case.
    """
    found = find_sections(text, *section_marks([("", start, end, most)]), upper=upper, clean=lambda x: x)
    return F.get(found, F.lit(0))["body"]


def section_marks(table: Iterable[tuple[str, str, str, int]]) -> tuple[Column, Callable[[Column], Column]]:
    """Sections (name, starts, ends, budget) as a list of structs, and the test whether a line is a mark of any."""
    rows = list(table)
    structs = [F.struct(F.lit(n).alias("name"), F.lit(a).alias("starts"), F.lit(b).alias("ends"), F.lit(most).alias("most")) for n, a, b, most in rows]
    patterns = list(dict.fromkeys(x for _, a, b, _ in rows for x in (a, b)))
    either = F.lit("|".join(f"(?:{x})" for x in patterns))
    words = first_words(patterns)
    if not words:
        return F.array(*structs), lambda line: F.rlike(line, either)
    # Looking for a few words is much faster than trying every pattern at every sign.
    return F.array(*structs), lambda line: reduce(lambda x, y: x | y, [F.contains(line, F.lit(w)) for w in words]) & F.rlike(line, either)


def first_words(patterns: Iterable[str], least: int = 3) -> list[str]:
    """Words of which a text that matches any of the patterns has one; none if that cannot be told.

    A word is what every alternative of a pattern begins with, letter by letter.
    """
    words = []
    for pattern in patterns:
        depth, parts = 0, [""]
        for c in pattern:
            depth += (c in "([") - (c in ")]")
            if c == "|" and not depth:
                parts.append("")
            else:
                parts[-1] += c
        for part in parts:
            word = re.match(r"[A-Z0-9]*(?![?*{])", part)[0]
            if len(word) < least or "\\Q" in part:
                return []
            words.append(word)
    shortest = sorted(set(words), key=lambda w: (len(w), w))
    return [w for i, w in enumerate(shortest) if not any(x in w for x in shortest[:i])]




def find_sections(text: Column | str, sections: Column, is_mark: Callable[[Column], Column], *, upper: bool = True, clean: Callable[[Column], Column] = clean_text) -> Column:
    """``[(name, body)]``: the sections of a text in the order of the table, without those that do not begin.

    The lines are split and searched once, by ``is_mark``, whatever the number of
    sections; each section then looks for its own start and end among the few
    lines that were found. ``sections`` may differ from row to row.
    """
    seen = (lambda x: F.upper(F.trim(x))) if upper else (lambda x: x)

    def of_lines(lines: Column) -> Column:
        numbered = F.transform(lines, lambda x, i: F.struct(i.alias("at"), seen(x).alias("line")))
        return once(F.filter(numbered, lambda m: F.coalesce(is_mark(m["line"]), F.lit(False))), lambda found: of_marks(lines, found))

    def of_marks(lines: Column, found: Column) -> Column:
        first = lambda ok: F.get(F.filter(found, ok), F.lit(0))["at"]
        begun = F.transform(sections, lambda s: F.struct(s.alias("s"), first(lambda m: F.rlike(m["line"], s["starts"])).alias("at")))
        begun = F.filter(begun, lambda x: x["at"].isNotNull())
        ended = F.transform(
            begun, lambda x: F.struct(x["s"].alias("s"), x["at"].alias("at"), first(lambda m: (m["at"] > x["at"]) & F.rlike(m["line"], x["s"]["ends"])).alias("stop"))
        )
        inside = lambda x: F.array_join(F.slice(lines, x["at"] + 1, F.coalesce(x["stop"], F.size(lines)) - x["at"]), "\n")
        return F.transform(ended, lambda x: F.struct(x["s"]["name"].alias("name"), clean(F.left(F.trim(inside(x)), x["s"]["most"])).alias("body")))

    return once(F.split(_c(text), "\n"), of_lines)


def company_search_url(name: Column | str, prefix: str) -> Column:
    """A search address: the name percent-encoded twice, slashes once."""
    once = F.replace(F.replace(F.url_encode(_c(name)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.concat(F.lit(prefix), F.replace(F.url_encode(once), F.lit("%2F"), F.lit("/")))
