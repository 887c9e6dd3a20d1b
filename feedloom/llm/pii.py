"""Personal data by weak supervision (operator 3).

One pass finds spans of the fixed patterns and looser candidates (obfuscated
addresses, phone numbers without a plus, grouped card numbers with a wrong check
digit) and lets four labelers vote on each: pattern, gazetteer, context and shape.
A candidate's votes form a pattern; counts of patterns, of which there is a fixed
number, are all that expectation-maximisation needs to estimate how reliable each
labeler is. The posteriors train a logistic span classifier, which decides on the
loose candidates. Spans of the fixed patterns always stay.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, texts_of

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "shape")
FOUND = "array<struct<kind:int,start:long,end:long,base:boolean,votes:string>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# starts only where a run of digits starts: from inside the run it would end alike
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"\x20?[\[(]at[\])]", re.I | re.A)
_HIDDEN_DOMAIN = re.compile(r"\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]+)+", re.I | re.A)
_BARE_PHONE = re.compile(r"(?<![\w+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{3,4}(?![\w-])", re.A)
_GROUPED_CARD = re.compile(r"[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}")

#: Gazetteers, context words and what speaks against a kind.
TOP_DOMAINS = frozenset("com org net edu gov int io de fr es it nl uk eu us ca ch at be pl info biz example".split())
#: One- and two-digit calling codes, then the beginnings that all three-digit codes share.
CALLING_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
CALLING_ZONES = tuple("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
#: First digits of card numbers by issuer, and first octets that no public host has.
ISSUERS = tuple("4 51 52 53 54 55 22 23 24 25 26 27 34 37 36 38 35 6011 64 65 62 50 56 57 58 67".split())
NO_HOST = frozenset(["0", "127", *map(str, range(224, 256))])
CONTEXT = {
    "email": re.compile(r"mail|contact|kontakt|correo|courriel|write to|reach"),
    "ip": re.compile(r"\bip\b|host|server|address|login|from"),
    "card": re.compile(r"card|visa|master|credit|karte|tarjeta|carte|pay"),
    "phone": re.compile(r"phone|tel|call|mobil|fax|anruf|llam"),
}
_LAST_WORD = re.compile(r"([^\W\d_]+)[^\w]*$")
#: Hash classes of the word before a span, one digit.
WORD_CLASSES = 8
AGAINST = re.compile(r"version|isbn|order|invoice|serial|chapter|section|\bv$")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: the local part is what can stand before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            done = tail.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns that pass their checks."""
    out = [(0, s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((3, *m.span()))
    return out


def _hidden_mails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a spelled ``[at]``, found from there as ``_emails`` does."""
    done = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        tail = _HIDDEN_DOMAIN.match(text, m.end()) if done <= start < m.start() else None
        if tail:
            done = tail.end()
            yield start, done


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that overlap no fixed span nor an earlier candidate."""
    found: list[tuple[int, int, int]] = []
    if "[" in text or "(" in text:
        found += [(0, *x) for x in _hidden_mails(text)]
    if _DIGIT.search(text):
        found += [(2, *m.span()) for m in _GROUPED_CARD.finditer(text)] + [(3, *m.span()) for m in _BARE_PHONE.finditer(text)]
    held: list[tuple[int, int]] = []  # disjoint and sorted: the fixed spans, overlapping ones as one
    for s, e in sorted((s, e) for _, s, e in taken):
        if held and s < held[-1][1]:
            held[-1] = (held[-1][0], max(e, held[-1][1]))
        else:
            held.append((s, e))
    out = []
    for kind, s, e in found:
        at = bisect.bisect_left(held, (s, s))
        if (at == 0 or held[at - 1][1] <= s) and (at == len(held) or held[at][0] >= e):
            out.append((kind, s, e))
            held.insert(at, (s, e))
    return out


def votes(text: str, kind: int, start: int, end: int, base: bool) -> str:
    """One of ``+0-`` from each labeler, then what only the classifier sees.

    These are digits: the size of the span, how it is separated, what stands
    right before and after it, and a hash class of the word before it.
    """
    span, before, name = text[start:end], text[max(0, start - 40) : start].lower(), KINDS[kind]
    digits = re.sub("[^0-9]", "", span)
    pattern = "+" if base else "-" if name == "card" else "0"
    if name == "email":
        last = re.split(r"[.\])\x20]+", span.lower())[-1]
        gazetteer = "+" if last in TOP_DOMAINS else "-"
        shape = "+" if span[0].isalnum() and span.find("@") <= 64 else "-"
    elif name == "ip":
        gazetteer = "-" if span.split(".")[0] in NO_HOST else "+"
        shape = "-" if text[end : end + 2][:1] == "." and text[end + 1 : end + 2].isdigit() else "+"
    elif name == "card":
        gazetteer = "+" if digits.startswith(ISSUERS) else "-"
        shape = "+" if len({len(x) for x in re.split("[ -]", span)}) == 1 else "-"
    else:
        gazetteer = "0" if span[0] != "+" else "+" if digits.startswith(CALLING_CODES + CALLING_ZONES) else "-"
        shape = "+" if 9 <= len(digits) <= 13 else "-"
    context = "+" if CONTEXT[name].search(before) else "-" if AGAINST.search(before) else "0"
    parted = 3 if "(" in span or "[" in span else 2 if " " in span else 1 if "-" in span else 0
    edges = [2 if not c or c in "\n\r" else 1 if c in " \t" else 3 if c in ":=" else 0 for c in (text[max(0, start - 1) : start], text[end : end + 1])]
    words = _LAST_WORD.search(before)
    word = zlib.crc32(words[1].encode()) % WORD_CLASSES if words else 0
    return pattern + gazetteer + context + shape + f"{min(3, len(digits) // 5)}{parted}{edges[0]}{edges[1]}{word}"


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, found``: fixed spans and loose candidates with their votes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string())])
        for batch in slices(batches, "text"):
            rows = []
            for text in batch["text"].to_pylist():
                fixed = base_spans(text)
                spans = [(*s, True) for s in fixed] + [(*s, False) for s in loose_spans(text, fixed)]
                rows.append([{"kind": k, "start": s, "end": e, "base": b, "votes": votes(text, k, s, e, b)} for k, s, e, b in spans])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, pa.list_(item))], ["doc_id", "found"])

    return texts_of(docs, id_col, text_col).mapInArrow(each, f"doc_id long, found {FOUND}")


def reliabilities(patterns: list[tuple[int, str, int]], rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over (kind, votes, count).

    Returns the posterior of each pattern and P(vote | truth, labeler), an array
    of truth x labeler x vote (``-``, ``0``, ``+``).
    """
    kinds = np.array([k for k, _, _ in patterns])
    cast = np.array([["-0+".index(c) for c in v[: len(LABELERS)]] for _, v, _ in patterns])
    weight = np.array([n for _, _, n in patterns], dtype=float)
    posterior = 1 / (1 + np.exp(-(cast - 1.0).sum(axis=1)))
    rates = np.full((2, len(LABELERS), 3), 1 / 3)
    for _ in range(rounds):
        for truth, p in ((0, 1 - posterior), (1, posterior)):
            for j in range(len(LABELERS)):
                # one pseudo-vote each, and one for the labeler being better than chance
                counts = np.bincount(cast[:, j], weights=weight * p, minlength=3) + [2.0 - truth, 1.0, 1.0 + truth]
                rates[truth, j] = counts / counts.sum()
        share = np.array([(np.sum((weight * posterior)[kinds == k]) + 1) / (weight[kinds == k].sum() + 2) for k in range(len(KINDS))])
        logit = np.log(share[kinds] / (1 - share[kinds]))
        for j in range(len(LABELERS)):
            logit += np.log(rates[1, j, cast[:, j]] / rates[0, j, cast[:, j]])
        posterior = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
    return posterior, rates


#: Values of each digit after the votes.
_DETAILS = (4, 4, 4, 4, WORD_CLASSES)


def _features(patterns: list[tuple[int, str, int]]) -> np.ndarray:
    """One-hot rows: kind, votes, and the details, each with its kind."""
    rows = []
    for kind, v, _ in patterns:
        one = [0.0] * (len(KINDS) + 3 * len(LABELERS) + len(KINDS) * sum(_DETAILS))
        one[kind] = 1.0
        for j, c in enumerate(v[: len(LABELERS)]):
            one[len(KINDS) + 3 * j + "-0+".index(c)] = 1.0
        at = len(KINDS) + 3 * len(LABELERS) + kind * sum(_DETAILS)
        for size, c in zip(_DETAILS, v[len(LABELERS) :], strict=True):
            one[at + int(c)] = 1.0
            at += size
        rows.append(one)
    return np.array(rows)


def span_classifier(patterns: list[tuple[int, str, int]], posterior: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Probabilities by logistic regression on the soft labels (Newton's method)."""
    x, weight = _features(patterns), np.array([n for _, _, n in patterns], dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (posterior - p)) - ridge * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def accepted_patterns(found: DataFrame, least: float = 0.8) -> list[str]:
    """``kind`` and votes of loose candidates that the classifier accepts.

    Expectation-maximisation sees the votes alone; the classifier, trained on
    its posteriors, also sees the span and its surroundings, and so can correct
    the labelers. Only pattern counts reach the driver, of a number that does
    not grow with the input: kinds x 3^labelers x 2,048 at most.
    """
    counted = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes").count().collect()
    patterns = sorted((r["kind"], r["votes"], r["count"]) for r in counted)
    if not patterns:
        return []
    cast: dict[tuple[int, str], int] = {}
    for k, v, n in patterns:
        cast[k, v[: len(LABELERS)]] = cast.get((k, v[: len(LABELERS)]), 0) + n
    by_votes, _ = reliabilities([(k, v, n) for (k, v), n in cast.items()])
    of_votes = dict(zip(cast, by_votes, strict=True))
    posterior = np.array([of_votes[k, v[: len(LABELERS)]] for k, v, _ in patterns])
    chance = span_classifier(patterns, posterior)
    return [f"{k}{v}" for (k, v, _), p in zip(patterns, chance, strict=True) if p >= least and v[0] != "+"]


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, by kind and then start."""
    names = F.array(*(F.lit(k) for k in KINDS))
    each = F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(each, ",")


def detect(docs: DataFrame, **columns: str) -> DataFrame:
    """``doc_id``, counts of fixed spans, ``base_sha256``, ``spans``, ``n_added``.

    Null text counts as empty. Repeated rows and null ids each come back; other
    columns are ignored; an empty table gives none. The candidates are written
    once to the shared folder, so that texts are scanned once.
    """
    found = materialize(find(docs, **columns), "pii-found")
    accepted = accepted_patterns(found)
    base = F.filter("found", lambda x: x["base"])
    spans = F.filter("found", lambda x: x["base"] | F.concat(x["kind"].cast("string"), x["votes"]).isin(accepted))
    count = lambda k: F.size(F.filter("found", lambda x: x["base"] & (x["kind"] == k))).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
        (F.size(spans) - F.size(base)).cast("long").alias("n_added"),
    )


def op3_weak_supervision_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents; edge cases as in ``detect``."""
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
