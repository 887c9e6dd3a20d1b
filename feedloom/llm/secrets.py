"""Secret scans by guess cost (operator 6).

Fixed patterns find assignments, access keys and long hexadecimal runs. Beyond
them, values in a credential context are weighed by the number of guesses that a
password attack needs: the cheapest segmentation of the value into words, dates,
repeats, keyboard walks and brute-force spans, by dynamic programming. Words rank
by their frequency in the whole corpus, rare ones too, so that prose after
"password" is cheap.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import ChainMap, Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, most_frequent, slices, texts_of

KINDS = ("assign", "access", "hex", "guess")
FOUND = "array<struct<start:long,kind:int,end:long>>"
#: Words in the dictionary that goes to every task, at most, and distinct words a
#: task counts at a time. Rarer words get their ranks by a join with all counts.
DICTIONARY, COUNTED = 200_000, 200_000
#: log10 of the guesses from which a value in context counts as a secret; for a
#: value that mixes letters of both cases, digits or signs, at least three of them.
LEAST_COST, LEAST_MIXED = 12.0, 8.0
#: Letters of a dictionary word.
WORD_LETTERS = (3, 40)
#: A longer keyboard walk costs more than 20 by its turns alone, however it is cut.
LONGEST_WALK = 512
#: Common passwords, ranked before the corpus's words.
COMMON = "password admin secret letmein welcome dragon monkey master login qwerty iloveyou sunshine princess football shadow changeme default root guest test".split()

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{16,}")
_CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code|wort)?|pwd|secret|token|api[\x20_-]?key|credentials?|private[\x20_-]?key|kennwort|mot\x20de\x20passe|contrase[ñn]a|clave)["']?\x20{0,3}(?::|=>?|->|\b(?:is|ist|est|es)\b)\x20{0,3}["']?([^\s"'`,;<>]{6,})""", re.I | re.A
)
#: As the pattern above begins, for Spark: every text that has a value has this.
_MAY_HOLD = r"(?i)(?:pass|pwd|secret|token|key|credential|kennwort|contrase[ñn]a|clave)[a-z]{0,6}[\"']?\x20{0,3}(?::|=|->|is|est|es)"
_CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "kennwort", "contrase", "clave")
#: Letters of any script.
_WORD = re.compile(r"[^\W\d_]{3,}")
_DATE = re.compile(r"(?:(?:19|20)[0-9]{2}[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)[0-9]{2}|[0-9]{2})|(?:19|20)[0-9]{2})")
_LOWER, _UPPER, _DIGITS, _OTHERS = (re.compile(x) for x in ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]"))
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, i + 0.5 * (r > 0) + 0.25 * (r > 1) + 0.25 * (r > 2)) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}


def _neighbours(a: str, b: str) -> bool:
    if a not in _PLACE or b not in _PLACE or a == b:
        return False
    (r, x), (s, y) = _PLACE[a], _PLACE[b]
    return abs(r - s) <= 1 and abs(x - y) <= 1


def _repeats(value: str) -> list[tuple[int, int] | None]:
    """By start: unit length and end of the shortest unit, of 16 at most, that repeats there."""
    n = len(value)
    out: list[tuple[int, int] | None] = [None] * n
    for unit in range(min(16, n // 2), 0, -1):
        run = 0
        for i in range(n - unit - 1, -1, -1):
            run = run + 1 if value[i] == value[i + unit] else 0
            if run >= unit:
                out[i] = unit, i + unit + run // unit * unit
    return out


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value``.

    A segment costs log10 of its guesses; beyond the first, each costs 1 more,
    for trying the order of segments. ``ranks``: rank of each known word.
    """
    n, low, repeats = len(value), "".join([c.lower()[0] for c in value]), _repeats(value)
    run = [0] * (n + 1)  # letters from here on
    for i in range(n - 1, -1, -1):
        run[i] = run[i + 1] + 1 if low[i].isalpha() else 0
    pieces: list[list[tuple[int, float]]] = [[] for _ in range(n)]  # by start: (end, cost)
    for i in range(n):
        for j in range(i + WORD_LETTERS[0], i + min(run[i], WORD_LETTERS[1]) + 1):
            rank = ranks.get(low[i:j])
            if rank:
                plain = value[i:j] == low[i:j]
                pieces[i].append((j, math.log10(rank * (1 if plain else 2) + 1)))
        if m := _DATE.match(value, i):
            pieces[i].append((m.end(), math.log10(365 * 120 if m.end() - i > 4 else 120)))
        if found := repeats[i]:
            unit, end = found
            pieces[i].append((end, min(unit * 1.0, math.log10(ranks.get(low[i : i + unit], 0) or 10**unit)) + math.log10((end - i) / unit)))
        j, turns, last = i + 1, 0, None
        while j < min(n, i + LONGEST_WALK) and _neighbours(low[j - 1], low[j]):
            step = (_PLACE[low[j]][0] - _PLACE[low[j - 1]][0], _PLACE[low[j]][1] > _PLACE[low[j - 1]][1])
            turns, last, j = turns + (step != last), step, j + 1
            if j - i >= 3:
                pieces[i].append((j, math.log10(47 * (j - i)) + turns * math.log10(4)))
    best = [0.0] + [math.inf] * n  # with 1 for each segment
    brute = math.inf  # the best that ends here in a brute-force span
    for i in range(n):
        here = best[i] + 1.0
        for j, cost in pieces[i]:
            best[j] = min(best[j], here + cost)
        brute = min(brute, here) + 1.0
        best[i + 1] = min(best[i + 1], brute)
    return best[n] - 1.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    low, out = text.lower(), []
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def _joined(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans, those that touch or overlap as one."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _kinds_of_signs(value: str) -> int:
    return sum(map(bool, (_LOWER.search(value), _UPPER.search(value), _DIGITS.search(value), _OTHERS.search(value))))


def _values(text: str) -> Iterator[tuple[int, str]]:
    """Values in a credential context with their starts."""
    low = text.lower()
    if any(w in low for w in _CONTEXT_WORDS):
        for m in _CONTEXT.finditer(text):
            yield m.start(1), m[1].rstrip(".!?:)]}")


def costs_enough(value: str, ranks: dict[str, int], least: float) -> bool:
    """Whether a value counts as a secret: from ``least``, or for mixed values two thirds of it."""
    return guess_cost(value, ranks) >= (least * LEAST_MIXED / LEAST_COST if _kinds_of_signs(value) >= 3 else least)


def guessed_spans(text: str, taken: list[tuple[int, int, int]], ranks: dict[str, int], least: float, spared: frozenset[str] = frozenset()) -> list[tuple[int, int, int]]:
    """Values in a credential context that reach beyond fixed spans and cost enough; none of ``spared``."""
    out = []
    starts, ends = _joined([(s, e) for s, _, e in taken])
    for start, value in _values(text):
        end = start + len(value)
        at = bisect.bisect_right(starts, start) - 1
        if len(value) >= 6 and not (at >= 0 and end <= ends[at]) and value not in spared and costs_enough(value, ranks, least):
            out.append((start, 3, end))
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c``: words of ``WORD_LETTERS`` of any script in all documents, from two occurrences on.

    Values in a credential context do not count, so that a secret in many copies
    of a document is no word by that. Null and empty texts have no words; every
    row counts, repeated ones too.
    """
    high = WORD_LETTERS[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = [w for w in counts if len(w) <= high]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["word", "c"])
            counts.clear()
            return out

        for batch in slices(batches, "text", 1 << 20):
            for text in batch["text"].to_pylist():
                done = 0
                for start, value in _values(text):
                    counts.update(_WORD.findall(text[done:start].lower()))
                    done = max(done, start + len(value))
                counts.update(_WORD.findall(text[done:].lower()))
            if len(counts) > COUNTED:
                yield flush()
        if counts:
            yield flush()

    return texts_of(docs).select("text").mapInArrow(partial, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")).filter("c > 1")


def top_ranks(counts: DataFrame, most: int = DICTIONARY) -> dict[str, int]:
    """Ranks of common passwords and of the ``most`` most frequent words.

    The words that reach the driver are ``most`` at most. Words of equal count
    come in all or not at all, and rank by spelling. An empty table leaves the
    common passwords.
    """
    top = most_frequent(counts, most).collect()
    words = [r["word"] for r in sorted(top, key=lambda r: (-r["c"], r["word"]))]
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *words]))}


def spared_values(docs: DataFrame, counts: DataFrame, ranks: dict[str, int], least: float) -> DataFrame:
    """``text_key, spared``: by text, values that ``ranks`` would make secrets, but the ranks of all words do not.

    Only such values, few, meet the counts, by every run of letters inside of
    them. A rarer word's rank is the number of words that are as frequent at
    least; words beyond the dictionary are on no driver and in no task whole.
    """
    low, high = WORD_LETTERS

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in batch["text"].to_pylist():
                own = {v for _, v in _values(text) if len(v) >= 6 and costs_enough(v, ranks, least)}
                if own:
                    key = hashlib.md5(text.encode()).hexdigest()
                    rows += [(key, v) for v in own]
            yield _columns(rows, ("text_key", "value"), (pa.string(), pa.string()))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "value", 1 << 20):
            for value in batch["value"].to_pylist():
                rows = set()
                for m in _WORD.finditer("".join([c.lower()[0] for c in value])):
                    for i in range(m.start(), m.end() - low + 1):
                        rows.update(m.string[i:j] for j in range(i + low, min(m.end(), i + high) + 1) if m.string[i:j] not in ranks)
                        if len(rows) > COUNTED:
                            yield _columns([(value, w) for w in rows], ("value", "word"), (pa.string(), pa.string()))
                            rows.clear()
                yield _columns([(value, w) for w in rows], ("value", "word"), (pa.string(), pa.string()))

    def cheap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for value, found in zip(batch["value"].to_pylist(), batch["found"].to_pylist()):
                if not costs_enough(value, ChainMap({x["word"]: x["rank"] for x in found}, ranks), least):
                    values.append((value,))
            yield _columns(values, ("value",), (pa.string(),))

    found = materialize(texts_of(docs).select("text").mapInArrow(suspects, "text_key string, value string").distinct(), "secret-suspects")
    words = found.select("value").distinct().mapInArrow(parts, "value string, word string").distinct().join(counts, "word")
    # One row for each distinct count, of which there are few: their squares sum up to the words.
    ladder = counts.groupBy("c").agg(F.count("*").alias("_n")).withColumn("rank", F.sum("_n").over(Window.orderBy(F.desc("c"))) + len(COMMON))
    ranked = words.join(ladder.select("c", "rank"), "c").groupBy("value").agg(F.collect_list(F.struct("word", "rank")).alias("found"))
    spared = ranked.mapInArrow(cheap, "value string")
    return materialize(found.join(spared, "value").groupBy("text_key").agg(F.collect_set("value").alias("spared")), "secret-spared")


def _columns(rows: list[tuple], names: tuple, types: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], list(names))


def _with_spared(rows: DataFrame, spared: DataFrame | None, ranks: dict[str, int], least: float) -> DataFrame:
    """``rows`` with ``_spared``; only texts that may hold a value in context take part in the join."""
    none = F.lit(None).cast("array<string>").alias("_spared")
    if spared is None:
        return rows.select("*", none)

    low = F.lower("text")
    told = reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in _CONTEXT_WORDS])
    marked = rows.withColumn("_question", F.coalesce(told & F.rlike("text", F.lit(_MAY_HOLD)), F.lit(False)))
    asked = marked.filter("_question").withColumn("_key", F.md5(F.col("text").cast("binary")))
    held = asked.join(spared.select(F.col("text_key").alias("_key"), F.col("spared").alias("_spared")), "_key", "left")
    return marked.filter("NOT _question").select(*rows.columns, none).unionByName(held.select(*rows.columns, "_spared"))


def known_words(docs: DataFrame, most: int, least: float) -> tuple[dict[str, int], DataFrame]:
    """The dictionary of ``docs`` and the values that its rarer words spare."""
    counts = materialize(word_counts(docs), "secret-words")
    ranks = top_ranks(counts, most)
    return ranks, spared_values(docs, counts, ranks, least)


def find(docs: DataFrame, ranks: dict[str, int], *, spared: DataFrame | None = None, least: float = LEAST_COST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, found`` for every row: spans by start, then kind."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
        for batch in slices(batches, "text"):
            rows = []
            for text, known in zip(batch["text"].to_pylist(), batch["_spared"].to_pylist()):
                spans = base_spans(text)
                spans += guessed_spans(text, spans, ranks, least, frozenset(known or ()))
                rows.append([{"start": s, "kind": k, "end": e} for s, k, e in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, pa.list_(item))], ["doc_id", "found"])

    return _with_spared(texts_of(docs, id_col, text_col), spared, ranks, least).mapInArrow(each, f"doc_id long, found {FOUND}")


def span_text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    each = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(each, ",")


def scan(docs: DataFrame, ranks: dict[str, int] | None = None, *, most: int = DICTIONARY, least: float = LEAST_COST, **options) -> DataFrame:
    """``doc_id``, counts by fixed kind, ``base_sha256``, ``spans``, ``n_guess``.

    Words rank by ``ranks``, or else by their counts in ``docs``: the ``most`` most
    frequent in a dictionary, the rest by a join. Null text counts as empty.
    Repeated rows and null ids each come back; other columns are ignored; an empty
    table gives none.
    """
    spared = None
    if ranks is None:
        ranks, spared = known_words(texts_of(docs, **options), most, least)
    found = find(docs, ranks, spared=spared, least=least, **options)
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(span_text(F.filter("found", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        span_text(F.col("found")).alias("spans"),
        count(3).alias("n_guess"),
    )


def redact(docs: DataFrame, ranks: dict[str, int] | None = None, *, mark: str = "[secret]", most: int = DICTIONARY, least: float = LEAST_COST) -> DataFrame:
    """The columns of ``docs`` with every found span of ``text`` replaced by ``mark``.

    Overlapping spans are replaced as one. ``n_chars``, where ``docs`` has it, is
    that of the new text; a null text stays null, an empty one empty. Every row
    comes back: repeated ones, null ids and all other columns as they are; an
    empty table gives none.
    """
    spared = None
    if ranks is None:
        ranks, spared = known_words(docs, most, least)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = []
            for text, known in zip(batch["text"].to_pylist(), batch["_spared"].to_pylist()):
                if text is not None:
                    spans = base_spans(text)
                    parts, done = [], 0
                    for s, _, e in sorted(spans + guessed_spans(text, spans, ranks, least, frozenset(known or ()))):
                        if s >= done:
                            parts += [text[done:s], mark]
                        done = max(done, e)
                    text = "".join(parts) + text[done:]
                texts.append(text)
            changed = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            names = [n for n in batch.schema.names if n != "_spared"]
            yield pa.RecordBatch.from_arrays([changed[n] if n in changed else batch[n] for n in names], names)

    own = docs.withColumns({"text": F.col("text").cast("string")} | ({"n_chars": F.col("n_chars").cast("long")} if "n_chars" in docs.columns else {}))
    return _with_spared(own, spared, ranks, least).mapInArrow(each, own.schema)


def op6_guess_cost_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents; edge cases as in ``scan``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
