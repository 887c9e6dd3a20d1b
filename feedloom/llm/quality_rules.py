"""Quality rules: text statistics and a learned decision list (operator 10).

Statistics are DataFrame expressions over whole texts, one pass, no shuffle.
The list is learned by sequential covering: a rule grows literal by literal
(FOIL gain over binned thresholds), is pruned on held-out rows, and joins the
list while it stays precise; rows it covers then leave the training set. All
counts are grouped aggregations, of which only histograms (features x bins) reach
the driver. The result is an ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, binned, bounded_sample, materialize, texts_of

WINDOW = 5
FEATURES = (
    "n_words", "mean_chars", "symbol_share", "dup_line_share", "repeat_share",
    "upper_share", "digit_share", "shout_share", "distinct_share",
)
#: Quantiles at which a feature may be cut.
CUTS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995)


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts and shares of every whole text, one row per row of ``docs``.

    Null text has no words. ``n_repeat_words`` counts the words that lie in a
    window of five words found twice or more in the text; windows are compared
    by a 64-bit hash, sorted and not paired, so that its cost is n log n for
    texts of any length. Columns named in ``keep`` come along.
    """
    text = F.col("text")
    own = texts_of(docs, id_col, text_col) if not keep else docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep
    )

    def without(pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")

    blank = text
    for c in " \n\t\r\x0b\x0c":
        blank = F.replace(blank, F.lit(c))
    core = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = own.select(
        "doc_id",
        *keep,
        F.transform(F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, f"{WHITE}+")), lambda w: F.xxhash64(w)).alias("words"),
        F.length(blank).cast("long").alias("word_chars"),
        without(r"[#*$%&|<>]").alias("n_symbols"),
        without(r"[A-Z]").alias("n_upper"),
        without(r"[0-9]").alias("n_digits"),
        without(r"[!?]").alias("n_shouts"),
        lines.alias("lines"),
    )
    df = df.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_distinct": F.size(F.array_distinct("words")).cast("long"),
            "windows": F.when(
                F.size("words") >= WINDOW,
                F.transform(
                    F.sequence(F.lit(0), F.size("words") - WINDOW),
                    lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW))),
                ),
            ),
        }
    ).drop("lines", "words")
    df = df.withColumn(
        "sorted",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
        ),
    ).drop("windows")
    df = df.withColumn(
        "at",
        F.sort_array(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.sequence(F.lit(1), F.size("sorted") - 1),
                        lambda k: F.when(
                            F.get("sorted", k)["w"] == F.get("sorted", k - 1)["w"],
                            F.array(F.get("sorted", k - 1)["i"], F.get("sorted", k)["i"]),
                        ).otherwise(F.array().cast("array<int>")),
                    )
                )
            )
        ),
    ).drop("sorted")
    reach = F.zip_with("at", F.slice("at", F.lit(2), F.size("at")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    repeats = F.when(F.col("at").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(reach, F.lit(0).cast("long"), lambda s, x: s + x))
    # the row number, always true, keeps later filters above this step: pushed
    # below it, each of their conditions would compute the windows once more
    df = df.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, repeats)).drop("at")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.withColumns(
        {
            "mean_chars": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "upper_share": share("n_upper", "word_chars"),
            "digit_share": share("n_digits", "word_chars"),
            "shout_share": share("n_shouts", "word_chars"),
            "distinct_share": share("n_distinct", "n_words"),
        }
    )


def base_failed() -> Column:
    """The fixed rules: under ten words, or over a fifth of the words repeat."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Literal:
    feature: str
    at_least: bool
    threshold: float

    def holds(self) -> Column:
        c = F.col(self.feature).cast("double")
        return c >= self.threshold if self.at_least else c < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


def conjunction(literals: list[Literal]) -> Column:
    out = F.lit(True)
    for x in literals:
        out = out & x.holds()
    return out


class DecisionList:
    """Ordered rules, each a conjunction that rejects; what none covers stays."""

    def __init__(self, rules: list[list[Literal]]):
        self.rules = rules

    def rule_number(self) -> Column:
        """Number of the first rule that holds, from 1; null where none does."""
        out = F.lit(None).cast("int")
        for i in reversed(range(len(self.rules))):
            out = F.when(conjunction(self.rules[i]), F.lit(i + 1)).otherwise(out)
        return out

    def rejects(self) -> Column:
        return self.rule_number().isNotNull()

    def __str__(self) -> str:
        return "\n".join(f"{i}: reject if " + " and ".join(map(str, r)) for i, r in enumerate(self.rules, 1))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, label: Column, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` with a ``label``, ``most`` at most, chosen by id hash.

    Labels that are null, or whose id is, are left out; for repeated ids the
    smallest label counts. The chosen ids are broadcast: ``most`` bounds them.
    Clashing column names in ``docs`` do no harm.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("picked_id"), label.alias("picked_label")).dropna()
    known = known.groupBy("picked_id").agg(F.min("picked_label").alias("picked_label"))
    picked = bounded_sample(known, most, "picked_id")
    own = docs.drop("label", "picked_id", "picked_label")
    return own.join(F.broadcast(picked), F.col(id_col).cast("long") == F.col("picked_id")).withColumnRenamed("picked_label", "label")


def learn(rows: DataFrame, *, most_rules: int = 8, most_literals: int = 3, least_precision: float = 0.9, least_covered: int = 5) -> DecisionList:
    """Learn a decision list from ``rows`` with the features and ``label`` (1: reject).

    A third of the rows, by id hash, prunes; the others grow. No label 1, or no
    precise rule, gives an empty list, which keeps everything.
    """
    rows = rows.select("doc_id", "label", *(F.col(f).cast("double").alias(f) for f in FEATURES)).withColumn(
        "prunes", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0
    )
    found = rows.agg(*(F.percentile_approx(f, list(CUTS), 10_000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted({x for x in (found[f] or []) if x is not None}) for f in FEATURES}
    if not any(cuts.values()):
        return DecisionList([])
    bins = {f: binned(F.col(f), cuts[f]) for f in FEATURES}
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), bins[f].alias("bin")) for f in FEATURES))).alias("cell")
    rules: list[list[Literal]] = []
    rest = rows
    while len(rules) < most_rules:
        rule: list[Literal] = []
        grow = rest.filter(~F.col("prunes"))
        while len(rule) < most_literals:
            counted = (
                grow.filter(conjunction(rule)).select("label", pairs)
                .groupBy("cell.feature", "cell.bin").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()
            )
            best = _best_literal(counted, cuts)
            if best is None:
                break
            literal, done = best
            rule.append(literal)
            if done:
                break
        if not rule:
            break
        heads = [conjunction(rule[: k + 1]) for k in range(len(rule))]
        held = rest.filter("prunes").agg(
            *(F.sum(F.when(h, F.col("label"))).alias(f"p{k}") for k, h in enumerate(heads)),
            *(F.sum(F.when(h, 1)).alias(f"n{k}") for k, h in enumerate(heads)),
        ).first()
        worth = lambda k: (held[f"p{k}"] or 0) / ((held[f"n{k}"] or 0) + 1)
        k = max(range(len(rule)), key=worth)
        covered, right = held[f"n{k}"] or 0, held[f"p{k}"] or 0
        if covered < least_covered or right < least_precision * covered:
            break
        rules.append(rule[: k + 1])
        rest = rest.filter(~conjunction(rule[: k + 1]))
    return DecisionList(rules)


def _best_literal(counted: list, cuts: dict[str, list[float]]) -> tuple[Literal, bool] | None:
    """The threshold of highest FOIL gain; whether its cover is pure already."""
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for row in counted:
        by.setdefault(row["feature"], {})[row["bin"]] = (row["p"], row["n"])
    if not by:
        return None
    first = next(iter(by.values()))
    p_all, n_all = sum(p for p, _ in first.values()), sum(n for _, n in first.values())
    if not p_all or p_all == n_all:
        return None
    before, best = math.log2(p_all / n_all), None
    for feature in FEATURES:
        cells = by.get(feature, {})
        p_below = n_below = 0
        for b, threshold in enumerate(cuts[feature]):
            p, n = cells.get(b, (0, 0))
            p_below, n_below = p_below + p, n_below + n
            for at_least, ps, ns in ((True, p_all - p_below, n_all - n_below), (False, p_below, n_below)):
                if ps and ns < n_all:
                    gain = ps * (math.log2(ps / ns) - before)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, Literal(feature, at_least, threshold), ps == ns)
    return best and best[1:]


def learn_rules(docs: DataFrame, labels: DataFrame, *, most_train: int = 20_000, **options) -> DecisionList:
    """The list learned from at most ``most_train`` documents with a quality label.

    Null and empty texts have statistics of zero; labels without a document or a
    quality do not count, and without any the list is empty. Other columns are
    ignored.
    """
    sample = labelled_sample(docs.select("doc_id", "text"), labels, most_train, (F.lit(1) - F.col("quality")).cast("int"))
    return learn(materialize(statistics(sample, keep=("label",)), "quality-rules-train"), **options)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Statistics with ``base_failed``, ``rule`` (null: none) and ``kept``.

    One row per row of ``docs``: repeated rows and null ids too. Null and empty
    texts fail the base rule. Other columns are ignored.
    """
    return statistics(docs).withColumns({"base_failed": base_failed(), "rule": rules.rule_number()}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op10_learned_rules(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict for all documents, the list learned from labels; edge cases as in ``learn_rules`` and ``judge``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def quality_rules_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject.

    All columns of ``docs`` come along, whatever their names. Null and empty
    texts go; repeated rows and null ids are judged like any other row; an empty
    table gives none.
    """
    rules = learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return passing(docs, rules)


def passing(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and ``rules``, with all columns."""
    whole = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    judged = statistics(whole, keep=("whole",))
    return judged.filter(~base_failed() & rules.rule_number().isNull()).select("whole.*")
