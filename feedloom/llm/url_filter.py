"""URL filter: policy rules, and boosted trees where no rule fits (operator 5).

Only DataFrame functions. A url's lexical features (lengths, depth, digit ratio,
entropy, parameter counts, suffix statistics) are binned at training quantiles.
Suffixes fall into hash classes, each with its own rate of blocked urls, so that
every suffix has one; a training url is rated without the fold it belongs to.
Each level of a tree is one grouped sum of gradients by node, feature and bin;
the histogram, of fixed size, picks the splits. The model is a sum of nested
conditional expressions. Labelled urls are those that a rule judges, or a table
of the caller's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binned, bounded_sample, materialize

#: (verdict, host and path) of the policy.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Distinct labelled urls that the trees are trained on, at most; hash classes of
#: each kind of suffix, and folds for their rates.
MOST_TRAIN, SUFFIX_CLASSES, FOLDS = 20_000, 512, 4
FEATURES = ("url_chars", "host_chars", "path_chars", "depth", "host_dots", "hyphens", "params", "query_chars", "digit_ratio", "entropy", "top_rate", "section_rate", "ending_rate")
SUFFIXES = ("top", "section", "ending")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; both empty for null or without ``://``."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return pages.withColumns({"host": F.translate(raw, _UPPER, _LOWER), "path": path})


def rule_of(rules=RULES) -> Column:
    """The longest rule that fits ``host`` and ``path``; null if none does."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def rule_verdict(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def with_features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add the lexical features and the suffixes; rates come with a model."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    n = F.length(url)
    count = lambda text, c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    digits = n - F.length(F.regexp_replace(url, "[0-9]", ""))
    times = F.transform(F.array_distinct(F.split(url, "")), lambda c: F.when(c == "", 0.0).otherwise((n - F.length(F.replace(url, c, F.lit("")))).cast("double")))
    bits = F.aggregate(times, F.lit(0.0), lambda s, k: s + F.when(k > 0, k * F.log2(k)).otherwise(0.0))
    return df.withColumns(
        {
            "url_chars": n.cast("double"),
            "host_chars": F.length("host").cast("double"),
            "path_chars": F.length("path").cast("double"),
            "depth": count(F.col("path"), "/"),
            "host_dots": count(F.col("host"), "."),
            "hyphens": count(F.col("host"), "-"),
            "params": count(query, "="),
            "query_chars": F.length(query).cast("double"),
            "digit_ratio": F.when(n > 0, digits / n).otherwise(0.0),
            "entropy": F.when(n > 0, F.log2(n.cast("double")) - bits / n).otherwise(0.0),
            "top": F.substring_index("host", ".", -1),
            "section": F.concat(F.regexp_extract("path", r"^/([^/]*)/", 1), F.lit("/")),
            "ending": F.regexp_extract("path", r"(\.[A-Za-z0-9]{1,8}|/)$", 1),
        }
    )


@dataclass
class Tree:
    """Splits by node number (children 2n+1 and 2n+2) and values of its leaves."""

    splits: dict[int, tuple[str, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def _walk(self, leaf, node: int = 0) -> Column:
        if node not in self.splits:
            return leaf(node)
        feature, cut = self.splits[node]
        return F.when(F.col(f"{feature}_bin") >= cut, self._walk(leaf, 2 * node + 2)).otherwise(self._walk(leaf, 2 * node + 1))

    def node(self) -> Column:
        return self._walk(lambda n: F.lit(n))

    def value(self) -> Column:
        return self._walk(lambda n: F.lit(self.values.get(n, 0.0)))


def suffix_class(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(SUFFIX_CLASSES)).cast("int")


@dataclass
class BoostedTrees:
    """Cuts of each feature, block rates of suffix classes, the prior and the trees."""

    cuts: dict[str, list[float]]
    rates: dict[str, list[float]]
    margin: float
    trees: list[Tree]

    def with_rates(self, df: DataFrame) -> DataFrame:
        """Add the block rate of each suffix's class, from a literal array."""
        return df.withColumns({f"{name}_rate": F.get(F.lit(self.rates[name]), suffix_class(name)) for name in SUFFIXES})

    def with_bins(self, rated: DataFrame) -> DataFrame:
        """Add the bins to rows with features and rates."""
        return rated.withColumns({f"{f}_bin": binned(F.col(f), self.cuts[f]) for f in FEATURES})

    def probability(self) -> Column:
        """Chance of ``block`` for rows with bins."""
        total = F.lit(self.margin)
        for tree in self.trees:
            total = total + tree.value()
        return 1 / (1 + F.exp(-total))


def training_urls(labelled: DataFrame, most: int = MOST_TRAIN) -> DataFrame:
    """Distinct ``url, label`` rows, ``most`` at most by url hash.

    Their number is estimated first, so that only about twice ``most`` rows are
    grouped, however many the table has and however often a url repeats. Of two
    labels of one url the higher counts.
    """
    rows = labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("int").alias("label")).dropna()
    n = rows.agg(F.approx_count_distinct("url")).first()[0]
    share = F.xxhash64("url").cast("double") / 2.0**64 + 0.5
    if n > 2 * most:
        rows = rows.filter(share < 2.0 * most / n)
    return bounded_sample(rows.groupBy("url").agg(F.max("label").alias("label")), most, "url")


def _suffix_rates(sample: DataFrame, prior: float) -> tuple[dict[str, list[float]], DataFrame]:
    """Smoothed block rates by suffix class, and ``sample`` with out-of-fold ones."""
    rates, rated = {}, sample
    for name in SUFFIXES:
        counted = sample.groupBy("fold", suffix_class(name).alias("k")).agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()
        p, n = ([[0] * SUFFIX_CLASSES for _ in range(FOLDS)] for _ in range(2))
        for r in counted:
            p[r["fold"]][r["k"]], n[r["fold"]][r["k"]] = r["p"], r["n"]
        every = [(sum(f[k] for f in p), sum(f[k] for f in n)) for k in range(SUFFIX_CLASSES)]
        rate = lambda a, b: (a + 5 * prior) / (b + 5)
        rates[name] = [rate(*x) for x in every]
        own = F.lit(None).cast("double")
        for fold in range(FOLDS):
            others = [rate(every[k][0] - p[fold][k], every[k][1] - n[fold][k]) for k in range(SUFFIX_CLASSES)]
            own = F.when(F.col("fold") == fold, F.get(F.lit(others), suffix_class(name))).otherwise(own)
        rated = rated.withColumn(f"{name}_rate", own)
    return rates, rated


def train(labelled: DataFrame, *, trees: int = 10, depth: int = 3, rate: float = 0.4, ridge: float = 1.0, least_rows: float = 5.0, most_train: int = MOST_TRAIN) -> BoostedTrees:
    """Boost on ``url, label`` rows (1: block), ``most_train`` distinct urls at most.

    Null labels and urls are left out. No rows, or one class alone, give the
    smoothed prior and no tree.
    """
    sample = materialize(with_features(with_parts(training_urls(labelled, most_train))), "url-train")
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("url", F.lit(3)), F.lit(FOLDS)))
    size, blocked = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = (blocked + 0.5) / (size + 1)
    rates, rated = _suffix_rates(sample, prior)
    model = BoostedTrees({f: [] for f in FEATURES}, rates, math.log(prior / (1 - prior)), [])
    if not 0 < blocked < size:
        return model
    rated = materialize(rated.select("label", *FEATURES), "url-rated")
    quantiles = [k / 16 for k in range(1, 16)]
    found = rated.agg(*(F.percentile_approx(f, quantiles, 10_000).alias(f) for f in FEATURES)).first()
    model.cuts = {f: sorted(set(found[f])) for f in FEATURES}
    names = [f"{f}_bin" for f in FEATURES]
    kinds = model.with_bins(rated).groupBy(*names, "label").agg(F.count("*").alias("n"))
    kinds = materialize(kinds, "url-kinds")  # equal rows once, with their count
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"{f}_bin").alias("bin")) for f in FEATURES))).alias("cell")
    for _ in range(trees):
        p, tree = model.probability(), Tree()
        graded = kinds.withColumn("p", p).select(*names, (F.col("n") * (F.col("label") - F.col("p"))).alias("g"), (F.col("n") * F.col("p") * (1 - F.col("p"))).alias("h"), "n")
        open_nodes = {0}
        for level in range(depth):
            sums = graded.select(tree.node().alias("node"), "g", "h", "n", cells).groupBy("node", "cell.feature", "cell.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect()
            nxt = set()
            for node in sorted(open_nodes):
                split = _best_split([r for r in sums if r["node"] == node], model.cuts, ridge, least_rows)
                if split is None:
                    continue
                feature, cut, left, right = split
                tree.splits[node] = (feature, cut)
                tree.values[2 * node + 1], tree.values[2 * node + 2] = rate * left, rate * right
                nxt |= {2 * node + 1, 2 * node + 2}
            open_nodes = nxt
            if not open_nodes:
                break
        if not tree.splits:
            break
        model.trees.append(tree)
    return model


def _best_split(rows: list, cuts: dict[str, list[float]], ridge: float, least_rows: float):
    """(feature, bin, left value, right value) of the highest gain, or None."""
    best, by = None, {}
    for r in rows:
        by.setdefault(r["feature"], {})[r["bin"]] = (r["g"], r["h"], r["n"])
    for feature in FEATURES:
        cells = by.get(feature, {})
        g_all, h_all, n_all = (sum(c[k] for c in cells.values()) for k in range(3))
        g = h = n = 0.0
        for cut in range(1, len(cuts[feature]) + 1):
            dg, dh, dn = cells.get(cut - 1, (0.0, 0.0, 0))
            g, h, n = g + dg, h + dh, n + dn
            if n < least_rows or n_all - n < least_rows:
                continue
            gain = g * g / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            if gain > 1e-6 and (best is None or gain > best[0]):
                best = (gain, feature, cut, g / (h + ridge), (g_all - g) / (h_all - h + ridge))
    return best and best[1:]


def judge(pages: DataFrame, model: BoostedTrees | None = None, *, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, block_chance`` for every row.

    Without a ``model``, one is trained on the urls that a rule judges. A rule's
    verdict stands; else the model's, ``block`` from a chance of one half. Null
    urls have empty host and path and no rule. Repeated rows each come back;
    other columns are ignored; an empty table gives none.
    """
    # the row number, always true, keeps the filter on rules above this step: pushed
    # below it, every condition would parse the url once more, beyond what compiles
    rule = F.when(F.monotonically_increasing_id() >= 0, rule_of(rules))
    own = with_parts(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))).withColumn("rule", rule)
    if model is None:
        model = train(own.filter("rule is not null").select("url", (rule_verdict(F.col("rule"), rules) == "block").cast("int").alias("label")))
    scored = model.with_bins(model.with_rates(with_features(own))).withColumn("block_chance", model.probability())
    verdict = F.coalesce(rule_verdict(F.col("rule"), rules), F.when(F.col("block_chance") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_chance")


def op5_boosted_url_filter(spark, sf_dir: str) -> DataFrame:
    """A verdict for every page's url; edge cases as in ``judge``."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
