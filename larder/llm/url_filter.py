"""URL filter: host rules first, then gradient-boosted trees on lexical features.

The trees are grown with DataFrame aggregates alone.  Features are binned once;
equal bin vectors are summed into one row; each level of a tree is one
``groupBy(node, feature, bin)`` over these rows whose result (nodes x features
x bins rows) decides the splits.  A finished ensemble is a sum of CASE
expressions, so that scoring is one projection with no join, shuffle or Python.

Nulls and oddities: a null url or one without ``://`` has an empty host and
path, matches no rule and is judged by the trees like any other.  Repeated
rows are judged one by one.  Without labelled URLs (empty table) every method
verdict is ``allow``.

The statistics are those of the host's last one and two labels and of the path's
first segment.  A statistic that alone tells nearly every training label is
withheld, as nothing else would be learnt beside it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import fold, prepare, table

# The rules of the contract, (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

MAX_LABELLED = 65_536  # labelled URLs the trees are fitted on, the smallest by hash


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z folded) and path of a url; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return fold(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def match(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.when(F.lit(False), F.lit(""))
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        where, slash, under = text.partition("/")
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(slash + under)
        rule, verdict = rule.when(fits, text), verdict.when(fits, says)
    return rule, verdict


def count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def lexical(df: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """Lexical features of ``url`` as double columns ``f_*``, the host's suffixes
    ``s_top`` (last label) and ``s_two`` (last two labels), and ``s_seg``, the first
    segment of the path that follows them."""
    u = F.coalesce(F.col(url), F.lit(""))
    h, p = F.col(host), F.col(path)
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    length = F.length(u)
    # Entropy of the characters of the host: one term for each symbol of a fixed alphabet.
    letters = [(count_of(h, c if c.isalnum() else "\\" + c) / F.greatest(F.length(h), F.lit(1))) for c in "abcdefghijklmnopqrstuvwxyz0123456789-."]
    entropy = sum((F.when(x > 0, -x * F.log2(x)).otherwise(0.0) for x in letters), F.lit(0.0))
    return (
        df.withColumns({
            "f_length": length,
            "f_host_length": F.length(h),
            "f_path_length": F.length(p),
            "f_depth": F.size(F.filter(F.split(p, "/"), lambda x: x != "")),
            "f_labels": count_of(h, r"\."),
            "f_digit_ratio": count_of(u, r"[0-9]") / F.greatest(length, F.lit(1)),
            "f_host_digits": count_of(h, r"[0-9]"),
            "f_hyphens": count_of(h, r"-"),
            "f_entropy": entropy,
            "f_params": F.when(query == "", 0).otherwise(count_of(query, r"&") + 1),
            "f_fragment": F.contains(u, F.lit("#")).cast("int"),
            "s_top": F.substring_index(h, ".", -1),
            "s_two": F.substring_index(h, ".", -2),
            "s_seg": F.regexp_extract(p, r"(?s)^/([^/]*)", 1),
        })
    )


FEATURES = ("f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digit_ratio", "f_host_digits",
            "f_hyphens", "f_entropy", "f_params", "f_fragment", "f_top_rate", "f_top_count", "f_two_rate", "f_two_count",
            "f_seg_rate", "f_seg_count")
SUFFIXES = {"s_top": "top", "s_two": "two", "s_seg": "seg"}
FOLDS = 5
DECIDES = 0.99  # a suffix column that tells so large a share of the labels alone is withheld


@dataclass
class Trees:
    """A fitted ensemble: bin edges, and per tree the splits {node: (feature,
    edge)} and leaf values {node: value}; children of node n are 2n and 2n+1."""

    prior: float = 0.0
    edges: dict = field(default_factory=dict)
    trees: list = field(default_factory=list)


def _leaf(tree: tuple[dict, dict], feature, node: int = 1) -> Column:
    splits, leaves = tree
    if node in splits:
        name, edge = splits[node]
        return F.when(feature(name) <= F.lit(edge), _leaf(tree, feature, 2 * node)).otherwise(_leaf(tree, feature, 2 * node + 1))
    return F.lit(leaves[node])


def margin(model: Trees, feature=F.col) -> Column:
    return sum((_leaf(t, feature) for t in model.trees), F.lit(model.prior))


def fit(binned: DataFrame, model: Trees, n_trees: int, depth: int, rate: float, reg: float = 1.0) -> Trees:
    """Boost on rows (f_* as bin numbers, n, pos).  Each level asks Spark for the
    gradient sums by node, feature and bin: at most 2**depth x features x bins rows."""
    names = list(model.edges)
    stack = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in names])).alias("x")
    for _ in range(n_trees):
        p = 1.0 / (1.0 + F.exp(-margin(model)))
        rows = binned.withColumns({"g": F.col("pos") - F.col("n") * p, "h": F.col("n") * p * (1 - p)})
        splits: dict = {}
        leaves: dict = {1: 0.0}
        for level in range(depth):
            open_nodes = [n for n in leaves if n >= 2 ** level]
            node = _leaf((splits, {n: n for n in leaves}), F.col).cast("int")
            got = (
                rows.select(node.alias("node"), "g", "h", stack).where(F.col("node").isin(open_nodes))
                .groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            )
            by: dict = {}
            for r in got:
                by.setdefault(r["node"], {}).setdefault(r["f"], []).append((r["b"], r["g"], r["h"]))
            for n, feats in sorted(by.items()):
                best = None
                for f in sorted(feats):
                    bins = sorted(feats[f])
                    g, h = sum(x[1] for x in bins), sum(x[2] for x in bins)
                    left_g = left_h = 0.0
                    for i, (b, bg, bh) in enumerate(bins):
                        left_g, left_h = left_g + bg, left_h + bh
                        if i + 1 < len(bins):
                            gain = left_g ** 2 / (left_h + reg) + (g - left_g) ** 2 / (h - left_h + reg) - g ** 2 / (h + reg)
                            if min(left_h, h - left_h) > 0.5 and gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                                best = (gain, f, b)
                    leaves[n] = round(rate * g / (h + reg), 9)
                if best:
                    gain, f, b = best
                    splits[n] = (f, b)
                    bins = sorted(feats[f])
                    for child, side in ((2 * n, [x for x in bins if x[0] <= b]), (2 * n + 1, [x for x in bins if x[0] > b])):
                        leaves[child] = round(rate * sum(x[1] for x in side) / (sum(x[2] for x in side) + reg), 9)
                    del leaves[n]
        model.trees.append((splits, leaves))
    return model


def train(labelled: DataFrame, url: str = "url", label: str = "label", max_labelled: int = MAX_LABELLED,
          n_bins: int = 16, n_trees: int = 16, depth: int = 3, rate: float = 0.3):
    """Fit on labelled URLs (label 1: block, 0: allow; other rows are left out).

    At most ``max_labelled`` distinct URLs are taken, the smallest by hash.
    Returns the ensemble, the suffix tables, which hold at most ``max_labelled``
    rows each and so may be broadcast, and the overall block rate.

    Suffix rates are cross-fitted: a training URL gets the rates of the other
    folds, so that its own label stays out of them, while its suffix's number of
    URLs, which tells nothing of the label, is the same as in scoring."""
    seen = (
        labelled.where(F.col(label).isin(0, 1) & F.col(url).isNotNull())
        .groupBy(F.col(url).alias("u_")).agg(F.max(F.col(label)).cast("int").alias("y"))
        .orderBy(F.xxhash64("u_"), "u_").limit(max_labelled)
    )
    host, path = parts(F.col("u_"))
    fold = F.pmod(F.xxhash64(F.col("u_"), F.lit("fold")), F.lit(FOLDS)).cast("int")
    sample = lexical(seen.withColumns({"h_": host, "p_": path, "fold": fold}), "u_", "h_", "p_").checkpoint()
    total, positive = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    model = Trees()
    counts = [F.count("*").alias("n_"), F.sum("y").alias("y_")]
    stats = {s: sample.groupBy(s).agg(*counts) for s in SUFFIXES}
    rate_all = (positive + 1.0) / (total + 2.0)
    model.prior = round(math.log(rate_all / (1 - rate_all)), 9) if total else -1.0
    if not total or positive in (0, total):
        return model, stats, rate_all
    rows = with_suffixes(sample, stats, rate_all, {s: sample.groupBy(s, "fold").agg(*counts) for s in SUFFIXES})
    told = {s: stats[s].agg(F.sum(F.greatest("y_", F.col("n_") - F.col("y_")))).first()[0] / total for s in SUFFIXES}
    features = [f for f in FEATURES if not any(f.startswith(f"f_{short}_") and told[s] >= DECIDES for s, short in SUFFIXES.items())]
    quantiles = rows.agg(*[F.percentile_approx(f, [i / n_bins for i in range(1, n_bins)], 10_000).alias(f) for f in features]).first()
    # An edge lies half-way between a value and the next one: no value falls on it.
    values = {f: sorted(set(quantiles[f])) for f in features}
    above = rows.agg(*[F.min(F.when(F.col(f) > v, F.col(f))).alias(f"{f}_{i}") for f in features for i, v in enumerate(values[f])]).first()
    edges = {f: [(v + above[f"{f}_{i}"]) / 2 for i, v in enumerate(values[f]) if above[f"{f}_{i}"] is not None] for f in features}
    bins = {f: sum((F.when(F.col(f) > e, 1).otherwise(0) for e in edges[f]), F.lit(0)) for f in features if edges[f]}
    binned = rows.select("y", *[c.alias(f) for f, c in bins.items()]).groupBy(*bins).agg(F.count("*").alias("n"), F.sum("y").alias("pos")).checkpoint()
    model.edges = {f: edges[f] for f in bins}
    fit(binned, model, n_trees, depth, rate)
    # From bin numbers to values: bin <= b holds where the value is at most edge b.
    trees = []
    for splits, leaves in model.trees:
        trees.append(({n: (f, float(edges[f][b]) if b < len(edges[f]) else float("inf")) for n, (f, b) in splits.items()}, leaves))
    model.trees = trees
    return model, stats, rate_all


def with_suffixes(df: DataFrame, stats: dict, rate_all: float, own_fold: dict | None = None, weight: float = 5.0) -> DataFrame:
    """Suffix statistics: labelled URLs under the suffix and their smoothed block rate,
    without those of the row's own fold where ``own_fold`` has them.  Scoring takes all
    folds, scaled to as many URLs as a training row's rate is made of."""
    share = (FOLDS - 1) / FOLDS
    for s, short in SUFFIXES.items():
        df = df.join(F.broadcast(stats[s].select(s, F.col("n_").alias("n_all"), F.col("y_").alias("y_all"))), s, "left")
        n, y = F.coalesce("n_all", F.lit(0)), F.coalesce("y_all", F.lit(0))
        if own_fold is None:
            rate_n, rate_y = n * share, y * share
        else:
            df = df.join(F.broadcast(own_fold[s].select(s, "fold", F.col("n_").alias("n_own"), F.col("y_").alias("y_own"))), [s, "fold"], "left")
            rate_n, rate_y = n - F.coalesce("n_own", F.lit(0)), y - F.coalesce("y_own", F.lit(0))
        df = df.withColumns({f"f_{short}_rate": (rate_y + weight * rate_all) / (rate_n + weight),
                             f"f_{short}_count": F.log1p(n.cast("double"))}).drop("n_all", "y_all", "n_own", "y_own")
    return df


def filter_urls(urls: DataFrame, labelled: DataFrame, ident: str = "page_id", url: str = "url", rules=RULES, **options) -> DataFrame:
    """Judge every row of ``urls``: (id, host, path, rule, verdict, score).

    ``score`` is the trees' block probability; a rule overrides it."""
    model, stats, rate_all = train(labelled, **options)
    host, path = parts(F.col("u_"))
    judged = urls.select(F.col(ident).alias("id_"), F.col(url).alias("u_")).withColumns({"h_": host, "p_": path})
    rule, says = match(F.col("h_"), F.col("p_"), rules)
    scored = with_suffixes(lexical(judged, "u_", "h_", "p_"), stats, rate_all)
    score = 1.0 / (1.0 + F.exp(-margin(model)))
    return scored.select(
        F.col("id_").alias(ident), F.col("h_").alias("host"), F.col("p_").alias("path"), rule.alias("rule"),
        score.alias("score"), says.alias("says"),
    ).select(ident, "host", "path", "rule",
             F.coalesce("says", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def labelled_by_rules(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """URLs that a rule decides, as training labels (1: block)."""
    host, path = parts(F.col(url))
    _, says = match(F.col("h_"), F.col("p_"), rules)
    return (
        pages.select(F.col(url).alias("url")).withColumns({"h_": host, "p_": path})
        .select("url", F.when(says == "block", 1).when(says == "allow", 0).alias("label")).where(F.col("label").isNotNull())
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, labelled_by_rules(pages))
