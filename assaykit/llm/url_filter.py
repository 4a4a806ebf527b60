"""URL filter: rules, and gradient-boosted trees on lexical features for what no rule covers."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import lower_ascii, pick
from assaykit.operators.joins import HOT_SHARE
from assaykit.session import materialize

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Words of host names that label a URL as bad for training. They are no features themselves.
SEED_TERMS = ("casino", "pills", "spam", "viagra", "lottery", "xxx", "porn", "betting", "replica", "warez")
MOST_BROADCAST = 100_000  # suffixes
MOST_PER_LABEL = 5_000  # labelled URLs of each kind that the trees are fitted on
FEATURES = [
    "f_length", "f_host_length", "f_path_length", "f_labels", "f_depth", "f_digits", "f_host_digits", "f_hyphens", "f_entropy", "f_params",
    "f_longest_label", "f_suffix_rate", "f_suffix_count",
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url and for one without ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return lower_ascii(part(1)), part(2)


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict); null if none fits."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    n_host, query = F.length(host), F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    chars = F.split(host, "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)).cast("double"))
    weighted = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * F.log2(c))
    entropy = F.when(n_host > 0, F.log2(n_host.cast("double")) - weighted / n_host).otherwise(0.0)
    share = lambda text, n: F.when(n > 0, (n - F.length(F.translate(text, "0123456789", ""))) / n).otherwise(0.0)
    labels = F.split(host, r"\.")
    return {
        "f_length": F.length(F.coalesce(url, F.lit(""))),
        "f_host_length": n_host,
        "f_path_length": F.length(path),
        "f_labels": F.size(labels),
        "f_depth": F.length(path) - F.length(F.translate(path, "/", "")),
        "f_digits": share(F.coalesce(url, F.lit("")), F.length(F.coalesce(url, F.lit("")))),
        "f_host_digits": share(host, n_host),
        "f_hyphens": n_host - F.length(F.translate(host, "-", "")),
        "f_entropy": entropy,
        "f_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "f_longest_label": F.array_max(F.transform(labels, F.length)),
    }


def _with_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """``rows`` with s_rate and s_count; if there are many suffixes the frequent ones don't take part in the shuffle."""
    same = _suffix(F.col("host")) == F.col("s_suffix")
    n, total = stats.agg(F.count("*"), F.sum("s_count")).first()
    if n <= MOST_BROADCAST:
        return rows.join(F.broadcast(stats), same, "left")
    hot = F.broadcast(stats.where(F.col("s_count") > total * HOT_SHARE))
    return rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(stats.hint("shuffle_merge"), same, "left"))


def _with_features(rows: DataFrame, suffixes: DataFrame, prior: float) -> DataFrame:
    """``rows`` (url, host, path, ...) with the features; a suffix never labelled gets the prior."""
    joined = _with_stats(rows, suffixes.select(F.col("suffix").alias("s_suffix"), "s_rate", "s_count"))
    own = {k: v.cast("double") for k, v in _lexical(F.col("url"), F.col("host"), F.col("path")).items()}
    own |= {"f_suffix_rate": F.coalesce("s_rate", F.lit(prior)), "f_suffix_count": F.log1p(F.coalesce("s_count", F.lit(0))).cast("double")}
    return joined.withColumns(own).drop("s_suffix", "s_rate", "s_count")


class UrlModel:
    """Fitted trees with the suffix statistics of all labelled rows. ``trees`` is None without both labels."""

    def __init__(self, trees: PipelineModel | None, suffixes: DataFrame, prior: float):
        self.trees, self.suffixes, self.prior = trees, suffixes, prior

    def bad(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``bad``: whether the trees call the url bad; never, if there was nothing to learn."""
        if self.trees is None:
            return rows.withColumn("bad", F.lit(False))
        keep = [F.col(c) for c in rows.columns]
        return self.trees.transform(_with_features(rows, self.suffixes, self.prior)).select(*keep, (F.col("prediction") > 0.5).alias("bad"))


def train(labelled: DataFrame, most: int = MOST_PER_LABEL, seed: int = 17) -> UrlModel:
    """Fit on (url, label) with label 1 for bad, on at most ``most`` different urls of each label by hash order.

    The urls of a label weigh as much together as all different urls of that label in the table.
    """
    host, path = host_and_path(F.col("url"))
    rows = pick(labelled, "url", "label").where("url is not null and label in (0, 1)").select("url", F.col("label").cast("int").alias("label"))
    # equal urls count once, so that no repeated url fills a sample
    urls = rows.groupBy("url", "label").agg(F.count("*").alias("n"))
    urls = materialize(urls.select("url", host.alias("host"), path.alias("path"), "label", "n"), "urls")
    full = {r.label: r.n for r in urls.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("url"), F.col("url")]
    weight = F.when(F.col("label") == 1, full.get(1, 0) / max(1, min(most, full.get(1, 0)))).otherwise(full.get(0, 0) / max(1, min(most, full.get(0, 0))))
    picked = urls.where("label = 1").orderBy(*order).limit(most).unionByName(urls.where("label = 0").orderBy(*order).limit(most))
    picked = materialize(picked.withColumn("weight", weight), "labelled")
    n, n_bad = urls.agg(F.sum("n"), F.sum(F.col("n") * F.col("label"))).first()
    prior = (n_bad or 0) / n if n else 0.0
    # counted over all labelled rows; rates are drawn to the prior by ten rows
    suffixes = urls.groupBy(_suffix(F.col("host")).alias("suffix")).agg(F.sum("n").alias("s_count"), F.sum(F.col("n") * F.col("label")).alias("s_bad"))
    suffixes = materialize(suffixes.select("suffix", "s_count", ((F.col("s_bad") + 10 * prior) / (F.col("s_count") + 10)).alias("s_rate")), "suffixes")
    if not n_bad or n_bad == n:
        return UrlModel(None, suffixes, prior)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=10, maxDepth=4, stepSize=0.3, seed=seed)
    ready = assembler.transform(_with_features(picked, suffixes, prior)).select("features", "label", "weight")
    return UrlModel(PipelineModel([assembler, gbt.fit(ready)]), suffixes, prior)


def seed_labels(urls: DataFrame, terms: tuple[str, ...] = SEED_TERMS) -> DataFrame:
    """(url, label): bad if a term of the list stands in the host, good otherwise."""
    host, _ = host_and_path(F.col("url"))
    rows = pick(urls, "url").where("url is not null")
    return rows.select("url", host.rlike("|".join(terms)).cast("int").alias("label"))


def judge_urls(pages: DataFrame, model: UrlModel, rules: tuple = RULES) -> DataFrame:
    """Per row: page_id, host, path, rule and verdict (allow or block).

    The longest fitting rule decides; without one the trees do. A null url, or one without ``://``,
    has an empty host and path, fits no rule, and is judged by the trees on the features of an empty
    host. Repeated rows repeat; an empty table gives an empty table.
    """
    host, path = host_and_path(F.col("url"))
    rows = pick(pages, "page_id", "url").withColumns({"host": host, "path": path})
    rows = rows.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    judged = model.bad(rows)
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"),
    )
