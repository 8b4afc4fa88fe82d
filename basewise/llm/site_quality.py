"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression gives each document its own evidence. It is fitted on labelled documents (good: of quality and not toxic) over ten simple
measures of a text and two log-likelihood ratios of hashed word 1- and 2-grams, good against bad: their mean, and the logarithm of the sum of those under ``HARSH`` alone, which a few telling
words move. The n-grams are counted in one half of the labelled documents and the regression is fitted on the other. Hosts and the paths inside them get posterior means of that evidence:
a path's mean is drawn to its host's, a host's to the corpus', by n / (n + k). Each level's k is estimated
from all documents, as the variance inside sites over the variance between them, so sparse sites fall
back on what stands above them. A document's final log-odds are its own evidence plus
what its site adds to the corpus' prior; its own share in the site is taken out first.

Everything after the fit is grouped aggregation with map-side sums over slim rows. Shares are summed as whole numbers, and what is fitted or
divided is rounded to six digits, so that the order of additions decides nothing. Site tables are broadcast
while they have at most ``BROADCAST_SITES`` rows (checked), else joined by shuffle.

Defined cases: a null text measures as the empty one. A null host or path is a site of its own. Rows
that repeat a doc_id are judged each. Without labels of both classes there is no evidence, every
probability is 0.5, and all is kept. An empty table gives no rows. Only the named columns are read; the
result has doc_id, host and path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality_rules
from .common import bind, staged, words

#: Labelled documents that the classifier is fitted on, at most (about).
TRAINING_LIMIT = 100_000
BUCKETS = 1 << 18
PSEUDO_COUNT = 2.0
#: Weights under this are taken for telling by themselves.
HARSH = -2.0
#: Shares are summed as multiples of 1 / SCALE.
SCALE = 1 << 20
THRESHOLD = 0.5
BROADCAST_SITES = 100_000
#: Bounds of probabilities before log-odds are taken.
FLOOR = 1e-4


def measures(text: Column) -> Column:
    """Ten measures of a text as an array of doubles."""
    t = F.coalesce(text, F.lit(""))
    share = lambda pattern: F.regexp_count(t, F.lit(pattern))

    def of(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        chars = F.greatest(F.length(t), F.lit(1))
        return F.array(
            *(
                x.cast("double")
                for x in (
                    share(r"\p{Lu}") / chars,
                    share(r"[#*$%&|<>]") / chars,
                    (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))) / chars,
                    share(r"[.,;:?]") / chars,
                    share(r"\d") / chars,
                    (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))) / chars,
                    F.length(t) / n / 10,
                    F.log1p(F.length(t)) / 10,
                    F.size(F.array_distinct(w)) / n,
                    F.size(F.array_distinct(F.split(t, "\n"))) / F.size(F.split(t, "\n")),
                )
            )
        )

    return bind(words(text), of)


def training(labels: DataFrame, limit: int = TRAINING_LIMIT) -> DataFrame | None:
    """_id, label (1: of quality and not toxic) and half of the labelled documents, about ``limit`` at most; None if they are not of both classes."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("_id"), ((F.col("quality") == 1) & (toxic != 1)).cast("double").alias("label"))
    known = known.groupBy("_id").agg(F.min("label").alias("label"))
    n, low, high = known.agg(F.count("*"), F.min("label"), F.max("label")).first()
    if not n or low == high:
        return None
    draw = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    return staged(known.where(draw < (1 << 30) * min(limit, n) // n).withColumn("half", draw.bitwiseAND(F.lit(1))), "training")


def gram_weights(docs: DataFrame, known: DataFrame, half: int = 0) -> DataFrame:
    """(bucket, weight): ln of an n-gram's share among good documents over that among bad ones, in multiples of 2**-20, from one half of the labelled documents."""
    marked = docs.select("doc_id", "text").join(F.broadcast(known.where(F.col("half") == half)), F.col("doc_id") == F.col("_id"))
    grams = quality_rules.exploded_buckets(marked.select("label", "text"), F.col("text"), BUCKETS)
    counts = staged(grams.groupBy("bucket").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")), "labelled-grams")
    good, bad = counts.agg(F.sum("good"), F.sum("bad")).first()
    if not good or not bad:
        return staged(quality_rules.every_bucket(counts.select("bucket", F.lit(0).cast("long").alias("weight")), BUCKETS), "labelled-weights")
    ratio = F.log((F.col("good") * (bad / good) + PSEUDO_COUNT) / (F.col("bad") + PSEUDO_COUNT))
    return staged(quality_rules.every_bucket(counts.select("bucket", F.round(ratio * quality_rules.SCALE).cast("long").alias("weight")), BUCKETS), "labelled-weights")


def gram_measures(text: Column, weights: Column, harsh: Column) -> Column:
    """The mean weight of a text's n-grams, and ln(1 - the sum of the harsh ones)."""

    def of(h: Column) -> Column:
        n = F.greatest(2 * F.size(h) - 1, F.lit(1)).cast("double") * quality_rules.SCALE
        return F.array(quality_rules.total_weight(h, weights, BUCKETS) / n, F.log1p(-quality_rules.total_weight(h, harsh, BUCKETS) / quality_rules.SCALE))

    return bind(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def _rounded(x: float) -> float:
    return float(f"{x:.6g}")


def fit(measured: DataFrame, known: DataFrame, half: int = 1) -> tuple[list[float], float] | None:
    """Weights and intercept of the regression over the other half of the labelled documents; None if they are not of both classes."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = measured.join(F.broadcast(known.where(F.col("half") == half)), F.col("doc_id") == F.col("_id")).select(array_to_vector("x").alias("features"), "label")
    if rows.select("label").distinct().count() < 2:
        return None
    model = LogisticRegression(regParam=1e-4, maxIter=100).fit(rows)
    return [_rounded(c) for c in model.coefficients], _rounded(model.intercept)


def _log_odds(p: Column) -> Column:
    bounded = F.greatest(F.lit(FLOOR), F.least(F.lit(1 - FLOOR), p))
    return F.log(bounded / (1 - bounded))


def _shrinkage(inside: float, between: float) -> float:
    """k of n / (n + k): how many documents of its own outweigh what stands above a site."""
    return min(1e9, inside / between) if between > 0 and inside > 0 else (1e9 if between <= 0 else 0.0)


def _variances(n: float, groups: float, total_sq: float, group_sq: float, above_sq: float, n_sq: float, above: float) -> tuple[float, float]:
    """Variance inside groups and between groups below one level, from sums of squares (unbiased)."""
    inside = max(0.0, total_sq - group_sq) / max(1.0, n - groups)
    spread = n - n_sq
    return inside, (max(0.0, group_sq - above_sq) - (groups - above) * inside) / spread if spread > 0 else 0.0


def score_sites(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, host, path, evidence (own log-odds), host_mean and path_mean (posterior means), probability and kept of every row."""
    known = training(labels)
    x = measures(F.col("text"))
    named = docs.select("doc_id", "text", host.cast("string").alias("host"), path.cast("string").alias("path"))
    if known is not None:
        weights = gram_weights(docs, known)
        harsh = weights.select("bucket", F.when(F.col("weight") < HARSH * quality_rules.SCALE, F.col("weight")).otherwise(F.lit(0)).cast("long").alias("weight"))
        # named once each, so that the optimizer folds the subqueries' values into the sums
        named = named.withColumns({"weights": quality_rules.weight_array(weights), "harsh": quality_rules.weight_array(harsh)})
        x = F.concat(x, gram_measures(F.col("text"), F.col("weights"), F.col("harsh")))
    measured = staged(named.select("doc_id", "host", "path", x.alias("x")), "measures")
    model = fit(measured, known) if known is not None else None
    if model is None:
        evidence = F.lit(0.0)
    else:
        evidence = F.lit(model[1])
        for i, c in enumerate(model[0]):
            evidence = evidence + F.col("x")[i] * c
    rows = measured.select("doc_id", "host", "path", evidence.alias("evidence")).withColumn("p", F.round(SCALE / (1 + F.exp(-F.col("evidence")))).cast("long"))
    paths = staged(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum((F.col("p") * F.col("p")).cast("decimal(20,0)")).alias("q")), "paths")
    paths = paths.select("host", "path", "n", (F.col("s") / SCALE).alias("s"), (F.col("q").cast("double") / (SCALE * SCALE)).alias("q"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("path_sq"), F.sum("q").alias("q"), F.count("*").alias("paths"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("n_sq"))
    hosts = staged(hosts, "hosts")
    n, s, q, path_sq, host_sq, n_paths, n_hosts, path_n_sq, host_n_sq = hosts.agg(
        F.sum("hn"), F.sum("hs"), F.sum("q"), F.sum("path_sq"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")), F.sum("paths"), F.count("*"), F.sum("n_sq"), F.sum(F.col("hn") * F.col("hn"))
    ).first()
    if not n:
        mean, k_path, k_host = 0.5, 0.0, 0.0
    else:
        mean = _rounded(s / n)
        k_path = _rounded(_shrinkage(*_variances(n, n_paths, q, path_sq, host_sq, path_n_sq, n_hosts)))
        k_host = _rounded(_shrinkage(*_variances(n, n_hosts, q, host_sq, s * s / n, host_n_sq / n, 1)))
    sites = paths.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n", "s").join(hosts.select(F.col("host").alias("_hh"), "hn", "hs"), F.col("_h").eqNullSafe(F.col("_hh"))).drop("_hh")
    sites = F.broadcast(sites) if (n_paths or 0) <= BROADCAST_SITES else sites
    own = rows.join(sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    # leave the document itself out of its host and path
    safe = lambda num, den: F.when(den > 0, num / F.when(den > 0, den)).otherwise(F.lit(mean))
    p = F.col("p") / SCALE
    host_mean = safe(F.col("hs") - p + k_host * mean, F.col("hn") - 1 + k_host)
    own = own.withColumn("host_mean", host_mean)
    own = own.withColumn("path_mean", safe(F.col("s") - p + k_path * F.col("host_mean"), F.col("n") - 1 + k_path))
    final = F.col("evidence") + _log_odds(F.col("path_mean")) - _log_odds(F.lit(mean))
    own = own.withColumn("probability", 1 / (1 + F.exp(-final)))
    return own.select("doc_id", "host", "path", "evidence", "host_mean", "path_mean", "probability", (F.col("probability") >= threshold).alias("kept"))


def url_site(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a url, as score_sites takes them; null where the url has none."""
    # try_parse_url: odd urls give null rather than an error
    return F.lower(F.try_parse_url(url, F.lit("HOST"))), F.element_at(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), 2)
