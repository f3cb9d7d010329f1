"""Soft-membership mixing of documents to target weights of domains.

A naive Bayes classifier over binned features of a text, counted on the labelled table,
gives each document a posterior over the domains (clean, toxic, junk). Projected
gradient descent then fits a nonnegative rate per document that makes the expected
tokens of each domain, sum of rate x tokens x posterior, match target weight x total:

    minimise sum_d (total_d - w_d)^2 / (2 s_d) + LAMBDA / 2 sum_i t_i (rate_i - 1)^2

with s_d the natural share, in the metric of tokens, where the step 1 / (1 + LAMBDA) is
safe. Documents of equal bins have equal posteriors, hence equal rates all the way, so
the descent runs over one row per pattern of bins: their number is bounded by the bins,
whatever the number of documents, and a hot source or key costs nothing more. All of it
is DataFrame functions; the driver sees class counts and domain totals only.

A rate becomes whole copies: its integer part, and one more for a share of documents
(by hash of doc_id and text) equal to its fraction.

Edge cases: null, empty and wordless texts have no tokens, a posterior and a rate of
their pattern; labels of unknown or null ids are ignored; without labels all domains
are equally likely; null ids are mixed like others, repeated rows get one draw for all; an empty table
gives an empty result; columns of docs are kept as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, named_back, read, renamed, store
from .labelled import bounded

DOMAINS = ["clean", "toxic", "junk"]
#: Target weights of the production query.
WEIGHTS = {"clean": 0.93, "toxic": 0.05, "junk": 0.02}
#: Labelled documents whose words are counted; words that stand for a domain.
MAX_DOCS, WORDS = 6000, 200
LAMBDA, ITERATIONS, TOLERANCE = 1e-3, 60, 1e-5
#: Upper bounds of the bins of each feature; one bin more lies above the last.
BINS = {
    "marks": [0.01, 0.05], "shouts": [0.02], "repeats": [0.2, 0.5, 0.9], "size": [30, 200, 1000],
    "toxic_words": [0, 1, 2, 4], "junk_words": [0, 1, 2, 4],
}
FEATURES = list(BINS)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def _domain() -> Column:
    return F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").otherwise("clean")


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): one domain per labelled document."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).select(
        "doc_id", _domain().alias("domain")
    )


def indicator_words(docs: DataFrame, known: DataFrame) -> dict[str, list[str]]:
    """Words (at most ``WORDS`` a domain) that many more documents of toxic or junk use."""
    parts = [bounded(known.where(F.col("domain") == d), MAX_DOCS // len(DOMAINS)) for d in DOMAINS]
    sample = store(reduce(DataFrame.unionByName, parts), "mix-sample")
    # at most MAX_DOCS ids are broadcast; copies of a text count once
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy(F.xxhash64("text")).agg(
        F.min("domain").alias("domain"), F.first("text").alias("text")
    )
    texts = store(texts, "mix-texts")
    sizes = {r.domain: r["count"] for r in texts.groupBy("domain").count().collect()}
    words = texts.select("domain", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    counts = words.where(F.length("word").between(3, 30)).groupBy("word").pivot("domain", DOMAINS).count().na.fill(0)
    counts = store(counts, "mix-words")
    out = {}
    for d in DOMAINS[1:]:
        own, rest = F.col(d), sum((F.col(x) for x in DOMAINS if x != d), F.lit(0))
        n, m = max(sizes.get(d, 0), 1), max(sum(v for k, v in sizes.items() if k != d), 1)
        p = (own + rest + 1) / (n + m + 2)
        z = (own / n - rest / m) / F.sqrt(p * (1 - p) * (1 / n + 1 / m))
        out[d] = [r.word for r in counts.where(z > 5).orderBy(z.desc(), "word").limit(WORDS).collect()]
    return out


def binned(docs: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """docs with _n_tokens, a _draw (a hash of id and text) and a bin (int from 0) for each
    feature, named _b_<feature>."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    d = docs.select(*own, _words(F.coalesce("text", F.lit(""))).alias("_w"))
    raw = F.coalesce("text", F.lit(""))
    size = F.greatest(F.length(raw), F.lit(1))
    bare = raw
    for c in "#*$%&|":
        bare = F.replace(bare, F.lit(c), F.lit(""))
    listed = lambda d: F.array(*map(F.lit, words[d])) if words[d] else F.array().cast("array<string>")
    n = F.greatest(F.size("_w"), F.lit(1))
    values = {
        "marks": 1 - F.length(bare) / size,
        "shouts": 1 - F.length(F.replace(raw, F.lit("!"), F.lit(""))) / size,
        "repeats": 1 - F.size(F.array_distinct("_w")) / n,
        "size": F.size("_w"),
        "toxic_words": F.size(F.array_intersect("_w", listed("toxic"))),
        "junk_words": F.size(F.array_intersect("_w", listed("junk"))),
    }
    values = [values[f].cast("double").alias(f"_v_{f}") for f in FEATURES]
    draw = F.xxhash64("doc_id", "text", F.lit("copies")).alias("_draw")
    d = d.select(*own, F.size("_w").cast("long").alias("_n_tokens"), draw, *values)
    bins = []
    for f in FEATURES:
        b = F.lit(len(BINS[f]))
        for k, most in reversed(list(enumerate(BINS[f]))):
            b = F.when(F.col(f"_v_{f}") <= most, k).otherwise(b)
        bins.append(b.cast("int").alias(f"_b_{f}"))
    return d.select(*own, "_n_tokens", "_draw", *bins)


KEY = [f"_b_{f}" for f in FEATURES]


def posterior_columns(table: DataFrame, known: DataFrame) -> list[Column]:
    """One column per domain, from the bins, by counts over the labelled rows of table."""
    pairs = table.join(known, "doc_id").select("domain", F.explode(F.array(*(
        F.struct(F.lit(f).alias("f"), F.col(f"_b_{f}").alias("b")) for f in FEATURES
    ))).alias("x")).groupBy("domain", "x.f", "x.b").count().collect()
    counts = {(r.domain, r.f, r.b): r["count"] for r in pairs}  # domains x features x bins at most
    totals = {d: sum(v for (x, f, _), v in counts.items() if x == d and f == FEATURES[0]) for d in DOMAINS}
    scores = []
    for d in DOMAINS:
        score = F.log(F.lit((totals[d] + 1.0) / (sum(totals.values()) + len(DOMAINS))))
        for f in FEATURES:
            n = len(BINS[f]) + 1
            table_of = [F.lit((counts.get((d, f, b), 0) + 0.5) / (totals[d] + 0.5 * n)) for b in range(n)]
            score = score + F.log(F.get(F.array(*table_of), F.col(f"_b_{f}")))
        scores.append(score)
    top = F.greatest(*scores)
    weights = [F.exp(s - top) for s in scores]
    return [(w / sum(weights[1:], weights[0])).alias(f"p_{d}") for d, w in zip(DOMAINS, weights, strict=True)]


def fit_rates(patterns: DataFrame, weights: dict[str, float]) -> DataFrame:
    """patterns (``KEY``, p_*, tokens) with a rate each, by projected gradient descent."""
    goal = [weights[d] / sum(weights.values()) for d in DOMAINS]
    totals = [F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{d}")) for d in DOMAINS]
    table = patterns.withColumn("rate", F.lit(1.0))
    whole = patterns.agg(F.sum("tokens")).first()[0] or 0
    if not whole:
        return table
    step, natural = 1 / (1 + LAMBDA), None
    for k in range(ITERATIONS):
        now = [(x or 0.0) / whole for x in table.agg(*totals).first()]
        natural = natural or [max(x, 1e-9) for x in now]
        errors = [x - g for x, g in zip(now, goal, strict=True)]
        slope = LAMBDA * (F.col("rate") - 1)
        moves = [e / s * F.col(f"p_{d}") for d, e, s in zip(DOMAINS, errors, natural, strict=True)]
        new = F.greatest(F.lit(0.0), F.col("rate") - step * reduce(lambda a, b: a + b, moves, slope))
        if k and max(abs(e - f) for e, f in zip(errors, last, strict=True)) < TOLERANCE:
            break
        last = errors
        table = table.withColumn("rate", new)
        if k % 8 == 7:
            table = cut(table)
    return table


def _rated(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None) -> tuple[DataFrame, DataFrame, DataFrame, Column]:
    """docs (doc_id, text and columns that clash with no name in here) with their bins; ids and
    bins alone, stored; a rate for each pattern of bins; and the number of copies of a row joined to its rate."""
    known = cut(labelled(labels))
    table = binned(docs, indicator_words(docs, known))
    thin = store(table.select("doc_id", "_n_tokens", "_draw", *KEY), "mix-bins")
    posteriors = posterior_columns(thin, known)
    patterns = thin.groupBy(*KEY).agg(F.sum("_n_tokens").alias("tokens")).select(*KEY, "tokens", *posteriors)
    # a row per pattern of bins: no more than the product of the bins
    fitted = F.broadcast(cut(fit_rates(cut(patterns), weights or WEIGHTS)).drop("tokens"))
    share = F.pmod("_draw", F.lit(1_000_000)) / 1_000_000
    copies = (F.floor("rate") + F.when(share < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return table, thin, fitted, copies


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate and copies of every document."""
    _, thin, fitted, copies = _rated(docs.select("doc_id", "text"), labels, weights)
    d = thin.join(fitted, KEY)
    return d.select("doc_id", F.col("_n_tokens").alias("n_tokens"), *(f"p_{x}" for x in DOMAINS), "rate", copies.alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The documents, each as many times as it has copies, with the columns of docs."""
    own, new = renamed(docs, ("doc_id", "text"))
    table, _, fitted, copies = _rated(own, labels, weights)
    d = table.join(fitted, KEY).select(*new, copies.alias("_copies"))
    many = F.when(F.col("_copies") > 0, F.array_repeat(F.lit(1), F.col("_copies")))
    d = d.select(*new, F.explode(many).alias("_one"))
    return d.select(*named_back(d, new, docs.columns))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
