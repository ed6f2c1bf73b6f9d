"""Mixtures over retrieved passages: long rows (grp, branch, step, logp) with a log prior for each branch.

All windows partition by group and branch or by group and step, both bounded by a request's branches and steps.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base import let
from ..sources.folders import stored

#: Words of the samples whose n-grams one task counts, whole questions.
WORDS = 1 << 17


def _logsumexp_over(x: Column, w) -> Column:
    m = F.max(x).over(w)
    return m + F.ln(F.sum(F.exp(x - m)).over(w))


def log_prior(rows: DataFrame, mode: str = "log_softmax", *, logit: str = "prior_logit") -> DataFrame:
    """Adds log_prior: the branches' log shares at each step; uniform gives 0.0."""
    w = Window.partitionBy("grp", "step")
    if mode == "uniform":
        return rows.withColumn("log_prior", F.lit(0.0))
    return rows.withColumn("log_prior", F.col(logit) - _logsumexp_over(F.col(logit), w) if mode == "log_softmax" else F.col(logit))


def posterior(rows: DataFrame) -> DataFrame:
    """Adds prefix (log-likelihood of the branch's earlier tokens) and log_posterior (prefix and prior, normalised over branches)."""
    before = Window.partitionBy("grp", "branch").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    scored = rows.withColumn("prefix", F.coalesce(F.sum("logp").over(before), F.lit(0.0))).withColumn("__s", F.col("prefix") + F.col("log_prior"))
    return scored.withColumn("log_posterior", F.col("__s") - _logsumexp_over(F.col("__s"), Window.partitionBy("grp", "step"))).drop("__s")


def token_marginals(rows: DataFrame) -> DataFrame:
    """grp, step, marginal: the token's log-probability under the mixture."""
    x = F.col("logp") + F.col("log_posterior")
    peaked = rows.withColumn("__x", x).groupBy("grp", "step").agg(F.max("__x").alias("__m"), F.collect_list("__x").alias("__xs"))
    total = F.aggregate(F.array_sort("__xs"), F.lit(0.0), lambda a, v: a + F.exp(v - F.col("__m")))
    return peaked.select("grp", "step", (F.col("__m") + F.ln(total)).alias("marginal"))


def loss(rows: DataFrame) -> DataFrame:
    """grp, loss: minus the sum of its tokens' marginals."""
    return token_marginals(posterior(rows)).groupBy("grp").agg((-F.sum("marginal")).alias("loss"))


def perplexity(rows: DataFrame, by: str, logp: str) -> DataFrame:
    """exp of the mean negative log-likelihood for each row's tokens; masked tokens are null."""
    return rows.groupBy(by).agg(F.exp(-F.avg(logp)).alias("perplexity"))


def token_accuracy(predictions: Column, labels: Column, ignore: int = -100) -> Column:
    """Share of labels met by the prediction one place before; ignored labels left out; null if there are none."""
    pairs = F.arrays_zip(F.slice(predictions, 1, F.greatest(F.size(predictions) - 1, F.lit(0))).alias("p"), F.slice(labels, 2, F.greatest(F.size(labels), F.lit(1))).alias("y"))

    def rate(xs: Column) -> Column:
        return F.try_divide(F.size(F.filter(xs, lambda x: x["p"] == x["y"])), F.size(xs))

    return let(F.filter(pairs, lambda x: x["y"] != ignore), rate)


def minimum_risk(candidates: DataFrame, question: str, candidate: str, similarity) -> DataFrame:
    """The candidate of each question most like the others on average; means that agree to nine digits tie, and the first sample wins.
    Candidates a question are the few samples of one prompt."""
    a = candidates.select(question, F.col(candidate).alias("__a"), F.col("sample").alias("__i"))
    b = candidates.select(question, F.col(candidate).alias("__b"), F.col("sample").alias("__j"))
    met = a.join(b, question).where("__i != __j").groupBy(question, "__a", "__i").agg(F.avg(similarity(F.col("__a"), F.col("__b"))).alias("__s"))
    return met.groupBy(question).agg(F.max_by("__a", F.struct(F.round("__s", 9), -F.col("__i"))).alias(candidate), F.max("__s").alias("mean_similarity"))


def minimum_risk_bleu(candidates: DataFrame, question: str, sample: str, text: str, *, order: int = 4) -> DataFrame:
    """question, sample and bleu: of each question's samples the one with the best BLEU against all the others as references, each a
    segment of its own; scores that agree to nine digits tie, and the least sample wins. A sample that is alone has 0.

    Words are what white space parts, in small letters; matches of n-grams above one word are counted from one. The sums of the clipped
    counts, which are minima over all pairs of samples, come from how many samples hold an n-gram how often: no pairs are made, and a
    question may have any number of samples. n-grams are many times the size of the texts, so the texts are shuffled, by question, and a task
    of WORDS words or so makes its n-grams where they are summed. A question of more words has its n-grams counted into a table and shuffled.
    All joins are shuffled: sizes are guessed from the texts', by which n-grams would be broadcast.
    """
    rows = candidates.select(F.col(question).alias("__q"), F.col(sample).alias("__i"), F.col(text).alias("__t"))
    words = F.filter(F.split(F.lower(F.coalesce("__t", F.lit(""))), r"\s+", -1), lambda w: w != "")
    orders = range(1, order + 1)

    def grams(n: int) -> Column:
        whole = F.transform(F.sequence(F.lit(1), F.size("__w") - n + 1), lambda at: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("__w", at, n), " ").alias("g")))
        return F.when(F.size("__w") >= n, whole).otherwise(F.array().cast("array<struct<n:int,g:string>>"))

    def counted(rows: DataFrame) -> DataFrame:
        rows = rows.select("__q", "__i", words.alias("__w"))
        return rows.select("__q", "__i", F.explode(F.concat(*map(grams, orders))).alias("x")).groupBy("__q", "__i", "x.n", "x.g").agg(F.count(F.lit(1)).alias("c"))

    def summed(minima: DataFrame) -> DataFrame:
        return minima.groupBy("__q", "__i").agg(*[F.sum(F.when(F.col("n") == n, F.col("m"))).alias(f"m{n}") for n in orders])

    sizes = stored(rows.groupBy("__q").agg(F.count(F.lit(1)).alias("k"), F.sum(F.size(words)).alias("all")), "sizes")
    most, total = sizes.agg(F.coalesce(F.max("all"), F.lit(0)), F.coalesce(F.sum("all"), F.lit(0))).first()
    large = sizes.where(F.col("all") > WORDS).select("__q").hint("merge")
    small = rows.join(large, "__q", "left_anti") if most > WORDS else rows
    upto = Window.partitionBy("__q", "n", "g").orderBy("c")
    every = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    more = F.count(F.lit(1)).over(every) - F.count(F.lit(1)).over(upto)
    shared = summed(counted(small.repartition(ceil((total + 1) / WORDS), "__q")).withColumn("m", F.sum("c").over(upto) + F.col("c") * more - F.col("c")))
    if most > WORDS:
        counts = stored(counted(rows.join(large, "__q", "left_semi")), "grams")
        held = counts.groupBy("__q", "n", "g", "c").agg(F.count(F.lit(1)).alias("k"))  # a row for each different count
        more = F.sum("k").over(every) - F.sum("k").over(upto)
        minima = held.select("__q", "n", "g", "c", (F.sum(F.col("c") * F.col("k")).over(upto) + F.col("c") * more - F.col("c")).alias("m"))
        shared = shared.unionByName(summed(counts.join(minima.hint("merge"), ["__q", "n", "g", "c"])))
    both = rows.select("__q", "__i", F.size(words).alias("len")).join(sizes.hint("merge"), "__q").join(shared.hint("merge"), ["__q", "__i"], "left")
    others = F.col("k") - 1

    def log_precision(n: int) -> Column:
        one = int(n > 1)
        return F.ln((F.coalesce(f"m{n}", F.lit(0)) + one) / (others * F.greatest(F.col("len") - n + 1, F.lit(0)) + one))

    mean = sum((log_precision(n) for n in range(1, order + 1)), F.lit(0.0)) / order
    references = F.col("all") - F.col("len")
    brevity = F.least(F.lit(1.0), F.exp(1 - references / (others * F.col("len"))))
    score = F.when((F.coalesce("m1", F.lit(0)) > 0), brevity * F.exp(mean)).otherwise(F.lit(0.0))
    scored = both.select("__q", "__i", score.alias("bleu"))
    best = scored.groupBy("__q").agg(F.min(F.struct((-F.round("bleu", 9)).alias("r"), F.col("__i").alias("i"), "bleu")).alias("b"))
    return best.select(F.col("__q").alias(question), F.col("b.i").alias(sample), F.col("b.bleu").alias("bleu"))


def length_normalized(logps: Column) -> Column:
    return F.aggregate(logps, F.lit(0.0), lambda a, x: a + x) / F.size(logps)


def token_logprobs(text: Column) -> Column:
    """Log-probabilities of tokens from JSON: a list of numbers, of objects with a logprob, or of maps from a token to such an object."""
    numbers = F.from_json(text, "array<double>")
    objects = F.transform(F.from_json(text, "array<struct<logprob:double>>"), lambda x: x["logprob"])
    maps = F.transform(F.from_json(text, "array<map<string,struct<logprob:double>>>"), lambda m: F.get(F.map_values(m), 0)["logprob"])
    return F.when(F.regexp_like(text, F.lit(r'^\s*\[\s*\{\s*"logprob"')), objects).when(F.regexp_like(text, F.lit(r"^\s*\[\s*\{")), maps).otherwise(numbers)


def continuation_logprob(logps: Column, given: Column) -> Column:
    """A given cumulative log-probability, or the sum of the tokens'."""
    return F.coalesce(given, F.aggregate(logps, F.lit(0.0), lambda a, x: a + x))
