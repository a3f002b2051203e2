"""Operator 1, mixing to target weights with soft domain membership.

Domains are good, poor (quality 0) and toxic. A naive Bayes classifier over
hashed words is fitted on a bounded sample of labelled documents: of each domain
the ``per_domain`` labels that come first by a hash of the id. These ids and the
classifier's table, which has a row for each of ``buckets`` buckets, are broadcast;
both sizes are bounded whatever the corpus. The shares of the domains come from all
labels. A document's evidence is the sum over its distinct words, however long it
is. A quarter of the sample is held out of the table; on it a logistic regression
calibrates the evidence against each domain and the number of distinct words, so
neither the length of a text nor its ordinary words drown a few telling ones. Then
projected
least squares finds non-negative rates, one per document, whose expected tokens
by domain meet the targets: rates start at 1, each step is a pass that sums
residuals and the Gram matrix of the rows with positive rates, and a rate is a
fold of all steps, so no rates are written between passes. Only these few sums
reach the driver. Everything else is DataFrame functions.

Null and empty texts have no words: they get the classes' shares as posterior
and keep rate 1. Repeated rows are each a row. Without labels all documents are
good. Conflicting labels count as the worse one. A target that no document can
serve stays unmet; the others are still fitted.
"""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.llm.store import materialise
from mailweave.llm.tables import fresh, row_key

DOMAINS = ["good", "poor", "toxic"]


def _words() -> Column:
    return F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def calibrated(x: np.ndarray, y: np.ndarray, prior: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights (2, 3) of own evidence, distinct words and 1 for poor and toxic against good: penalised logistic regression by Newton steps.

    ``x`` has the evidence for poor and for toxic and the number of distinct words. The penalty pulls to
    plain naive Bayes, which is what stays without held-out labels.
    """
    start = np.array([[1.0, 0.0, prior[1] - prior[0]], [1.0, 0.0, prior[2] - prior[0]]])
    f = [np.stack([x[:, k], x[:, 2], np.ones(len(x))], 1) for k in range(2)]
    pull = np.tile([1.0, 1.0, 0.01], 2)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.stack([np.zeros(len(x)), f[0] @ w[0], f[1] @ w[1]], 1)
        top = z.max(1, keepdims=True)
        total = np.log(np.exp(z - top).sum(1)) + top[:, 0]
        return float((total - z[np.arange(len(x)), y]).sum() + 0.5 * (pull * (w - start).ravel() ** 2).sum()), np.exp(z - total[:, None])

    w = start.copy()
    now, p = loss(w)
    for _ in range(rounds):
        gradient = pull * (w - start).ravel() + np.concatenate([f[k].T @ (p[:, k + 1] - (y == k + 1)) for k in range(2)])
        block = lambda a, b: (f[a] * (p[:, a + 1] * ((a == b) - p[:, b + 1]))[:, None]).T @ f[b]
        step = np.linalg.solve(np.block([[block(0, 0), block(0, 1)], [block(1, 0), block(1, 1)]]) + np.diag(pull), gradient).reshape(2, 3)
        size = 1.0
        while size > 1e-6 and loss(w - size * step)[0] > now:
            size /= 2
        if size <= 1e-6:
            break
        before = now
        w = w - size * step
        now, p = loss(w)
        if before - now < 1e-9 * max(1.0, before):
            break
    return w


def classified(docs: DataFrame, labels: DataFrame, buckets: int = 4096, per_domain: int = 20_000) -> DataFrame:
    """(key, p_good, p_poor, p_toxic) of every distinct row (doc_id, text)."""
    worst = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("t"), F.min(F.coalesce("quality", F.lit(0))).alias("q"))
    domain = worst.select("doc_id", F.when(F.col("t") == 1, 2).when(F.col("q") == 0, 1).otherwise(0).alias("domain"))
    first = F.xxhash64("doc_id", F.lit("sample"))
    sample = reduce(DataFrame.union, (domain.where(F.col("domain") == k).orderBy(first, "doc_id").limit(per_domain) for k in range(3)))
    sample = materialise(sample.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0), "sample")
    bucket = F.pmod(F.xxhash64("w"), F.lit(buckets)).cast("int").alias("bucket")
    distinct = F.array_distinct(_words())
    seen = docs.select("doc_id", "text").join(F.broadcast(sample.where("NOT held")), "doc_id").select("domain", F.explode(distinct).alias("w")).groupBy("domain", bucket).agg(F.count("*").alias("n"))
    counts = np.full((3, buckets), 0.5)
    share = np.ones(3)
    for r in seen.collect():  # at most 3 * buckets rows
        counts[r["domain"], r["bucket"]] += r["n"]
    for r in domain.groupBy("domain").count().collect():
        share[r["domain"]] += r["count"]
    logp, prior = np.log(counts / counts.sum(1, keepdims=True)), np.log(share / share.sum())
    table = docs.sparkSession.createDataFrame([(k, float(logp[1, k] - logp[0, k]), float(logp[2, k] - logp[0, k])) for k in range(buckets)], "bucket int, l1 double, l2 double")

    def evidence(rows: DataFrame, *by: str) -> DataFrame:
        """The evidence for poor and toxic and the number of distinct words; repeated rows add up, so sums are shared by their number."""
        words = rows.select(*by, F.posexplode_outer(distinct).alias("pos", "w")).select(*by, "pos", bucket)
        # Rows of one document come together, so the partial sums leave one row per document and task.
        sums = words.join(F.broadcast(table), "bucket").groupBy(*by).agg(F.count("pos").alias("n"), F.sum((F.col("pos") == 0).cast("int")).alias("rows"), *(F.sum(F.when(F.col("pos").isNotNull(), F.col(f"l{i}"))).alias(f"s{i}") for i in (1, 2)))
        return sums.select(*by, *(F.coalesce(F.col(x) / F.col("rows"), F.lit(0.0)).alias(x) for x in ("s1", "s2", "n")))

    keyed = docs.select("doc_id", row_key().alias("key"), "text")
    held = evidence(keyed.join(F.broadcast(sample.where("held")), "doc_id"), "key", "domain").where("n > 0")
    # At most 3 * per_domain labels are held; sorted, as sums of floats depend on the order.
    found = np.array(sorted((r["s1"], r["s2"], r["n"], r["domain"]) for r in held.collect()), float).reshape(-1, 4)
    w = calibrated(found[:, :3], found[:, 3].astype(int), prior)
    some = F.col("n") > 0
    z = [F.lit(0.0), *(F.when(some, F.col(f"s{k + 1}") * float(w[k, 0]) + F.col("n") * float(w[k, 1]) + float(w[k, 2])).otherwise(float(prior[k + 1] - prior[0])) for k in range(2))]
    scored = evidence(keyed, "key").select("key", *(x.alias(f"z{i}") for i, x in enumerate(z)))
    top = F.greatest("z0", "z1", "z2")
    each = [F.exp(F.col(f"z{i}") - top) for i in range(3)]
    total = each[0] + each[1] + each[2]
    return scored.select("key", *((each[i] / total).alias(f"p_{d}") for i, d in enumerate(DOMAINS)))


def _rate(steps: list[np.ndarray]) -> Column:
    r = F.lit(1.0)
    for v in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.col(f"p_{d}") * float(x) for d, x in zip(DOMAINS, v, strict=True)), F.lit(0.0)))
    return F.when(F.col("n_words") > 0, r).otherwise(1.0)


def solve(table: DataFrame, targets: dict[str, float], epochs: float | None = 1.0, rounds: int = 20, tolerance: float = 1e-4) -> list[np.ndarray]:
    """The steps that lead from rates of 1 to the fitted rates; without ``epochs``, targets are factors of the domains' tokens."""
    aim = np.array([targets[d] for d in DOMAINS], float)
    wanted = None if epochs is None else aim / aim.sum() * epochs
    p = [F.col(f"p_{d}") for d in DOMAINS]
    steps: list[np.ndarray] = []
    best, kept, size = np.inf, 0, 1.0
    for _ in range(rounds):
        now = table.select("n_words", *(f"p_{d}" for d in DOMAINS), _rate(steps).alias("r"))
        active = F.col("n_words") * (F.col("r") > 0).cast("int")
        row = now.agg(F.sum("n_words"), *(F.sum(F.col("n_words") * F.col("r") * x) for x in p), *(F.sum(active * x * y) for x in p for y in p)).first()
        if not row[0]:
            return []
        got, gram = np.array(row[1:4], float) / row[0], np.array(row[4:], float).reshape(3, 3) / row[0]
        wanted = got * aim if wanted is None else wanted
        left = got - wanted
        worst = float(np.abs(left).max())
        if worst < tolerance:
            return steps
        if worst < best:
            best, kept = worst, len(steps)
        else:  # the step was too long: go back and take half
            steps, size = steps[:kept] if len(steps) > kept else steps, size / 2
        steps = steps + [size * np.linalg.solve(gram + 1e-9 * np.eye(3), left)]
    # Rates cannot be negative, so not every target can be met.
    warnings.warn(f"mixing stays within {best:.2g} of its targets, as shares of all tokens", stacklevel=2)
    return steps[:kept]


def fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float], epochs: float | None) -> DataFrame:
    """Every row's doc_id, key, n_words and posteriors, its rate, and copies: the rate with its fraction met by a hash."""
    rows = docs.select("doc_id", row_key().alias("key"), F.size(_words()).cast("long").alias("n_words"))
    table = materialise(rows.join(classified(docs, labels), "key"), "posteriors")
    luck = F.pmod(F.xxhash64("key", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return table.withColumn("rate", _rate(solve(table, targets, epochs))).withColumn("copies", F.floor(F.col("rate") + luck).cast("long"))


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], epochs: float | None = 1.0) -> DataFrame:
    """One row per document: doc_id, n_words, posteriors p_good, p_poor, p_toxic, rate, copies."""
    return fitted(docs, labels, targets, epochs).drop("key")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], epochs: float | None = 1.0) -> DataFrame:
    """The documents with all their columns, each as often as its rate says."""
    key, copies, copy = fresh(docs, "mix_key"), fresh(docs, "mix_copies"), fresh(docs, "mix_copy")
    often = fitted(docs, labels, targets, epochs).groupBy(F.col("key").alias(key)).agg(F.any_value("copies").cast("int").alias(copies))
    named = docs.withColumn(key, row_key()).join(often, key).where(F.col(copies) > 0)
    return named.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(F.col(f"`{c}`") for c in docs.columns))
