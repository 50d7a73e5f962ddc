"""Mixing to target weights with soft membership.

1. A classifier (hashed words, multinomial logistic regression) is fitted on a
   bounded sample of the labelled documents: at most ``per_domain`` of each
   domain, those whose id hashes lowest, weighted back to the domain's share.
2. It gives every document a posterior over the domains. A document counts
   towards a domain's token total with its tokens times the posterior.
3. Rates r >= 0 (and <= ``max_rate``, if given) for all documents minimise
   sum_k (G_k - T_k)^2 / S_k, where G_k = sum_d r_d t_d p_dk is the expected
   token total of domain k, T_k its target and S_k = G_k at r = 1. Projected
   gradient descent from r = 1, in the metric that weighs a document by its
   tokens: r_d <- clip(r_d - sum_k p_dk e_k) with e_k = l (G_k - T_k) / S_k. The
   step length l = 1 is safe, as the scaled Hessian has no eigenvalue above 1;
   each step tries all of ``lengths`` in one pass and takes the best. Once there are
   rates inside their bounds, e = c H^-1 (G - T) is tried too, for each c of
   ``curved``: the gradient in the metric of H = sum of t p p' over those, a K x K matrix
   that the pass sums up beside G.
4. A document's rate follows from its posterior and the errors e of the steps
   so far, a table of steps times domains. So nothing but the posteriors is
   stored, each step is one aggregation of K sums, and a lost executor costs
   nothing but its tasks.
5. A rate becomes copies by rounding up with the probability of its fraction,
   drawn from a hash of the document.

Targets: weights over the domains relative to the ``anchor`` domain, which is
kept whole where it can be; a domain that has fewer tokens than its target asks for keeps
all it has. Posteriors are soft, so rates up to ``max_rate`` may be unable to reach such
totals: a document that is clean with 0.9 brings tokens of the other domains along.
All targets are then scaled by the largest common factor that some rates do reach
(less ``slack``), which keeps the proportions between the domains. That factor is the least
value, over multipliers u with u T = 1, of sum_d max_rate t_d max(0, u p_d) (the support of
all reachable totals); it is convex in u and found by grids of multipliers,
a pass each. The fit ends where every total is within ``tolerance`` of its target,
and warns where ``steps`` end it before. Labels: toxic -> toxic, else quality 0 -> junk, else clean. A document
with several labels takes the worst.

Null and empty texts have no tokens and the posterior that the classifier
gives to no words. Null ids are never labelled. With fewer than two labelled
domains every document is ``clean``. Repeated rows are documents like any
other; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field as default

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwise.llm.common import field, map_arrow, with_place, without_places, write_table

DOMAINS = ("clean", "junk", "toxic")


@dataclass(frozen=True)
class Mix:
    #: weight of each domain against the anchor's
    weights: dict[str, float] = default(default_factory=lambda: {"clean": 0.96, "junk": 0.02, "toxic": 0.02})
    anchor: str = "clean"
    max_rate: float | None = 1.0
    features: int = 1 << 14
    per_domain: int = 8000
    steps: int = 60
    lengths: tuple[float, ...] = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)
    curved: tuple[float, ...] = (0.5, 1.0)
    #: largest distance of a total from its target, as a share of the target
    tolerance: float = 5e-4
    #: how far below the largest reachable scale the targets are set
    slack: float = 0.02


def words_of(text: Column) -> Column:
    """Lower-case words without surrounding punctuation, blanks apart."""
    return F.filter(
        F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\s\\p{Punct}]+"), lambda w: w != ""
    )


def token_count(text: Column) -> Column:
    """Words between blanks."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " "))).cast("long")


def labelled(labels: DataFrame) -> DataFrame:
    """(l_id, domain): one row per labelled id."""
    quality, toxic = field(labels, "quality", "int"), field(labels, "toxic", "int")
    return (
        labels.select(field(labels, "doc_id", "long"), quality, toxic)
        .dropna()
        .groupBy(F.col("doc_id").alias("l_id"))
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .select("l_id", F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).alias("domain"))
    )


class Classifier:
    """Posterior over DOMAINS from a text column."""

    def __init__(self, docs: DataFrame, labels: DataFrame, mix: Mix):
        self.tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=mix.features, binary=True)
        known = write_table(labelled(labels), "labelled")
        counts = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.domains = sorted(counts)
        self.model = None
        if len(counts) < 2:
            return
        parts = [
            known.filter(F.col("domain") == d)
            .orderBy(F.xxhash64("l_id"), "l_id")
            .limit(mix.per_domain)
            .withColumn("weight", F.lit(max(1.0, n / mix.per_domain)))
            for d, n in counts.items()
        ]
        sample = parts[0]
        for p in parts[1:]:
            sample = sample.union(p)
        # at most per_domain rows a domain, so a broadcast of bounded size
        taken = docs.select(field(docs, "doc_id", "long"), field(docs, "text", "string")).join(
            F.broadcast(sample), F.col("doc_id") == F.col("l_id")
        )
        rows = taken.select("weight", "domain", words_of(F.col("text")).alias("_words"))
        fit = write_table(self.tf.transform(rows).select("_tf", "weight", F.col("domain").cast("double").alias("label")), "fit")
        if fit.isEmpty():
            return
        self.model = LogisticRegression(
            featuresCol="_tf", labelCol="label", weightCol="weight", probabilityCol="_p", rawPredictionCol="_raw",
            predictionCol="_guess", family="multinomial", maxIter=25, regParam=1e-3, standardization=False,
        ).fit(fit)

    def transform(self, docs: DataFrame, keep: list) -> DataFrame:
        """``keep`` columns of ``docs`` plus ``_posterior``, an array of len(DOMAINS)."""
        if self.model is None:
            return docs.select(*keep, F.array(*[F.lit(float(d == "clean")) for d in DOMAINS]).alias("_posterior"))
        text = docs.select(*keep, words_of(field(docs, "text", "string")).alias("_words"))
        names = [c for c in text.columns if c != "_words"]
        found = self.model.transform(self.tf.transform(text))
        p = vector_to_array("_p")
        # classes are numbered by domain; the model has as many as its largest
        width = self.model.numClasses
        of = [p[d] if d < width else F.lit(0.0) for d in range(len(DOMAINS))]
        return found.select(*names, F.array(*of).alias("_posterior"))


def _replayed(p: np.ndarray, errors: np.ndarray, max_rate: float | None) -> np.ndarray:
    """Rates after the steps in ``errors`` (steps, domains)."""
    rate = np.ones(len(p))
    for e in errors:
        rate = np.clip(rate - p @ e, 0.0, max_rate)
    return rate


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    p = batch.column("_posterior").flatten().to_numpy().reshape(batch.num_rows, len(DOMAINS))
    return p, batch.column("_tokens").to_numpy().astype(np.float64)


def _summed(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sums over all rows of ``of(posteriors, tokens)``, ``size`` numbers a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                sums += of(*_columns(batch))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(sums)], names=["k", "g"])

    found = map_arrow(rows.select("_tokens", "_posterior"), run, "k long, g double").groupBy("k").agg(F.sum("g").alias("g"))
    out = np.zeros(size)
    for r in found.collect():
        out[r["k"]] = r["g"]
    return out


def largest_scale(rows: DataFrame, target: np.ndarray, max_rate: float, width: float = 1e-3) -> float:
    """The largest factor of ``target`` that rates up to ``max_rate`` reach,
    searched among multipliers to within ``width``; 1 at most."""
    free = np.flatnonzero(target > 0)  # a domain without a target sets no limit
    if len(free) < 2:
        return 1.0
    axes = np.meshgrid(*[np.linspace(-1, 1, 5)] * (len(free) - 1), indexing="ij")
    around = np.stack([a.ravel() for a in axes], axis=1)
    centre, radius, least = np.full(len(free) - 1, 1 / len(free)), 2.0, np.inf
    for _ in range(60):
        shares = centre + radius * around  # u_k T_k of all free domains but the last
        u = np.zeros((len(shares), len(target)))
        u[:, free] = np.column_stack([shares, 1 - shares.sum(axis=1)]) / target[free]
        found = _summed(rows, lambda p, t, u=u: t @ np.maximum(p @ u.T, 0.0), len(u)) * max_rate
        best = int(np.argmin(found))
        gained, least = least - found[best], min(least, found[best])
        centre = shares[best]
        if np.abs(around[best]).max() < 1:  # inside the grid: look closer
            if gained <= width * least and radius < 0.05:
                break
            radius /= 2
    return float(min(1.0, least))


def fit_rates(rows: DataFrame, mix: Mix) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Errors of all steps, and what came of them: supply, target (scaled), scale, reached,
    and residual, the share of tokens that a further step of length 1 would move.

    ``rows`` (a written table) has ``_tokens`` and ``_posterior``.
    """
    k = len(DOMAINS)

    def totals(errors: np.ndarray, trials: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """After the steps ``errors`` and each one of ``trials`` as the last: G, and H of
        the rates inside their bounds; and the tokens that the first trial moves."""
        most = np.inf if mix.max_rate is None else mix.max_rate

        def sums(p: np.ndarray, t: np.ndarray) -> np.ndarray:
            rate, out = _replayed(p, errors, mix.max_rate), []
            for i, e in enumerate(trials):
                after = np.clip(rate - p @ e, 0.0, mix.max_rate)
                inside = p[(after > 0) & (after < most)]
                weighed = inside * t[(after > 0) & (after < most), None]
                out += [(after * t) @ p, (weighed.T @ inside).ravel()]
                moves = np.abs(after - rate) @ t if i == 0 else moves
            return np.concatenate([*out, [moves]])

        found = _summed(rows, sums, len(trials) * (k + k * k) + 1)
        each = found[:-1].reshape(len(trials), k + k * k)
        return each[:, :k], each[:, k:].reshape(-1, k, k), found[-1]

    errors = np.zeros((0, k))
    tried, bent, _ = totals(errors, np.zeros((1, k)))
    supply, reached, curve = tried[0], tried[0], bent[0]
    weight = np.array([mix.weights.get(d, 0.0) for d in DOMAINS])
    anchor = DOMAINS.index(mix.anchor)
    target = np.minimum(supply, supply[anchor] * weight / weight[anchor])
    most = 1.0 if mix.max_rate is None else largest_scale(rows, target, mix.max_rate)
    factor = most if most >= 1 else most * (1 - mix.slack)
    target = target * factor
    scale = np.maximum(supply, 1e-9)
    near = mix.tolerance * np.where(target > 0, target, max(1.0, target.sum()))

    def loss(reached: np.ndarray) -> np.ndarray:
        return ((reached - target) ** 2 / scale).sum(axis=-1)

    moved = 0.0
    for _ in range(mix.steps):
        if (np.abs(reached - target) <= near).all():
            break
        trials = np.outer(mix.lengths, (reached - target) / scale)
        if mix.curved and np.linalg.matrix_rank(curve, hermitian=True) == k:
            trials = np.vstack([trials, np.outer(mix.curved, np.linalg.solve(curve, reached - target))])
        tried, bent, moved = totals(errors, trials)
        best = int(np.argmin(loss(tried)))
        if loss(tried[best]) >= loss(reached):
            break  # no step in its length's range gains: the nearest that rates come
        errors, reached, curve = np.vstack([errors, trials[best]]), tried[best], bent[best]
    residual = moved / max(1.0, supply.sum())
    if (np.abs(reached - target) > near).any():
        apart = ", ".join(f"{d} {g / max(t, 1e-9):.4f}" for d, g, t in zip(DOMAINS, reached, target))
        warnings.warn(f"mixing ended {len(errors)} steps from its targets: {apart} of them; residual {residual:.2e}", stacklevel=2)
    return errors, {"supply": supply, "target": target, "scale": factor, "reached": reached, "residual": residual}


def rated(rows: DataFrame, errors: np.ndarray, max_rate: float | None) -> DataFrame:
    """``rows`` plus ``_rate``; ``_posterior`` and ``_tokens`` stay."""
    schema = rows.withColumn("_rate", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("_posterior").flatten().to_numpy().reshape(batch.num_rows, len(DOMAINS))
            rate = _replayed(p, errors, max_rate)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=[*batch.schema.names, "_rate"])

    return map_arrow(rows, run, schema)


def copies(rate: Column, *key: Column) -> Column:
    """The rate rounded up with the probability of its fraction, by a hash of ``key``."""
    u = F.shiftrightunsigned(F.xxhash64(*key, F.lit("copies")), 11).cast("double") / F.lit(float(1 << 53))
    return F.floor(rate + u).cast("long")


def _prepared(docs: DataFrame, labels: DataFrame, mix: Mix, keep: list) -> DataFrame:
    text = field(docs, "text", "string")
    key = F.xxhash64(field(docs, "doc_id", "long"), text).alias("_key")
    model = Classifier(docs, labels, mix)
    return write_table(model.transform(docs, [*keep, token_count(text).alias("_tokens"), key]), "posteriors")


def mix_documents(docs: DataFrame, labels: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """A row per document: doc_id, tokens, the posterior of each domain, its
    rate and its copies."""
    rows = _prepared(docs, labels, mix, [field(docs, "doc_id", "long")])
    errors, _ = fit_rates(rows, mix)
    out = rated(rows, errors, mix.max_rate)
    return out.select(
        "doc_id",
        F.col("_tokens").alias("tokens"),
        *[F.col("_posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)],
        F.col("_rate").alias("rate"),
        copies(F.col("_rate"), F.col("_key")).alias("copies"),
    )


def apply_mix(docs: DataFrame, labels: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``docs`` (a stored table) with each row as often as its copies say."""
    src = with_place(docs)
    rows = _prepared(src, labels, mix, ["_llm_file", "_llm_row"])
    errors, _ = fit_rates(rows, mix)
    n = rated(rows, errors, mix.max_rate).select("_llm_file", "_llm_row", copies(F.col("_rate"), F.col("_key")).alias("_llm_n"))
    n = write_table(n.filter(F.col("_llm_n") != 1), "copies")  # most rows stay once
    once = without_places(src, n, docs.columns)
    if mix.max_rate is not None and mix.max_rate <= 1:
        return once
    more = n.filter(F.col("_llm_n") > 1).withColumnsRenamed({"_llm_file": "_llm_nfile", "_llm_row": "_llm_nrow"})
    repeated = src.join(more, (F.col("_llm_file") == F.col("_llm_nfile")) & (F.col("_llm_row") == F.col("_llm_nrow"))).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_llm_n"))).alias("_llm_at")
    )
    return once.union(repeated.drop("_llm_at"))
