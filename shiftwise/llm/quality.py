"""Quality rules with risk-controlled thresholds.

Every rule is a score of a text (higher is worse) with a fixed grid of
cutoffs from lenient to strict. The grids together make one path of ``STEPS`` steps:
each step is a cutoff for every rule, none more lenient than the step before. On a labelled
holdout, the documents of good quality that any cutoff of a step rejects are its false
rejections, and the exact binomial test asks whether their rate is at most
``risk``. A stratum (language) walks the path from its lenient end and stops before the
first step whose test fails: a fixed sequence, so each step is tested at the whole
level of the stratum. The levels share ``delta`` by Holm's step-down: a stratum
that passes the whole path hands its level on to the others. So, with
probability 1 - delta, in no stratum more than a share ``risk`` of the good
documents is rejected by the last step it passed. The fixed base rules reject first.
Strata with too few good documents to pass any step are not tested, which their
number alone decides.

Only built-in functions are used. Base counts are made inside the row by array
functions, whatever its length. Every language is certified by its own labelled
documents only: where they are too few to certify anything, or where there are
none, no cutoff applies and only the base rules reject. The cutoffs are a
written table, a row per certifiable language, joined to the documents.

Null texts have no words and fail the base rules. Documents without a language
are a stratum of their own, certified by labelled documents without one.
Labels of a document that are given more than once count once, good only if
all of them are. Without labels nothing is certified and only the base rules
reject. Repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftwise.llm.common import field, with_place, without_places, write_table

_SPACE = "[ \\t\\n\\u000b\\f\\r]+"
_WINDOW = 5
#: A stratum that ``thresholds`` never has: no language shares the cutoffs of others.
POOLED = "*"

#: rule -> cutoffs from lenient to strict
GRIDS: dict[str, tuple[float, ...]] = {
    "symbols": (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeats": (0.2, 0.15, 0.1),
    "lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "long_words": (40.0, 30.0, 20.0, 15.0, 12.0, 10.0),
    "short_words": (-1.0, -1.5, -2.0, -2.5, -3.0),
    "capitals": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
}


def rules() -> dict[str, tuple[Column, tuple[float, ...]]]:
    """rule -> (score over the base counts, cutoffs from lenient to strict)."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    scores = {
        "symbols": F.col("n_symbols") / words,
        "repeats": F.col("n_repeat_words") / words,
        "lines": F.col("n_dup_lines") / lines,
        "long_words": F.col("word_chars") / words,
        "short_words": -F.col("word_chars") / words,
        "capitals": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
    }
    return {name: (score, GRIDS[name]) for name, score in scores.items()}


@dataclass(frozen=True)
class Risk:
    risk: float = 0.01
    delta: float = 0.05


def _length(text: Column) -> Column:
    return F.char_length(text).cast("long")


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash of each window of five words."""
    n = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(1), n - F.lit(_WINDOW - 1)),
        lambda i: F.xxhash64(*[F.element_at(words, i + F.lit(k)) for k in range(_WINDOW)]),
    )
    return F.when(n >= _WINDOW, hashes)


def _covered(placed: Column) -> Column:
    """Words covered by windows that occur more than once; ``placed`` are the
    (hash, place) of all windows in order of the hash."""
    h = F.transform(placed, lambda x: x["h"])
    none = F.array(F.lit(None).cast("bigint"))
    near = F.arrays_zip(
        placed.alias("p"),
        F.concat(none, F.slice(h, 1, F.size(placed) - 1)).alias("b"),
        F.concat(F.slice(h, 2, F.size(placed)), none).alias("a"),
    )
    again = F.filter(near, lambda x: x["p"]["h"].eqNullSafe(x["b"]) | x["p"]["h"].eqNullSafe(x["a"]))
    return F.aggregate(
        F.array_sort(F.transform(again, lambda x: x["p"]["i"])),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-_WINDOW).alias("last")),
        lambda s, i: F.struct(
            (s["n"] + F.least(F.lit(_WINDOW), i - s["last"])).cast("long").alias("n"), i.alias("last")
        ),
        lambda s: s["n"],
    )


def base_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns plus the counts of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select(
        *keep,
        F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), _SPACE).alias("_words"),
        _length(F.regexp_replace(text, _SPACE, "")).alias("word_chars"),
        (_length(text) - _length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).alias("n_symbols"),
        (_length(text) - _length(F.regexp_replace(text, "[A-Z]+", ""))).alias("n_capitals"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "").alias("_lines"),
    )
    two = one.select(
        *keep,
        F.when(F.col("word_chars") == 0, 0).otherwise(F.size("_words")).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_capitals",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _window_hashes(F.col("_words")).alias("_hashes"),
    )
    # most texts repeat no window, which the number of distinct hashes shows
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    placed = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    three = two.withColumn("_placed", F.when(repeats, placed)).drop("_hashes")
    covered = F.when(F.col("_placed").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.col("_placed")))
    return three.withColumn("n_repeat_words", covered).drop("_placed")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def _ln_factorial(n: Column) -> Column:
    """ln n!: exact to 20, then Stirling's series (error below 1e-13)."""
    x = n.cast("double")
    big = (
        (x + 0.5) * F.log(x) - x + F.lit(0.9189385332046727)  # ln sqrt(2 pi)
        + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    )
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(big)


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k) for k below n * rate, else 1.

    Summed from k downwards; the terms fall geometrically, so as many as hold
    any weight in double precision are added, and a bound of the rest.
    """
    odds = math.log(rate) - math.log1p(-rate)
    first = (
        _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)
        + k.cast("double") * math.log(rate) + (n - k).cast("double") * math.log1p(-rate)
    )
    steps = F.least(k, F.ceil(F.sqrt(n.cast("double") * rate) * 40 + 60).cast("long"))
    walked = F.aggregate(
        F.sequence(F.lit(0).cast("long"), steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct(
            (
                s["term"]
                * F.greatest(k - i, F.lit(0)).cast("double")
                / ((n - k + i + 1).cast("double") * math.exp(odds))
            ).alias("term"),
            (s["sum"] + s["term"]).alias("sum"),
        ),
        lambda s: s["sum"] + s["term"],
    )
    return F.when(k.cast("double") >= n.cast("double") * rate, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(first) * walked))


STEPS = 10


def path() -> list[dict[str, float]]:
    """A cutoff for every rule, from lenient to strict."""
    return [{name: cuts[s * len(cuts) // STEPS] for name, cuts in GRIDS.items()} for s in range(STEPS)]


def cutoffs(counts: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """(stratum, a column per rule): the cutoffs of the strictest certified step,
    null where there is none; a row per language with enough good documents.

    ``counts`` has doc_id, lang and the base counts.
    """
    steps, scores = path(), {name: score for name, (score, _) in rules().items()}
    good = (
        labels.select(field(labels, "doc_id", "long"), field(labels, "quality", "int"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .filter(F.col("quality") == 1)
        .select(F.col("doc_id").alias("l_id"))
    )
    held = counts.filter(~base_failed()).join(good, F.col("doc_id") == F.col("l_id"))

    def rejected(step: dict[str, float]) -> Column:
        return reduce(lambda a, b: a | b, [scores[name] > cut for name, cut in step.items()])

    per_stratum = held.groupBy(F.col("lang").alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(rejected(step)).alias(f"k{i}") for i, step in enumerate(steps)]
    )
    # from here on a row or STEPS rows a language. Of the m largest strata each can pass
    # a step at delta / m: the largest such m is tested
    place = F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("stratum")))
    least = F.log(F.lit(risk.delta) / place) / math.log1p(-risk.risk)
    sized = per_stratum.select("*", place.alias("place"), F.when(F.col("n") >= least, place).alias("able"))
    tested = sized.withColumn("m", F.max("able").over(Window.partitionBy(F.lit(0)))).filter(F.col("place") <= F.col("m"))
    p = F.array(*[binomial_tail(F.col("n"), F.col(f"k{i}"), risk.risk) for i in range(STEPS)])
    # Holm over whole paths: the i-th least of their largest p against delta / (m - i + 1)
    order = Window.orderBy("worst", "stratum")
    walked = tested.select("stratum", "m", p.alias("p"), F.array_max(p).alias("worst"))
    fails = (F.col("worst") > F.lit(risk.delta) / (F.col("m") - F.row_number().over(order) + 1)).cast("int")
    ranked = walked.withColumn("fails", fails)
    ranked = ranked.withColumn("failed", F.sum("fails").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    done = F.sum((F.col("failed") == 0).cast("int")).over(Window.partitionBy(F.lit(0)))
    level = F.lit(risk.delta) / F.greatest(F.col("m") - done, F.lit(1))
    first = F.array_position(F.transform("p", lambda x: x > F.col("_level")), F.lit(True))  # 0: none fails
    passed = ranked.withColumn("_level", level).select(
        "stratum", F.when((F.col("failed") == 0) | (first == 0), STEPS).otherwise(first - 1).cast("int").alias("passed")
    )
    return passed.select(
        "stratum",
        *[F.try_element_at(F.array(*[F.lit(s[name]) for s in steps]), F.nullif("passed", F.lit(0))).alias(name) for name in scores],
    )


def thresholds(counts: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> dict[str | None, dict[str, float]]:
    """``cutoffs`` for reading: stratum -> rule -> cutoff (missing: none)."""
    return {
        r["stratum"]: {name: r[name] for name in rules() if r[name] is not None}
        for r in cutoffs(counts, labels, risk).collect()
    }


def with_kept(counts: DataFrame, labels: DataFrame, risk: Risk) -> DataFrame:
    """``counts`` plus ``kept``: whether a row passes all rules."""
    cuts = write_table(cutoffs(counts, labels, risk), "cutoffs")
    cuts = cuts.select(F.col("stratum").alias("_stratum"), *[F.col(name).alias(f"_cut_{name}") for name in rules()])
    kept = ~base_failed()
    for name, (score, _) in rules().items():
        kept = kept & ~F.coalesce(score > F.col(f"_cut_{name}"), F.lit(False))
    return counts.join(cuts, F.col("lang").eqNullSafe(F.col("_stratum")), "left").select(*counts.columns, kept.alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """A row per document: doc_id, base counts, base_failed, kept."""
    src = docs.select(field(docs, "doc_id", "long"), field(docs, "lang", "string"), field(docs, "text", "string"))
    counts = write_table(base_counts(src, ["doc_id", "lang"]), "quality")
    return with_kept(counts, labels, risk).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), "kept",
    )


def keep_good(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """``docs`` (a stored table) without the rejected ones."""
    src = with_place(docs)
    rows = src.select(field(src, "doc_id", "long"), field(src, "lang", "string"), field(src, "text", "string"), "_llm_file", "_llm_row")
    counts = write_table(base_counts(rows, ["doc_id", "lang", "_llm_file", "_llm_row"]), "quality")
    gone = with_kept(counts, labels, risk).filter(~F.col("kept")).select("_llm_file", "_llm_row")
    return without_places(src, write_table(gone, "rejected"), docs.columns)
