import math
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from shiftwise.llm import quality as Q
from shiftwise.llm.common import write_table
from tests.llm.conftest import edge_rows, prose

SPACE = " \t\n\x0b\x0c\r"


def slow_words(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def slow(text):
    text = text or ""
    words = slow_words(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_counts(edge, empty, small, no_labels):
    for df, rows in ((edge, [(i, t) for i, t, *_ in edge_rows()]), (small, [(r.doc_id, r.text) for r in small.collect()])):
        got = Q.judge(df, no_labels).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *slow(t)) for i, t in rows)
        for r in got:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert r.kept == (not r.base_failed)  # nothing is certified without labels
    assert Q.judge(empty, no_labels).collect() == []


def test_repeats_that_touch_and_overlap(table, no_labels):
    texts = ["a " * 30, "a b c d e f a b c d e f g", "x a b c d e y a b c d e a b c d e", "1 2 3 4 5 6 7 8 9", " ".join(map(str, range(5000))) * 2]
    df = table([(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    assert {r.doc_id: r.n_repeat_words for r in Q.judge(df, no_labels).collect()} == {i: slow(t)[-1] for i, t in enumerate(texts)}


def tail(n, k, rate):
    return float(sum(math.comb(n, i) * Fraction(rate) ** i * (1 - Fraction(rate)) ** (n - i) for i in range(k + 1)))


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 5, 19, 21, 50, 400, 3000) for k in (0, 1, 2, 3, 10, 25) if k <= n]
    df = spark.createDataFrame(cases, "n long, k long")
    for rate in (0.0016, 0.01, 0.2):
        for r in df.select("n", "k", Q.binomial_tail(F.col("n"), F.col("k"), rate).alias("p")).collect():
            want = tail(r.n, r.k, rate)
            if r.k < r.n * rate:
                assert abs(r.p - want) <= 1e-9 * want, (r, want)
            else:
                assert r.p == 1.0


def labelled(table):
    """300 good texts a language, one in fifty with many symbols, and junk full of them."""
    rows, labels = [], []
    for i in range(900):
        lang = "en" if i < 700 else "de"
        junk = i % 10 == 0
        odd = i % 50 == 1
        text = prose(i, 40).replace("7", "").replace("4", "")
        if junk:
            text = text.replace(" ", " ### ")
        elif odd:
            text = text.replace(" ", " # ", 7)
        rows.append((i, text, lang, "s", 0))
        labels.append((i, 0 if junk else 1, 0))
    return table(rows), table(labels + labels[:5] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int"), rows, labels


def walked(strata, risk):
    """Fixed sequences at levels shared by Holm: stratum -> steps passed.
    ``strata``: stratum -> (good documents, those that each step rejects)."""
    sizes = sorted(((n, s) for s, (n, _) in strata.items()), key=lambda x: (-x[0], x[1] is not None, x[1] or ""))
    m = max([i for i, (n, _) in enumerate(sizes, 1) if (1 - risk.risk) ** n <= risk.delta / i], default=0)
    p = {}
    for n, s in sizes[:m]:
        p[s] = [tail(n, k, risk.risk) if k < n * risk.risk else 1.0 for k in strata[s][1]]
    passed, left = {}, set(p)
    while True:  # a stratum that ends its path hands its level on
        whole = [s for s in left if max(p[s]) <= risk.delta / len(left)]
        if not whole:
            break
        least = min(whole, key=lambda s: max(p[s]))
        passed[least] = len(p[least])
        left.remove(least)
    for s in left:
        passed[s] = next((i for i, x in enumerate(p[s]) if x > risk.delta / len(left)), len(p[s]))
    return passed


def rejections(rows, good):
    """rows: (doc_id, lang, {rule: score}) that pass the base rules."""
    out = {}
    for i, lang, scores in rows:
        if i in good:
            n, k = out.setdefault(lang, (0, [0] * Q.STEPS))
            out[lang] = (n + 1, [x + any(scores[r] > c for r, c in step.items()) for x, step in zip(k, Q.path())])
    return out


def scores_of(counts):
    scored = Q.rules()
    rows = counts.filter(~Q.base_failed()).select("doc_id", "lang", *[s.alias(n) for n, (s, _) in scored.items()]).collect()
    return [(r.doc_id, r.lang, {n: r[n] for n in scored}) for r in rows]


def test_path_is_nested():
    for a, b in zip(Q.path(), Q.path()[1:]):
        assert all(b[r] <= a[r] for r in a)
    assert len(Q.path()) == Q.STEPS


def test_thresholds_walk_a_fixed_sequence(table):
    docs, labels, _, given = labelled(table)
    counts = write_table(Q.base_counts(docs.select("doc_id", "lang", "text"), ["doc_id", "lang"]), "counts")
    for risk in (Q.Risk(risk=0.3, delta=0.05), Q.Risk(risk=0.03, delta=0.2), Q.Risk(risk=0.001)):
        good = {i for i, q, _ in given if q == 1}  # the other label of 3 has no quality and is void
        passed = walked(rejections(scores_of(counts), good), risk)
        want = {s: dict(Q.path()[n - 1]) if n else {} for s, n in passed.items()}
        assert Q.thresholds(counts, labels, risk) == want, risk
    kept = {r.doc_id: r.kept for r in Q.judge(docs, labels, Q.Risk(0.3)).collect()}
    wrong = [i for i in good if i in kept and not kept[i]]
    assert len(wrong) <= 0.3 * len(good)
    assert not any(kept[i] for i, q, _ in given if q == 0)


def test_levels_are_handed_on(spark):
    """Synthetic counts of strata: the walk in Spark against the plain one."""
    import random

    rnd = random.Random(5)
    for risk in (Q.Risk(0.05, 0.05), Q.Risk(0.1, 0.2)):
        rows, labels = [], []
        for s in range(12):
            clean = rnd.choice([20, 80, 2000])
            for _ in range(rnd.choice([5, 60, 120, 240, 480])):
                symbols = rnd.choice([0.0] * clean + [0.12, 0.12, 0.22, 0.22, 0.35])
                rows.append((len(rows), None if s == 0 else f"l{s}", 1000, 5000, int(symbols * 1000), 0, 10, 0, 0))
                labels.append((len(rows) - 1, 1))
        names = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_capitals long, n_lines long, n_dup_lines long, n_repeat_words long"
        counts = write_table(spark.createDataFrame(rows, names), "counts")
        passed = walked(rejections(scores_of(counts), {i for i, _ in labels}), risk)
        want = {s: dict(Q.path()[n - 1]) if n else {} for s, n in passed.items()}
        assert Q.thresholds(counts, spark.createDataFrame(labels, "doc_id long, quality int"), risk) == want
        assert len(set(passed.values())) > 2


def test_bound_holds_on_held_out_labels(spark):
    """The given documents: English is certified by one half of its labels, and rejects
    at most the risk in the other half, but most of the labelled junk."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(8)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    known = docs.join(labels.select(F.col("doc_id").alias("l"), "quality"), F.col("doc_id") == F.col("l")).select("doc_id", "lang", "text")
    counts = write_table(Q.base_counts(known, ["doc_id", "lang"]), "held-out")
    whole = Q.thresholds(counts, labels)
    assert set(whole) >= {"en", "de", "fr"} and all(whole[s] for s in ("en", "de", "fr"))
    cuts = Q.thresholds(counts, labels.filter(half == 0))["en"]
    assert cuts
    quality = {r["doc_id"]: r["quality"] for r in labels.filter(half == 1).collect()}
    gone = {0: [], 1: []}
    for i, lang, scores in scores_of(counts):
        if lang == "en" and i in quality:
            gone[quality[i]].append(any(scores[r] > c for r, c in cuts.items()))
    assert len(gone[1]) > 500 and sum(gone[1]) <= 0.01 * len(gone[1])
    assert sum(gone[0]) > 0.3 * len(gone[0])


def test_keep_good(table, edge, empty, no_labels):
    docs, labels, *_ = labelled(table)
    kept = {r.doc_id for r in Q.judge(docs, labels, Q.Risk(0.3)).collect() if r.kept}
    assert {r.doc_id for r in Q.keep_good(docs, labels, Q.Risk(0.3)).collect()} == kept
    out = Q.keep_good(edge, no_labels)
    assert out.columns == edge.columns and out.count() == sum(r.kept for r in Q.judge(edge, no_labels).collect())
    assert Q.keep_good(empty, no_labels).collect() == []


def test_no_python_in_the_plan(small, no_labels, spark):
    plan = Q.judge(small, no_labels)._jdf.queryExecution().toString()
    plan += Q.base_counts(small, ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
