import random
import re

from shiftwise.llm import licenses as L
from tests.llm.conftest import edge_rows


def slow_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def slow_base(text):
    words, out = slow_words(text), []
    for phrase, label in L.PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), out


def check(rows, got):
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got}
    want = set()
    for i, t in rows:
        n, places = slow_base(t)
        starts = [s for s, _ in places]
        want.add((i, n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    assert got == want


def test_base_places(edge, empty, small):
    found = L.scan_documents(edge).collect()
    assert len(found) == len(edge_rows())
    check([(i, t) for i, t, *_ in edge_rows()], found)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)
    assert L.scan_documents(empty).collect() == []
    check([(r.doc_id, r.text) for r in small.collect()], L.scan_documents(small).collect())


def test_matching_statistics_and_phrases():
    rnd = random.Random(4)
    for _ in range(30):
        letters = "abc"
        templates = [[rnd.choice(letters) for _ in range(rnd.randint(1, 9))] for _ in range(3)]
        phrases = [[rnd.choice(letters) for _ in range(rnd.randint(1, 3))] for _ in range(2)]
        auto = L.Automaton(templates, phrases)
        text = [rnd.choice(letters) for _ in range(60)]
        known = {tuple(t[i:j]) for t in [*templates, *phrases] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        ids = [auto.ids.get(w) for w in text]
        if None in ids:
            continue
        for i, (state, size) in enumerate(auto.statistics(ids)):
            longest = max((n for n in range(i + 2) if n == 0 or tuple(text[i - n + 1 : i + 1]) in known))
            assert size == longest
            ends = [k for n, k in auto.phrases[state] if n <= size]
            assert sorted(ends) == [k for k, p in enumerate(phrases) if text[max(0, i - len(p) + 1) : i + 1] == p]
            if size:
                places = [(k, e) for k, t in enumerate(templates) for e in range(len(t)) if e + 1 >= size and t[e - size + 1 : e + 1] == text[i - size + 1 : i + 1]]
                assert auto.ends[state] == places


def test_covered_spans():
    label, text = L.TEMPLATES[0]
    found = L.scan("intro words\n" + text + "\nthe rest")
    assert [(s["label"], s["share"], s["first"], s["last"]) for s in found["spans"]] == [(label, 1.0, 2, 2 + len(slow_words(text)) - 1)]
    words = text.split()
    changed = " ".join("holder" if i == 40 else w for i, w in enumerate(words))  # one word replaced: two matches, one chain
    (span,) = L.scan(changed)["spans"]
    assert span["label"] == "mit" and 0.95 < span["share"] < 1
    assert L.scan(" ".join(words[:30]))["spans"] == []
    gpl = L.scan("This work is licensed under the GNU General Public License, version 3.")
    assert {s["label"] for s in gpl["spans"]} == {"gpl-3"} and not gpl["places"]
    assert L.scan(None) == {"n_words": 0, "places": [], "spans": []}


def test_many_repeats_stay_linear():
    found = L.scan("Released under the MIT License. " * 20_000)
    assert len(found["places"]) == 20_000 and found["spans"]


def spans(text):
    return [(s["label"], round(s["share"], 2), s["first"], s["last"]) for s in L.scan(text)["spans"]]


def test_copies_cuts_and_other_orders():
    words = slow_words(L.TEMPLATES[0][1])
    n, whole, foreign = len(words), " ".join(words), " ".join(f"x{i}" for i in range(18))
    # two copies are two spans
    assert spans(f"{whole} {foreign} {whole}") == [("mit", 1.0, 0, n - 1), ("mit", 1.0, n + 18, 2 * n + 17)]
    assert spans(f"{whole} {whole}") == [("mit", 1.0, 0, n - 1), ("mit", 1.0, n, 2 * n - 1)]
    # cut in the middle by foreign words: one span, gaps charged
    half = n // 2
    cut = [*words[:half], *foreign.split(), *words[half:]]
    assert spans(" ".join(cut)) == [("mit", 1.0, 0, n + 17)]
    # swapped halves
    assert spans(" ".join([*words[half:], *words[:half]])) == [("mit", 1.0, 0, n - 1)]
    # too far apart, too little left, or too much in between
    far = " ".join(f"y{i}" for i in range(41))
    assert spans(f"{' '.join(words[:half])} {far} {' '.join(words[half:])}") == []
    assert spans(" ".join(words[: half - 3])) == []
    holes = [w for i, w in enumerate(words) if i % 9 < 5 or i > 80]  # five words, then four that are not there
    assert spans(" ".join(holes)) == []


def test_chains_are_the_best_of_all():
    """Scores of the best chain against all orders of matches of a small template."""
    rnd = random.Random(8)
    template = [f"w{i}" for i in range(24)]
    for _ in range(60):
        parts = [template[a : a + rnd.randint(4, 9)] for a in sorted(rnd.sample(range(18), rnd.randint(1, 4)))]
        text = []
        for p in parts:
            text += [*p, *[f"x{rnd.random()}"] * rnd.randint(1, 6)]
        auto, sizes, _ = L._built((("t", " ".join(template)),), L.PHRASES)
        ids, matches, at = [auto.ids.get(w) for w in text], [], 0
        for p in parts:  # each part is a maximal match by itself, with foreign words around
            found = list(auto.statistics([i for i in ids[at : at + len(p)]]))
            matches.append((at + len(p) - 1, len(p), found[-1][0]))
            at += len(p)
            while at < len(text) and ids[at] is None:
                at += 1

        def best(j, low):
            end, size, _ = matches[j]
            begin, start = end - size + 1, template.index(text[end - size + 1])
            score = size
            for i in range(j):
                e, z, _ = matches[i]
                last = template.index(text[e])
                if start + size - 1 > last:
                    over = max(0, last - start + 1)
                    if over < size:
                        score = max(score, best(i, low) + size - over - 0.25 * (begin - e - 1) - 0.25 * max(0, start - last - 1))
            return score

        want = max(best(j, 0) for j in range(len(matches)))
        chains = L._chains(matches, auto, sizes, 40, 0.0)
        covers = L._chains(matches, auto, sizes, 40, (want - 1e-9) / 24)
        assert chains and covers and not L._chains(matches, auto, sizes, 40, (want + 1e-6) / 24)


def test_every_template_has_its_own_label():
    """Notices of a family read alike; each text gives the label it is."""
    for label, text in L.TEMPLATES:
        assert {s["label"] for s in L.scan(f"a file, {text} And so on.")["spans"]} == {label}, text
    assert {s["label"] for s in L.scan("licensed under CC BY-NC 4.0, and later licensed under CC BY 4.0")["spans"]} == {"cc-by-nc", "cc-by"}
