from shiftwise.llm import quality as Q
from tests.llm.conftest import prose


def plain(i):
    return prose(i, 40).replace("7", "").replace("4", "")


def test_no_language_borrows_the_cutoffs_of_others(table):
    """Many small languages, none certifiable: together they would be."""
    rows, labels = [], []
    for i in range(600):  # en is certified and rejects junk
        junk = i % 10 == 0
        rows.append((i, plain(i).replace(" ", " ### ") if junk else plain(i), "en", "s", 0))
        labels.append((i, 0 if junk else 1, 0))
    for i in range(600, 1000):  # eight languages of 50 good documents each
        lang = f"l{i % 8}"
        odd = lang == "l3"  # one of them writes with many symbols, and is good
        rows.append((i, plain(i).replace(" ", " # ") if odd else plain(i), lang, "s", 0))
        labels.append((i, 1, 0))
    wide = " ".join("字" * (60 + k) for k in range(12))
    rows += [(2000, wide, "ja", "s", 0), (2001, wide, None, "s", 0), (2002, wide, "en", "s", 0), (2003, wide, "*", "s", 0)]
    got = {r.doc_id: r for r in Q.judge(table(rows), table(labels, "doc_id long, quality int, toxic int"), Q.Risk(0.3)).collect()}
    assert not got[2002].kept and not got[2002].base_failed
    assert not any(got[i].kept for i in range(0, 600, 10))
    for i, _, lang, *_ in rows:
        if lang != "en":
            assert got[i].kept == (not got[i].base_failed), (i, lang)
    assert all(got[i].kept for i in (2000, 2001, 2003))


def test_any_number_of_languages_has_cutoffs_of_its_own(table):
    rows, labels = [], []
    for i in range(70 * 80):
        lang = None if i % 70 == 0 else f"l{i % 70}"
        rows.append((i, f"{i} some good words that are all of them unlike each other here", lang, "s", 0))
        labels.append((i, 1, 0))
    rows += [(10_000 + k, " ".join("x" * (60 + w) for w in range(12)), None if k == 0 else f"l{k}", "s", 0) for k in range(70)]
    docs, given = table(rows), table(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in Q.judge(docs, given, Q.Risk(0.9)).collect()}
    assert all(got[i] for i in range(70 * 80))
    assert not any(got[10_000 + k] for k in range(70))
