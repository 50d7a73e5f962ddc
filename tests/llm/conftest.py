import uuid

import pytest

SMALL = "/root/testdata/sf0.001"

WORDS = "the of and to in erat onth thea ingre heat ouwh stan bleor thwhou ersh nding atre 7 42 é ñandú".split()


def prose(seed: int, n: int) -> str:
    """Words that look like a text, from a small generator without state."""
    x, out = seed * 2654435761 % (1 << 32) + 1, []
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("" if x % 3 else str(x % 997)))
        if x % 11 == 0:
            out[-1] += ".\n"
    return " ".join(out)


def edge_rows() -> list[tuple]:
    """Nulls, empty and long texts, ties and repeated rows."""
    long = prose(5, 30_000)
    same = prose(6, 80)
    rows = [
        (1, None, "en", "s", None),
        (2, "", None, None, 0),
        (3, "   \n\t ", "en", "s", 4),
        (None, same, None, None, None),
        (None, same, "en", "s", 5),
        (None, None, None, None, None),
        (4, same, "en", "s", 1),
        (4, same, "en", "s", 1),
        (4, "another text with the same id", "de", "s", 1),
        (5, same + " x", "en", "s", 1),
        (6, "one", "en", "s", 3),
        (7, "One two", "en", "s", 7),
        (8, long, "en", "s", len(long)),
        (9, long + " tail", "en", "s", len(long)),
        (10, "İ é \U0001f600 it's we'LL <|endoftext|> x y \x0b \x0c z", "fr", "s", 9),
        (11, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\n" * 3, "en", "s", 9),
    ]
    rows += [(20 + i, prose(100 + i, 60), "en", "s", 3) for i in range(20)]
    rows += [(60 + i, "shared line number %d of the site\nAll rights are reserved here\n" % i + prose(200 + i, 30), "de", "s", 3) for i in range(6)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["fp", "root", "shard", "slot", "digest", "kept", "tokens", "sign", "tie", "ids", "rate", "weight", "line", "leaf", "n", "a", "b", "_words"]


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Rows as a stored table in several files."""

    def make(rows, schema=SCHEMA, extra=False, files=3):
        df = spark.createDataFrame(rows, schema)
        if extra:
            df = df.selectExpr("*", *[f"'clash' AS `{c}`" for c in CLASHES])
        path = str(tmp_path_factory.mktemp("t") / uuid.uuid4().hex)
        df.repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def edge(table):
    return table(edge_rows(), extra=True)


@pytest.fixture(scope="session")
def empty(table):
    return table([], extra=True, files=1)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def no_labels(table):
    return table([], "doc_id long, quality int, toxic int", files=1)
