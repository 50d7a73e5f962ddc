from collections import Counter

import corpus_pipeline as C
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shiftwise.llm.common import write_table
from tests.llm.conftest import SMALL, edge_rows, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels with junk, copies, near copies and toxic texts."""
    rows, labels = list(edge_rows()), []
    for i in range(400):
        text = prose(1000 + i, 60 + i % 40)
        if i % 8 == 0:
            text = "spam spam spam " * 30
        rows.append((100 + i, text, "en", "s", len(text)))
        labels.append((100 + i, 0 if i % 8 == 0 else 1, 0))
    copy = prose(1001, 61)
    rows += [(900 + i, copy, "en", "s", 1) for i in range(5)] + [(910, prose(1003, 63) + " end", "en", "s", 1)]
    path = str(tmp_path_factory.mktemp("sf"))
    from tests.llm.conftest import CLASHES, SCHEMA

    docs = spark.createDataFrame(rows, SCHEMA)
    docs.selectExpr("*", *[f"'clash' AS `{c}`" for c in CLASHES]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_in_order(spark, folder):
    assert [n for n, _ in C.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mix_to_targets", "pack_sequences"]
    docs = before = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [docs.count()]
    for name, stage in C.STAGES[:-1]:
        docs = write_table(stage(spark, docs, folder), name)
        assert docs.columns == before.columns
        counts.append(docs.count())
        assert not set(docs.select("doc_id", "text").collect()) - set(before.select("doc_id", "text").collect())
    assert counts == sorted(counts, reverse=True) and len(set(counts)) >= 4
    left = Counter(r.text for r in docs.collect())
    assert max(left.values()) == 1 and not any("spam" in t for t in left)
    pieces = C.pack_sequences(spark, docs, folder).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter(i for t in left for i in [*whole.encode(t, add_special_tokens=False).ids, 2])
    assert Counter(i for p in pieces for i in np.frombuffer(bytes(p.ids), "<u4").tolist()) == want


def test_run(spark, folder):
    out = C.run(spark, folder)
    assert {"doc_id", "ids", "sequence_id", "offset"} <= set(out.columns) and out.count()
    assert C.ORACLE_SQL is None
    assert C.run(spark, SMALL).count()


def test_empty_tables(spark, tmp_path):
    from tests.llm.conftest import SCHEMA

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
