"""The pipeline against brute force on a small fixture."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import common
from loomgraph.llm.common import plain_words


def fixture(rng):
    syllables = ["the", "ing", "er", "tion", "and", "ou", "re", "st"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [text(rng.randint(40, 90)) for _ in range(200)]
    item = text(14)
    docs += [docs[0], docs[1].replace(" ", "  "), docs[2]]  # 200-202: exact copies
    near = docs[3].split()
    near[5] = "changed"
    docs += [" ".join(near)]  # 203: near copy
    docs += [text(30) + " " + item.upper() + ". " + text(30)]  # 204: benchmark
    docs += [" | ".join(f"{rng.randrange(10**9)}#%" for _ in range(60)) for _ in range(3)]  # 205-207: junk
    docs += [None, ""]  # 208, 209
    return docs, item


def test_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    docs, item = fixture(random.Random(12))
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "bpe"]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    gone = {200, 201, 202, 203, 204, 205, 206, 207, 208, 209}
    clean = set(range(200))
    assert not gone & set(got)
    assert len(clean - set(got)) <= 2  # the quality limit is a quantile
    assert all(got[i].n_tokens >= len(plain_words(docs[i].encode())) for i in got)


def write(spark, folder, rows, schema, labels=(), bench=()):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame(list(bench), "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))


def test_ids_that_repeat_or_are_missing(spark, tmp_path):
    rng = random.Random(2)
    text = lambda: " ".join(f"word{rng.randrange(300)}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    near = a.split()
    near[3] = "changed"
    rows = [(1, a), (1, a), (2, b), (2, c), (None, d), (None, d), (None, a), (3, " ".join(near)), (None, e), (4, None), (None, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, key string"
    write(spark, tmp_path, [(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in rows], schema)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [f.split()[0] for f in schema.split(", ")], name
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted([(1, a), (2, b), (2, c), (None, d), (None, e)], key=str)


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_workers_get_bounded_batches_and_keep_one_operators_tables(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["b"])

    long_texts = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("some text "), 10_000).alias("text"))
    got = [r.b for r in common.materialize(long_texts.mapInArrow(sizes, "b long"), "sizes").collect()]
    assert sum(got) > 30_000_000 and max(got) < 5_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
    first = common.kept("tokens of one operator", list)
    assert common.kept("tokens of one operator", list) is first
    common.kept("tables of another", dict)
    assert list(common._kept) == ["tables of another"]
    common.WordHashes()
    assert not common._kept


def test_whole_texts_are_read_while_a_table_is_written(spark, tmp_path, monkeypatch):
    """Stages that end in Python return tables, so that their batches are bounded whoever writes the result."""
    labels = []
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda df, label: (labels.append(label), common.materialize(df, label))[1])
    write(spark, tmp_path, [(1, "one text of some words", "en", "s", 22)], "doc_id long, text string, lang string, source string, n_chars long", bench=[(1, "words that are elsewhere")])
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[3:]:
        before = len(labels)
        assert [r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()] == [1], name
        assert len(labels) == before + 1, name
