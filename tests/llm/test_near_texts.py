"""Texts that are not in a pair don't move."""

import pytest

near_dedup = pytest.importorskip("loomgraph.llm.near_dedup")


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_texts_of_few_documents_are_asked_for(spark, monkeypatch, bits):
    monkeypatch.setattr(near_dedup, "BITS", bits)
    texts = spark.range(-3000, 3000).selectExpr("id * 977 as doc", "cast(id as string) as body")
    ids = spark.range(-20, 20).selectExpr("id * 977 * 50 as doc").union(spark.createDataFrame([(0,), (1,)], "doc long"))
    got = near_dedup.likely_of(texts, ids)
    assert got.columns == ["doc", "body"]
    found = {r.doc: r.body for r in got.collect()}
    assert {i * 977 * 50 for i in range(-20, 20)} <= found.keys() and all(found[d] == str(d // 977) for d in found)
    assert len(found) < (60 if bits > 64 else 6000)
    assert near_dedup.likely_of(texts, ids.limit(0)).count() == 0
