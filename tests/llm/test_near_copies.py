from __future__ import annotations

from tillcast.llm import minhash


def test_ids_that_meet_are_written_before_the_texts_move(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(minhash, "workspace", lambda spark, name: f"{tmp_path}/{name}")
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    texts = [" ".join(long), " ".join([*long, "more"]), "nothing like the others at all", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in minhash.near_copies(docs).collect()}
    ids = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/minhash/met").collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 3} and ids == {0, 1}
