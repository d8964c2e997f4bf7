import re

import corpus_pipeline as pipeline
import sentencepiece
from test_jaccard import brute
from test_trained import plain_secrets
from test_texts import leaks

from helioscape.llm import queries


def test_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, columns = {r.doc_id: r for r in docs.collect()}, docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    for number, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf)
        rows = out.collect()
        now = {r.doc_id: r for r in rows}
        assert len(now) == len(rows) and set(now) <= set(before)
        if number == 0:
            judged = {r.doc_id: r.keep for r in queries.QUERIES["op4_quality_classifier"](spark, sf).collect()}
            assert set(now) == {i for i, keep in judged.items() if keep}
        elif number == 1:
            groups = brute([(i, r.text) for i, r in before.items()])
            assert set(now) == set(groups.values()) and len(now) < len(before)
        elif number == 2:
            assert set(now) == {i for i, r in before.items() if not leaks(r.text, bench)[0]} and len(now) < len(before)
        elif number == 3:
            assert set(now) == set(before)
            for i, r in now.items():
                found = plain_secrets(before[i].text)
                assert not plain_secrets(r.text) and r.n_chars == len(r.text)
                assert bool(found) == ("[secret]" in r.text)
                assert found or r.text == before[i].text
        else:
            assert set(now) == set(before) and all(r.ids == model.encode(before[i].text) and r.n_pieces == len(r.ids) for i, r in now.items())
            break
        assert out.columns == columns
        docs, before = spark.createDataFrame(rows, out.schema), now


def test_run(spark, sf):
    found = pipeline.run(spark, sf)
    assert found.columns == ["doc_id", "n_pieces", "ids"] and found.count() > 50


def test_names_of_stages():
    assert 4 <= len(pipeline.STAGES) <= 5 and all(re.search("[a-z]", n) for n, _ in pipeline.STAGES) and pipeline.ORACLE_SQL is None
