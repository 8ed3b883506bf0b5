"""The pipeline on the smallest tables, stage by stage against brute-force versions."""

import re
from collections import Counter

import numpy as np
import pytest
from test_dedup import by_hand
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from riskloom.llm import common, mixing, packing, quality, tokens

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = common.documents(spark, DATA), []
    top = tmp_path_factory.mktemp("pipeline")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{top}/{k}")
        after = spark.read.parquet(f"{top}/{k}")
        out.append((docs, after))
        docs = after
    return out


def test_columns_are_those_of_documents(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and before.count() >= 1


def test_quality_stage(spark, stages):
    before, after = stages[0]
    model, _ = quality.trained(before, quality.labels_of(spark, DATA))
    want = {r.doc_id for r in before.collect() if model.score(np.array([quality.features_of(r.text.encode())]))[0] >= quality.THRESHOLD}
    assert {r.doc_id for r in after.collect()} == want


def test_exact_stage(stages):
    before, after = stages[1]
    first: dict[str, int] = {}
    for r in before.collect():
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        first[text] = min(first.get(text, r.doc_id), r.doc_id)
    assert Counter(r.doc_id for r in after.collect()) == Counter(first.values())


def test_near_stage(stages):
    before, after = stages[2]
    pairs = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {component for _, _, component in by_hand(pairs, 5, 80)}


def test_mixing_stage(stages):
    before, after = stages[3]
    want = {r.doc_id: r.mix_copies for r in mixing.mixed(before).collect()}
    assert Counter(r.doc_id for r in after.collect()) == want


def test_packing_stage(spark, stages):
    before, after = stages[4]
    library = Tokenizer.from_file(tokens.vocabulary_path())
    want = Counter()
    for r in before.collect():
        n, start = len(library.encode(r.text, add_special_tokens=False).ids) + 1, 0
        for length in packing.piece_lengths(n):
            want[r.doc_id, start, length, n] += 1
            start += length
    assert Counter((r.doc_id, r.start, r.length, r.doc_tokens) for r in after.collect()) == want


def test_run_is_its_stages(spark, stages):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert Counter(map(key, corpus_pipeline.run(spark, DATA).collect())) == Counter(map(key, stages[-1][1].collect()))


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
