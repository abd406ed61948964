"""Tables of the shared folder: those that only a fit reads are deleted when they are spent, others stay."""

import os
import uuid

import pytest

from thalweg.llm import shared
from thalweg.llm import toxicity_kn as kn

from .test_toxicity_kn import corpus


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    top = tmp_path / "a folder"
    monkeypatch.setattr(shared, "shared_folder", lambda spark, name: f"file://{top}/{name}-{uuid.uuid4().hex}")
    return top


def names(folder):
    return sorted({f.rpartition("-")[0] for f in os.listdir(folder)})


def test_the_fit_leaves_only_what_scores_need(spark, folder):
    docs, labels, _ = corpus(spark, 300)
    model = kn.fit_toxicity(docs, labels)
    assert names(folder) == ["pairs", "text-words", "values", "words"]  # text-words: of the calibration
    got = kn.score_toxicity(docs, model).collect()
    assert len(got) == 300 and all(0 <= r.score <= 1 for r in got)


def test_a_fit_without_a_class_leaves_nothing(spark, folder):
    docs, labels, _ = corpus(spark, 60)
    assert kn.fit_toxicity(docs, labels.where("toxic = 0")) is None
    assert names(folder) == []


def test_only_written_tables_are_discarded(spark, folder, tmp_path):
    one, two = (shared.written(spark.range(n), name) for n, name in ((5, "one"), (0, "two")))
    shared.discard(two)
    assert names(folder) == ["one"] and one.count() == 5
    spark.range(3).write.parquet(str(tmp_path / "mine"))
    with pytest.raises(ValueError, match="mine"):
        shared.discard(spark.read.parquet(str(tmp_path / "mine")))
    assert spark.read.parquet(str(tmp_path / "mine")).count() == 3
