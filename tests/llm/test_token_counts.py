import random

import pyarrow as pa
import pytest

sentencepiece = pytest.importorskip("sentencepiece")

from thalweg.llm.token_counts import count_texts, default_model, token_counts  # noqa: E402

from .common import empty, frame, odd_texts  # noqa: E402


@pytest.mark.parametrize("seed", range(3))
def test_same_as_the_library(seed):
    r = random.Random(seed)
    texts = [*odd_texts(), "a  b\tc\nd", "<s> hi </s> <unk>", " x", "x ", "▁a", "<0x41>", "ﬁ ００", "a▁▁b ", "é" * 60, "====----====      ----"]
    texts += ["".join(r.choice("ab \n\té▁<>0x1日🎉thern") for _ in range(r.randint(0, 60))) for _ in range(400)]
    model = sentencepiece.SentencePieceProcessor(model_file=default_model())
    assert count_texts(pa.array(texts), default_model()).tolist() == [len(model.encode(t or "")) for t in texts]


def test_frame(spark):
    rows = token_counts(frame(spark, odd_texts(), extra=True), limit=50).collect()
    assert len(rows) == len(odd_texts()) + 2
    by = {r.doc_id: r for r in rows}
    assert by[0].n_tokens == 0 and by[0].n_bytes == 0 and not by[0].over_limit
    assert by[8].over_limit
    assert token_counts(empty(spark)).count() == 0
