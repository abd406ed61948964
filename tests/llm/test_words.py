import pyarrow as pa
import pytest

from thalweg.llm.words import slices, split, texts_of


def batch(null):
    texts = [" ".join(f"Wort{i}X{j}" for j in range(25 + i)) for i in range(60)]
    if null:
        texts[7] = None
    return texts, pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])


@pytest.mark.parametrize("null", [False, True])
@pytest.mark.parametrize("lower", [False, True])
def test_words_of_slices_are_those_of_the_whole(null, lower):
    texts, rows = batch(null)
    got = []
    for s in slices(iter([rows]), "text", 1000):
        words = split(s.column(0), lower)
        vocab = words.vocab.to_pylist()
        got += [[vocab[c].decode() for c in words.codes[a:b]] for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
    assert got == [((t or "").lower() if lower else t or "").split() for t in texts]


def test_texts_of_a_slice():
    texts, rows = batch(False)
    for at in range(0, 60, 7):
        assert texts_of(rows.column(0).slice(at, 5)).to_pylist() == texts[at : at + 5]
