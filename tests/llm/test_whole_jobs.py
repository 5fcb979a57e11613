"""Cases that operators once left out."""

import numpy as np
import pyarrow as pa
import pytest

from tomolake.llm import toxicity


@pytest.fixture(scope="module")
def decode():
    text = "the idiot and the moron ring pigs ass stupid trash to in worthless piece of garbage " * 50
    counts = next(iter(toxicity._trigrams([pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])])))
    n = np.zeros(toxicity.K**3)
    n[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    n = n.reshape((toxicity.K,) * 3)
    return toxicity.Decoder(np.log((n + 0.01) / (n.sum(2, keepdims=True) + 0.28)))


def test_long_spans_are_decoded(decode):
    assert decode(" ".join("worthlesspieceofgarbage" * 2)).replace(" ", "") == "worthlesspieceofgarbage" * 2
    assert decode("m" + "o" * 60 + "ron") == "moron"
    assert decode("w" + "o" * 20_000 + "rthless") == "worthless"


def test_signs_stand_anywhere(decode):
    for raw, want in [("a$$", "ass"), ("idio7", "idiot"), ("i d 1 0 t", "idiot"), ("p i g 5", "pigs"), ("i  d  i  o  t", "idiot"), ("i d  i o t", "idiot"), ("1 d - i . 0 7", "idiot"), ("m o r o n  i d i o t", "moron  idiot"), ("idiot!", "idiot!"), ("1 2 3 4", "1 2 3 4")]:
        assert decode(raw) == want, raw
        assert toxicity.restored(["the ring", raw], decode) == ["the ring", want], raw
