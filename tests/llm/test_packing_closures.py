import public_tokenizers
import pytest
from pyspark import cloudpickle

from shiftwise.llm import packing as P
from tests.llm.conftest import prose

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def packs(table, monkeypatch):
    """The function that the tasks of a packing run, with an encoder held by the driver."""
    found = []
    inner = P.map_arrow

    def map_arrow(df, run, schema):
        found.append(run)
        return inner(df, run, schema)

    monkeypatch.setattr(P, "map_arrow", map_arrow)
    P.pack(table([(i, prose(i, 30), "en", "s", 0) for i in range(5)], files=1), VOCABULARY)
    P.encoder(VOCABULARY).ids(prose(1, 2000))
    return found[-1]


def test_tasks_do_not_carry_the_tokenizer(packs):
    """The closure has the weights of the ids and little else; run, it frees the encoders of its process."""
    sent = cloudpickle.dumps(packs)
    assert len(sent) < 600_000
    assert cloudpickle.loads(sent).__globals__.get("_encoders") is None
    assert P._encoders
    P.forget_encoders()
    assert not P._encoders
