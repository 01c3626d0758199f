import random

import public_tokenizers
import pytest

from eventweir.llm.text import session


@pytest.fixture(autouse=True)
def text_session(spark):
    session(spark)


@pytest.fixture
def bpe_path():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def words():
    """Seeded texts of made-up words."""

    def make(seed, n, vocabulary=400):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))

    return make


#: Columns whose names the operators use themselves.
CLASHING = "doc_id bigint, text string, hash string, row int, n_lines string, key string, spans string, score string, words int"


@pytest.fixture
def awkward(table):
    """Nulls, empty and long texts, repeated rows and clashing columns."""

    def make(texts):
        rows = [(i, t, "h", 1, "x", "k", "s", "y", 2) for i, t in enumerate(texts)]
        return table([*rows, rows[0], (None, texts[0], *rows[0][2:])], CLASHING)

    return make
