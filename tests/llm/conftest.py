import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) tuples, with clashing extra columns."""

    def make(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("row", "n", "size", "score", "label", "kept", "shard", "part", "item", "token", "class"):
                frame = frame.selectExpr("*", f"'x' as {name}")
        return frame

    return make


@pytest.fixture
def prose():
    def make(seed, words):
        rng = random.Random(seed)
        return " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 400)) for _ in range(words))

    return make
