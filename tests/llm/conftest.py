from __future__ import annotations

import pytest


@pytest.fixture
def docs(spark):
    def make(rows, extra=False):
        """rows: (doc_id, text) or (doc_id, text, lang, source)."""
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            df = df.selectExpr("*", "1 AS id", "'x' AS component", "2 AS size", "3 AS key", "4 AS cell", "5 AS n", "6 AS h", "7 AS cls")
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    import random

    rng = random.Random(3)
    syllables = "the on er ti re nd in ha st or ble ea at es ed".split()

    def make(n, seed=None):
        r = random.Random(seed) if seed is not None else rng
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(2, 4))) for _ in range(n))

    return make
