import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make(spark):
    """documents from (doc_id, text) or full rows."""

    def build(rows, extra: bool = False):
        full = [r if len(r) == 5 else (r[0], r[1], "en", f"src{(r[0] or 0) % 20}", len(r[1] or "")) for r in rows]
        docs = spark.createDataFrame(full, DOCS)
        if extra:  # columns that clash with names used inside
            from pyspark.sql import functions as F

            for name in ("n", "h", "k", "u", "v", "id", "comp", "rank", "length", "task", "label", "score", "grp", "block", "range", "drawn", "p", "w"):
                docs = docs.withColumn(name, F.lit(name))
        return docs

    return build


@pytest.fixture(scope="session")
def prose():
    """Deterministic invented texts."""
    import random

    rng = random.Random(5)
    syllables = ["tha", "ere", "ing", "ou", "st", "nd", "her", "ti", "on", "re", "wa", "lo", "mi", "ka"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(3000)]

    def text(n: int, seed: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(words) for _ in range(n))

    return text
