import pytest

from tests.conftest import spark  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that operators use inside, as extra columns of the input.
CLASHES = ["row", "part", "window", "item", "fp", "h", "i", "d", "doc", "found", "value", "owner", "key", "words", "node", "root", "_id", "_t", "id", "unit", "block_", "length"]

#: Null, empty and one-word texts, a null id, a repeated row and a long text.
EDGES = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, "word", "en", None, 4),
    (None, "a text whose id is null, with some more words", "en", "b", 45),
    (5, "the same row twice over and over", "en", "b", 32),
    (5, "the same row twice over and over", "en", "b", 32),
    (6, "long " * 40_000 + "end", "en", "c", 200_003),
    (7, "ünï çødé 中文 text \x00 with\x0bodd spaces", "de", "c", 20),
]


@pytest.fixture(scope="session")
def docs_of(spark):  # noqa: F811
    """Documents from rows of (doc_id, text, lang, source, n_chars), or of (doc_id, text)."""

    def build(rows, clashes=False):
        full = [r if len(r) == 5 else (r[0], r[1], "en", f"src{(r[0] or 0) % 3}", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clashes:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
        return df

    return build
