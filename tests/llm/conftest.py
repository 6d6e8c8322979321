import pytest
from pyspark.sql import types as T

# Columns whose names operators use inside, to clash with.
EXTRA = ("key", "_key", "fp", "added", "words", "node", "n")


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text) pairs, with columns that clash."""
    def make(rows, lang="en"):
        schema = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string")
        for name in EXTRA:
            schema = schema.add(name, "string")
        data = [(i, t, lang, *(f"{name}{j}" for name in EXTRA)) for j, (i, t) in enumerate(rows)]
        return spark.createDataFrame(data, schema)

    return make


LONG = "lorem ipsum dolor sit amet " * 20_000
EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "no id here at all"), (5, "same text twice over"),
    (5, "same text twice over"), (6, "same text twice over"), (7, LONG), (8, "é日本 𝔸 <|endoftext|> x"), (None, None),
]
