import json

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """documents of (doc_id, text) or longer rows, dealt to two partitions, with columns that clash with the operators' own."""

    def build(rows, extra=True):
        full = [(*r, *[None] * (5 - len(r))) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS).repartition(2)
        if extra:
            df = df.selectExpr("*", "'x' AS fp", "1 AS n_lines", "'y' AS size", "2 AS `start`", "'z' AS keep", "3 AS score")
        return df

    return build


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """A folder with documents.parquet (and other tables) of the given rows."""

    def build(**tables):
        folder = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return build


WORDS = json.loads('["the","of","thion","ander","alpha","beta","gamma","delta","house","river","über","straße","ñandu","café"]')


def text_of(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


#: Nulls, empty and blank texts, repeats, odd white space, long words and long texts.
EDGES = [
    (None, "a null id with some words in it"),
    (None, None),
    (5, None),
    (6, ""),
    (7, " \t\n "),
    (8, "one"),
    (8, "one"),
    (9, "One\x1fTwo three  four\x0bfive\n\nsix  "),
    (10, "x" * 5000 + " ünïcode \U0001f600 " + "y" * 3000),
    (-3, "negative id, 1234567890 !!! <|endoftext|> <|startoftext|>"),
    (2**62, "\n\nleading and trailing \n"),
]
