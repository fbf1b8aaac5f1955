import random

import pytest

LONG = " ".join(f"Word{i % 977} token-{i % 31}," for i in range(20000))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties and columns with clashing names."""
    rows = [
        (1, "One two three four five six seven", "en", "src0", 3),
        (2, None, None, None, None),
        (3, "", "en", "src1", 0),
        (None, "a text without an id password = 'hunter2hunter2'", "en", "src2", 1),
        (4, LONG, "en", "src0", 5),
        (5, "One two three  four five six seven ", "de", "src9", 3),
        (5, "One two three  four five six seven ", "de", "src9", 3),
        (6, " \t\n\r\x0b\x0c ", "de", "src0", 3),
        (7, "é́ ＡＢ漢字 🎉 İK ſ ß <|endoftext|>tail ▁x  ▁ \x00   end", "xx", "src3", 3),
        (8, "one two three four five six eight", "en", "src0", 3),
        (None, None, None, None, None),
        (9, "x", "en", "src0", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    base = spark.createDataFrame(rows, schema)
    return base.selectExpr("*", "'c' AS score", "1 AS word", "2 AS n", "'k' AS digest", "3 AS row", "4 AS chunk",
                           "'m' AS mix_key", "5 AS label", "'t' AS `TEXT `", "6 AS ids")


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def varied(spark):
    """Some hundred texts from a small vocabulary, with copies and small edits."""
    pick = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "delta.", "don't", "x1", "(y)", "Été", "naïve", "Straße", "42", "--", "we'll"]
    texts = [" ".join(pick.choices(words, k=pick.randint(0, 60))) for _ in range(120)]
    texts += texts[:40] + [t.replace(" ", "  ") for t in texts[:20]] + [t + " more" for t in texts[20:60]]
    return spark.createDataFrame([(i, t, f"src{i % 7}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
