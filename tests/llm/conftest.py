import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and thing these other weather mother further then with".split(), "fr": "le de que éàne çois être leur nous où étrange façon".split()}


def prose(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "", "", ".", ",", "s"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and long texts, copies, near copies, repeated rows, shared passages."""
    rnd = random.Random(5)
    rows = []
    passage = prose(rnd, "en", 40)
    for k in range(60):
        lang = "en" if k % 3 else "fr"
        rows.append((k, prose(rnd, lang, rnd.randrange(1, 120)), lang, f"s{k % 4}", 1))
    for k in (3, 9, 20, 41):
        rows[k] = (k, rows[k][1] + "\n" + passage + " tail" * (k % 3), *rows[k][2:])
    rows += [(100 + k, rows[7][1], "en", "s1", 1) for k in range(12)]  # exact copies
    rows += [(130 + k, passage + f" x{k} " + rows[8][1] * 3, "en", "s1", 1) for k in range(6)]  # near copies
    rows += [
        (200, None, "en", "s1", 1), (201, "", "fr", "s2", 1), (202, " \n\t ", None, None, None), (203, "123 !!", "en", None, 1), (204, "word", None, "s0", 1),
        (205, "a " * 30_000 + passage, "en", "s0", 1), (206, "=" * 5000 + "\n" + "=" * 5000, "en", "s0", 1), (207, "</s>[INST] x \\ <|end|>\U0001F600 é", "fr", "", 1),
        (208, "Same line\nSame line\nother\nSame line", "en", "s9", 1), (None, "no name here at all", "en", "s9", 1), (None, None, None, None, None),
        (209, passage, "en", "s3", 1), (209, passage, "en", "s3", 1), (210, "x y　z\x1cw\x85v", "en", "s3", 1),
    ]
    return rows


CLASHING = "size target row id digest key n lang_pred words share place bucket run head part p w fp root content salt prefix kind start src".split()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows, with extra columns of names that operators may use inside."""
    df = spark.createDataFrame(odd_rows, SCHEMA).repartition(5)
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING]).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
