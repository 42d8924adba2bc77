import datetime as dt
import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row int, bucket date, tokens string, score string, h int, key int, part string, copies string, bucket_ string"
WORDS = "the of and river stone idea walks under bright signal harbour quiet engine paper north winter glass little orchard seven".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Texts with nulls, blanks, copies, near copies, a very long one, and repeated rows."""
    rng = random.Random(5)
    base = [prose(rng, rng.choice([1, 3, 4, 5, 30, 200])) for _ in range(40)]
    passage = prose(rng, 400)
    body = [*base, *base[:6], base[10] + " extra", base[11].replace("the", "The"), prose(rng, 60) + passage + prose(rng, 50), passage + prose(rng, 80), prose(rng, 30) + "\n" + passage, prose(rng, 40_000)]
    body += ["", None, "   \n\t ", "x", "ÀÉ ß. straße, naïve", "don't <|endoftext|> 12345 6.7 日本 😀", "a\x1cb c", "mail bob.smith@mail.example.com or +1 (555) 555-0100, 10.0.0.1; 4111 1111 1111 1111 and 4111111111111112"]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(body)]
    rows += [rows[3], rows[3], (None, base[5], None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    extra = ("clash", 1, dt.date(2024, 1, 1), "t", "s", 2, 3, "p", "c", "b")
    return spark.createDataFrame([r + extra for r in odd_rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
