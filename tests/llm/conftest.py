import pytest

#: Columns that documents may have besides, under names the operators use inside.
CLASHING = ["size", "kept", "fp", "digest", "uid", "part", "n", "root", "copies", "target", "units", "host", "score", "start", "label"]


def documents(spark, rows):
    """rows of (doc_id, text, lang, source); clashing columns are added."""
    extra = ", ".join(f"{c} string" for c in CLASHING)
    data = [(*r, len(r[1] or ""), *[f"own {c}" for c in CLASHING]) for r in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


WORDS = "the of and to in is it that for was on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "ly", "er", "ing", "est", "ness", "ful"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, a hot text."""
    rows = [(i, prose(i, 60 + i), "en", f"s{i % 3}") for i in range(12)]
    rows += [(20, None, None, None), (21, "", "en", "s0"), (22, " \n\t", "en", "s1"), (None, "no id here", "en", "s2"), (None, "no id here", "en", None)]
    rows += [(30, prose(3, 63), "en", "s1"), (30, prose(3, 63), "en", "s1"), (31, prose(3, 63).upper(), "en", "s2"), (30, prose(77, 80), "en", "s1")]
    rows += [(40, prose(40, 9000), "en", "s0"), (41, "É\u00a0é ÉÉ a\u2003b <|endoftext|> İ", "fr", "s0"), (42, "word", "en", "s1")]
    rows += [(100 + i, "same text again", "en", "s0") for i in range(15)]
    return documents(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])
