import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Words of a made-up language.
SYLLABLES = "the ra on li ver est ka mo sun ti per al no ge".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


ODD_TEXTS = [None, "", " \t\n ", "one", "a b c", "Ünï cödé ß 漢字 ​ x", "<|endoftext|> it's 12½ <|startoftext|>", "\x00\x01 tab\tline\nend\r\n", "same same same same same same same same", "é́ decomposed é"]


def odd_rows():
    """Nulls in any column, empty and odd texts, repeated rows, one very long text."""
    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, "one", None, None, None), (None, "no id", "en", "s", 5), (None, None, None, None, None), (50, prose(1, 12_000), "en", "s", 1)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def with_clashes(df):
    """Further columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    names = "words lines n windows h pos sig spans found id key hub component part bands sketch shard _row _score _gone _hit _cut_id _cut_sig _cut_spans text2 html score".split()
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
