import random

import pytest

WORDS = {
    "en": "the of and house water people little green under morning window".split(),
    "de": "der und nicht straße über wasser kleine grüne fenster morgen häuser".split(),
    "fr": "le les été maison eau petite fenêtre verte matin où garçon".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + (rng.choice(WORDS[lang]) if rng.random() < 0.4 else "") for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, null and empty texts, one long text and a clashing extra column."""
    rng = random.Random(7)
    out = []
    for i in range(60):
        lang = "en de fr".split()[i % 3]
        text = "\n".join(prose(rng, lang, rng.randint(3, 40)) + "." for _ in range(rng.randint(1, 4)))
        out.append((i, text, lang, "s", len(text), 0.5))
    out += [(60, None, "en", None, None, None), (61, "", "en", "s", 0, 0.0), (62, "12 %% 34", None, "s", 8, 0.0)]
    out += [(63 + k, out[3][1], "en", "s", 0, 0.0) for k in range(5)]
    words = out[4][1].split(" ")
    words[len(words) // 2] = "changed"
    out.append((70, " ".join(words), "de", "s", 0, 0.0))
    out.append((71, prose(rng, "en", 9000), "en", "s", 0, 0.0))
    out.append((71, prose(rng, "en", 12), "en", "s", 0, 0.0))  # a repeated id
    return out


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
