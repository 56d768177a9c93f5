"""Small tables with the awkward cases that every operator must take."""

import random

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    syllables = "th an er ing on re en at es or ti st nd to ea".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward(spark):
    """Null, empty, blank and very long texts, null ids and languages, repeated rows and ties."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    rows = [(i, prose(rng, 80), "en", "s", 1) for i in range(12)]
    rows += [(12, None, "en", None, None), (13, "", None, "s", 0), (14, " \n\t ", "en", "s", 4), (15, long, "en", "s", len(long)), (16, "x" * 50_000, "en", "s", 50_000)]
    rows += [(None, rows[0][1], "en", "s", 1), (None, None, None, None, None), rows[1], rows[1], (17, rows[1][1], "en", "s", 1), (18, "ünïcødé 日本語 \U0001f600 ok", "de", "s", 1), (19, "12 34 !! 56", "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


def crowded(df):
    """The same rows with columns named like what operators add."""
    from pyspark.sql import functions as F

    names = "ids decoded n_tokens spans score kept fp fingerprint component_id lang_pred base_failed n_words rejected_by part start group label links _text a b n".split()
    return df.select("*", *(F.lit(7).alias(n) for n in names))
