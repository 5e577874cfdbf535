"""Small tables for the text operators."""

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and to in that is was for with as on be at by this had not are but from or have an they which one you were her all".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
}


def prose(seed: int, n: int, lang: str = "en", rare: int = 4000) -> str:
    """Invented text: common words of a language among words that hardly repeat."""
    r = random.Random(seed)
    syllables = ("ing", "tion", "er", "th", "ou", "ly", "st") if lang == "en" else ("ung", "heit", "sch", "ein", "ver", "lich", "ä")
    words = [r.choice(WORDS[lang]) if r.random() < 0.4 else "".join(r.choice(syllables) for _ in range(r.randint(1, 4))) + str(r.randint(0, rare)) * (r.random() < 0.1) for _ in range(n)]
    for k in range(11, n, 12):
        words[k] += "."
    return " ".join(words)


def edge_rows() -> list[tuple]:
    long_text = prose(1, 30_000)
    base = prose(2, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base, "en", "b", 5), (2, base, "en", "b", 5), (3, " ".join(near), "en", "a", None), (4, None, None, None, None), (5, "", "en", "a", 0),
        (6, " \n\t ", "en", "a", 3), (7, "x", "en", None, 1), (8, "one two three four", "en", "a", 18), (9, long_text, "en", "b", 9),
        (None, prose(3, 80), "de", "a", 1), (None, None, None, None, None), (10, prose(4, 90, "de"), "de", "c", 1), (10, prose(4, 90, "de"), "de", "c", 1),
        (11, "same line\n" * 40, "en", "a", 1), (12, "漢字かな交じり文 😀 été\x00null", "en", "", 1), (13, "12345 ½ 67 !!", "en", "a", 1),
        (14, "blanks   in\u00a0between\u2581marks    end ", "en", "a", 1), (15, "a" * 5000, "en", "a", 1), (1, base, "en", "b", 5),
    ]


def edges(spark: SparkSession) -> DataFrame:
    """Nulls, empty and long texts, repeated rows and ties."""
    return spark.createDataFrame(edge_rows(), DOCS)


def clashing(df: DataFrame) -> DataFrame:
    """Extra columns named like those that operators use inside."""
    names = "id key h n size row sig node copies _id _k _key _spans spans part region place source_size target shard slot k _n a b m".split()
    return df.select("*", *(F.lit(f"extra {c}").alias(c) for c in names))


def table_dir(tmp_path_factory, **tables: DataFrame) -> str:
    folder = tmp_path_factory.mktemp("tables")
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
