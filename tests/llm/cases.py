"""Hard rows that every operator gets: nulls, blanks, very long texts, repeats, clashing columns."""

import random

from pyspark.sql import types as T

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: names that operators use themselves, as further columns of the input
CLASH = ("fp", "key", "a", "b", "n", "node", "cell", "copies", "kept", "ids", "start", "held_out", "score", "verdict", "window", "bucket", "text_key", "fingerprint", "component_id")


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(("ka", "lo", "mi", "ter", "san", "du", "é", "ing")) for _ in range(draw.randint(1, 4))) for _ in range(words))


def rows() -> list[tuple]:
    base = [prose(k, 20 + 7 * k) for k in range(12)]
    texts = [*base, base[3], base[3] + " more", None, "", "  \n\t ", "ab", "日本語 テキスト。", prose(99, 40_000), "password=abcdef123 x", base[5].upper()]
    out = [(k, t, ("en", "fr")[k % 2], f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*out, out[4], (None, base[2], None, None, 5), (40, base[7], "en", None, None)]


def docs(spark, clash: bool = True):
    df = spark.createDataFrame(rows(), DOC).repartition(3)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(1).alias(c) for c in CLASH))
    return df


def empty(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOC))
