"""Which words contain which tokens, by an index of letter groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 4


def grams(text: Column, width: int = WIDTH) -> Column:
    """Distinct substrings of ``width`` letters; none of a shorter text."""
    at = F.when(F.length(text) >= width, F.sequence(F.lit(1), F.length(text) - width + 1))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(width))))


def contained(tokens: DataFrame, words: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tokens(by, w), words(by, word) -> by, w, word: every token of at least ``WIDTH`` letters in every word of its group that holds it.

    A token is looked up by one of its letter groups and what is found is compared letter by letter; no token meets all words. Inside
    groups (``by``) it is the one with the least hash; over all words at once the one that the fewest words have, and a token
    with a letter group that no word has is left out before.
    """
    by = by or []
    posting = words.select(*by, "word").distinct().select(*by, "word", F.explode(grams(F.col("word"))).alias("gram"))
    asked = tokens.select(*by, "w").distinct().withColumn("_grams", grams(F.col("w")))
    if by:
        least = F.array_min(F.transform("_grams", lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("gram"))))
        best = asked.select(*by, "w", least["gram"].alias("gram"))
    else:
        asked = asked.select("w", F.size("_grams").alias("size"), F.explode("_grams").alias("gram"))
        often = posting.groupBy("gram").agg(F.count("*").alias("n"))
        best = asked.join(often, "gram").groupBy("w", "size").agg(F.count("*").alias("found"), F.min(F.struct("n", "gram")).alias("least"))
        best = best.filter("found = size").select("w", F.col("least.gram").alias("gram"))
    return best.join(posting, [*by, "gram"]).filter(F.col("word").contains(F.col("w"))).select(*by, "w", "word")
