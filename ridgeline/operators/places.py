"""Address search for many texts at once: an inverted index of letter groups over the names of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.graph import best_of
from ridgeline.operators.profiles import ADDRESSES

# Characters of a text that is searched for.
LEAST, MOST = 2, 200


def grams(text: Column, size: int) -> Column:
    """The distinct groups of ``size`` characters of a text."""
    last = F.char_length(text) - (size - 1)
    return F.array_distinct(F.transform(F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, size)))


def name_index(places: DataFrame, name: str = "name") -> DataFrame:
    """(gram, id, name): every place under each group of two and three characters of its lower-case name."""
    named = places.where(F.col(name).isNotNull()).select("id", F.col(name).alias("name")).withColumn("_said", F.lower("name"))
    own = F.array_union(grams(F.col("_said"), 2), grams(F.col("_said"), 3))
    return named.withColumn("gram", F.explode(own)).drop("_said")


def search_all(queries: DataFrame, places: DataFrame, most: int = ADDRESSES, key: str = "query_id", text: str = "text") -> DataFrame:
    """(key, id, name, rank): for every query the places whose name holds its text, shortest names first, then by name and id.

    queries: key, text. places: id, name. Texts are trimmed, case plays no part, and texts below 2 or
    above 200 characters find nothing, nor do null ones. Equal texts are searched once. A text meets
    only the places under its rarest group of characters, so the work follows the rarest part of what
    is asked, not the number of places; names are compared in full afterwards.
    """
    said = F.lower(F.trim(F.col(text)))
    asked = queries.select(key, said.alias("said")).where(F.char_length("said").between(LEAST, MOST))
    texts = asked.select("said").distinct()
    index = name_index(places)
    held = index.groupBy("gram").agg(F.count("*").alias("n"))
    own = F.when(F.char_length("said") == 2, grams(F.col("said"), 2)).otherwise(grams(F.col("said"), 3))
    parts = texts.withColumn("gram", F.explode(own)).join(held, "gram", "left")
    # a group that no name has leaves its text without a place
    rare = parts.groupBy("said").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("said", F.col("r.gram").alias("gram"))
    found = rare.join(index, "gram").where(F.contains(F.lower("name"), F.col("said"))).select("said", "id", "name")
    best = best_of(found, Window.partitionBy("said").orderBy(F.char_length("name"), "name", "id"), most)
    return asked.join(best, "said").select(key, "id", "name", "rank")
