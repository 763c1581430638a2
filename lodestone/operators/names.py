"""Names and the questions about them: declarations, overlaps, history, spellings, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != ""))


def declared(names: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """(query, id, class, place): names spelt as asked (class 0) before those that differ in case (class 1). asked: a few rows (query)."""
    rows = names.join(F.broadcast(asked), F.lower("name") == F.lower("query")).withColumn("class", F.when(F.col("name") == F.col("query"), 0).otherwise(1).cast("long"))
    order = Window.partitionBy("query").orderBy("class", "id")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit).select("query", "id", "class", "place")


def overlap(names: DataFrame, question: str) -> DataFrame:
    """(id, shared, plain, weighted): tokens of the question in a name; their share of all, and of the idf of those that occur in any name."""
    wanted = [w for w in dict.fromkeys(question.lower().split())]
    rows = names.select("id", tokens(F.col("name")).alias("t"))
    total = rows.agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("t", w)).alias(f"df{i}") for i, w in enumerate(wanted)])
    idf = [F.when(F.col(f"df{i}") > 0, F.log(1 + F.col("n") / F.col(f"df{i}"))).otherwise(0.0) for i in range(len(wanted))]
    total = total.select(*[x.alias(f"idf{i}") for i, x in enumerate(idf)])  # one row
    has = [F.array_contains("t", w) for w in wanted]
    shared = sum((h.cast("long") for h in has), F.lit(0).cast("long"))
    got = sum((F.when(h, F.col(f"idf{i}")).otherwise(0.0) for i, h in enumerate(has)), F.lit(0.0))
    whole = sum((F.col(f"idf{i}") for i in range(len(wanted))), F.lit(0.0))
    scored = rows.crossJoin(F.broadcast(total)).select("id", shared.alias("shared"), F.round(shared / len(wanted), 6).alias("plain"), F.round(F.when(whole > 0, got / whole).otherwise(0.0), 6).alias("weighted"))
    return scored.where("shared > 0")


def history(rows: DataFrame, wanted: list[str], k: int) -> DataFrame:
    """(commit, matched, place): commits by how many of the tokens they match, then newest, then by name. rows: (commit, day, token)."""
    found = rows.where(F.col("token").isin(wanted)).groupBy("commit").agg(F.countDistinct("token").alias("matched"), F.max("day").alias("day"))
    order = [F.desc("matched"), F.desc("day"), F.col("commit")]
    return found.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select("commit", "matched", "place")


def spellings(term: Column) -> Column:
    """The term in lower case, with a first capital, in capitals, and as it was written."""
    low = F.lower(term)
    return F.array_distinct(F.array(low, F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 30)), F.upper(term), term))


def identifiers(text: Column) -> Column:
    """Identifiers in source order, repeats kept."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
