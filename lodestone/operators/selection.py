"""Choosing among candidates: hop prices, picks, ranking of entities, matching of answers, and weights fitted on pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import lexical

GATE, BEAM = 8, 16
WHOLE_WORD = 3  # terms of so many characters match whole tokens only


def hop_price(candidates: DataFrame, ahead: int = 0, gate: int = GATE, beam: int = BEAM, relative: bool = False) -> DataFrame:
    """(src, dst, price) of candidates (src, dst, score, prior).

    Up to `gate` candidates of a node cost their prior and are not ranked. Of more, the `beam` best by score stay, and a prior is
    divided by the place, or if relative by the place as a share of all that were offered.
    """
    mine = Window.partitionBy("src")
    rows = candidates.withColumn("n", F.count("*").over(mine)).withColumn("place", F.row_number().over(mine.orderBy(F.desc("score"), "dst")) - 1)
    steps = F.col("place") * gate / F.col("n") if relative else F.col("place")
    few = F.col("n") <= gate
    price = F.col("prior") / (1 + ahead + F.when(few, F.lit(0)).otherwise(steps))
    return rows.where(few | (F.col("place") < beam)).select("src", "dst", price.alias("price"))


def pick(rows: DataFrame, where: Column, n: int, *order) -> DataFrame:
    """The first n rows in the given order that pass a filter."""
    return rows.where(where).orderBy(*order).limit(n)


def entity_bm25(entities: DataFrame, terms: list[tuple[int, str, int]], n: int = 10) -> DataFrame:
    """(query_id, id, score, rank): the n best entities of each query. entities: (id, fields), fields an array of arrays of tokens.

    A term counts once for each field with a token that holds it; lengths are all tokens. One pass over the entities finds the hits:
    the terms, a few dozen at most, are part of the expression.
    """
    holds = lambda f, t: F.exists(f, lambda x: F.when(F.length(t) <= WHOLE_WORD, x == t).otherwise(F.contains(x, t)))
    asked = F.array(*[F.struct(F.lit(q).alias("query_id"), F.lit(t).alias("term"), F.lit(o).alias("ord")) for q, t, o in terms])
    sized = entities.withColumn("n", F.greatest(F.lit(1), F.aggregate("fields", F.lit(0), lambda a, f: a + F.size(f))))
    found = sized.select("id", "n", F.explode(asked).alias("t"), "fields").select("id", "n", "t.*", F.size(F.filter("fields", lambda f: holds(f, F.col("t.term")))).alias("tf"))
    hits = found.where("tf > 0")
    whole = sized.agg(F.count("*").alias("n_files"), F.avg("n").alias("avg"))
    kept = lexical.scoring_terms(hits.select("query_id", "term", "ord", F.col("id").alias("path")), whole.select("n_files"))
    met = hits.join(F.broadcast(kept.select("query_id", "term", "idf")), ["query_id", "term"]).crossJoin(F.broadcast(whole))
    part = F.col("idf") * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("n") / F.col("avg")))
    scored = met.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def gold_matches(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """(answer_id, gold_id): an answer names a declaration by its symbol, by a line in its span, or by its name.

    answers: (answer_id, symbol, path, line, name), each null where it is not given; gold: (gold_id, symbol, path, first, last, name, bare).
    A name counts where no line is given, in the answer's path if it has one. Four joins by equal keys, no comparison of all pairs.
    """
    key = lambda kind, word: F.struct(F.lit(kind).alias("kind"), word.alias("word"))
    spoken, last = F.lower("name"), F.regexp_extract(F.lower("name"), r"([^:.#/]*)$", 1)
    said = answers.where(F.col("line").isNull() & F.col("name").isNotNull())
    said = said.select("answer_id", "path", F.explode(F.array_distinct(F.array(key("name", spoken), key("bare", spoken), key("bare", last)))).alias("k"))
    known = gold.select("gold_id", F.col("path").alias("gold_path"), F.explode(F.array(key("name", spoken), key("bare", F.lower("bare")))).alias("k"))
    by_symbol = answers.where(F.col("symbol") != "").join(gold.select("gold_id", "symbol"), "symbol")
    by_line = answers.where("line is not null").join(gold.select("gold_id", "path", "first", "last"), "path").where("line between first and last")
    by_path = said.where("path is not null").join(known, (said["path"] == F.col("gold_path")) & (said["k"] == known["k"]))
    by_name = said.where("path is null").join(known, said["k"] == known["k"])
    parts = [d.select("answer_id", "gold_id") for d in (by_symbol, by_line, by_path, by_name)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct()


def pairwise_fit(pairs: DataFrame, features: list[str], l2: float, rounds: int) -> DataFrame:
    """(name, weight): logistic weights under which the differences of features between the better and the worse of a pair are positive.

    Features are scaled to a root mean square of one; each round of gradient descent is one aggregation, the driver holds the weights only.
    A pair's missing difference is 0; features that are 0 throughout are left out.
    """
    spark, d = pairs.sparkSession, pairs.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    scale = d.agg(*[F.sqrt(F.avg(F.col(f) * F.col(f))).alias(f) for f in features]).first()
    used = [f for f in features if scale[f]]
    x, w = d.select(*[(F.col(f) / scale[f]).alias(f) for f in used]), {f: 0.0 for f in used}
    step = 1 / (0.25 * len(used) + l2)
    for _ in range(rounds if used else 0):
        margin = sum((F.col(f) * w[f] for f in used), F.lit(0.0))
        pull = x.withColumn("_pull", 1 / (1 + F.exp(margin))).agg(*[F.avg(F.col("_pull") * F.col(f)).alias(f) for f in used]).first()
        w = {f: w[f] - step * (l2 * w[f] - pull[f]) for f in used}
    return spark.createDataFrame([(f, w[f] / scale[f]) for f in used], "name string, weight double")
