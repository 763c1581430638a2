"""Language identification by Bayesian fusion of evidence.

The text's likelihood under byte-trigram models, one per language, is combined with what the page declares (lang
attribute), what its address ends in or begins its path with, and a prior of its host. Priors are counted from the
text evidence of all rows by grouped aggregation: a host's counts are smoothed by those of its domain, and a domain's
by the whole table, so a host with few rows leans on the levels above. How far declarations and suffixes can be
trusted is counted the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import pick, stash

TABLE = 1 << 16
MAX_ROWS = 4000  # documents of known language that the trigram models read at most, chosen by a hash of doc_id
TEMPER = 0.1  # share of a trigram that counts as independent evidence
MOST = 60.0  # greatest difference of log-likelihoods that the text may claim
SMOOTH = 5.0  # rows that the level above counts for
_TAGS = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
_LANG = r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})"
# What address endings say.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en"}


def _slots(data: bytes) -> np.ndarray:
    b = np.frombuffer(data.lower(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    return (((b[:-2] * 65599 + b[1:-1]) * 65599 + b[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities) of trigram slots, from at most max_rows documents of known language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen = np.bincount(_slots((t.as_py() or "").encode()), minlength=TABLE)
                sums[lang] = sums.get(lang, 0) + seen
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], ["lang", "n"])

    some = pick(docs, "doc_id", "lang").dropna().orderBy(F.xxhash64("doc_id"), "lang").limit(max_rows)
    chosen = stash(pick(docs, "doc_id", "text").join(F.broadcast(some), "doc_id").select("lang", "text"))
    got = chosen.coalesce(16).mapInArrow(run, "lang string, n binary").collect()
    names = sorted({r.lang for r in got})
    counts = np.zeros((len(names), TABLE))
    for r in got:
        counts[names.index(r.lang)] += np.frombuffer(r.n, "<i8")
    return names, np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * TABLE)).astype(np.float32)


def text_posteriors(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Adds ll, the text's tempered log-likelihoods less their greatest, in the order of the languages, and drops text."""
    sent = rows.sparkSession.sparkContext.broadcast(model[1])
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            out = []
            for t in b.column(0):
                s = _slots(_TAGS.sub(" ", t.as_py() or "").encode())
                ll = np.array([float(m[s].sum()) for m in table]) * TEMPER
                out.append(np.maximum(ll - ll.max(initial=-np.inf), -MOST).tolist() if len(s) else [0.0] * len(table))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out, pa.list_(pa.float64()))], [*others, "ll"])

    kinds = dict(rows.dtypes)
    return rows.select("text", *others).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", ll array<double>")


def prepared(docs: DataFrame | None, pages: DataFrame | None) -> DataFrame:
    """Documents and pages as one table (kind, id, host, declared, suffix, text); a document's host is its source."""
    frames = []
    none = F.lit(None).cast("string")
    if docs is not None:
        d = pick(docs, "doc_id", "source", "text")
        frames.append(d.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), F.col("source").alias("host"), none.alias("declared"), none.alias("suffix"), "text"))
    if pages is not None:
        p = pick(pages, "page_id", "url", "html")
        host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
        path = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([a-zA-Z]{2})(?:[/?#]|$)", 1))
        ending = F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), F.regexp_extract(host, r"\.([a-z]+)$", 1))
        declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), _LANG, 1))
        frames.append(p.select(F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), F.nullif(host, F.lit("")).alias("host"), F.nullif(declared, F.lit("")).alias("declared"), F.coalesce(F.nullif(path, F.lit("")), ending).alias("suffix"), F.col("html").alias("text")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """rows as from prepared(): one row each with lang, prob, text_lang and host.

    Null or very short texts leave the decision to the declaration, suffix and host; where all are missing, the whole
    table's share decides. Null hosts share one prior. Ties go to the first language in alphabetical order.
    """
    names, spark = model[0], rows.sparkSession
    if not names:
        return rows.select("kind", "id", "host", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("prob"), F.lit(None).cast("string").alias("text_lang"))
    k, langs = len(names), F.array(*[F.lit(n) for n in names])
    text = stash(text_posteriors(rows, model))
    weight = F.transform("ll", lambda x: F.exp(x))
    share = [F.get(weight, F.lit(i)) / F.aggregate(weight, F.lit(0.0), lambda a, x: a + x) for i in range(k)]
    domain = F.substring_index(F.coalesce("host", F.lit("")), ".", -2)
    seen = text.select("*", domain.alias("domain"), *[share[i].alias(f"p{i}") for i in range(k)])
    sums = [F.sum(f"p{i}").alias(f"p{i}") for i in range(k)]
    whole = seen.agg(*sums).first()
    total = [float(whole[i] or 0) + 1.0 for i in range(k)]
    base = [x / sum(total) for x in total]

    def smoothed(df: DataFrame, above: list, name: str) -> DataFrame:
        n = sum((F.col(f"p{i}") for i in range(1, k)), F.col("p0"))
        return df.withColumn(name, F.array(*[(F.col(f"p{i}") + SMOOTH * above[i]) / (n + SMOOTH) for i in range(k)]))

    hosts = seen.groupBy("domain", F.coalesce("host", F.lit("")).alias("h")).agg(*sums)
    domains = smoothed(hosts.groupBy("domain").agg(*sums), [F.lit(x) for x in base], "above").select("domain", "above")
    priors = smoothed(hosts.join(domains, "domain"), [F.get("above", F.lit(i)) for i in range(k)], "prior").select("h", "prior")
    priors = stash(priors)

    def trust(column: str) -> dict[str, list[float]]:
        """ln P(what is said | language), smoothed, for what is said: a few dozen values, bounded by two or three letters."""
        said = seen.where(F.col(column).isNotNull()).groupBy(column).agg(*sums).collect()
        columns = [sum(r[f"p{i}"] for r in said) for i in range(k)]
        return {r[column]: [float(np.log((r[f"p{i}"] + 0.5) / (columns[i] + 0.5 * (len(said) + 1)))) for i in range(k)] for r in said}

    def term(column: str):
        table = trust(column)
        if not table:
            return F.array(*[F.lit(0.0)] * k)
        said = F.create_map(*[x for key, v in table.items() for x in (F.lit(key), F.array(*[F.lit(y) for y in v]))])
        return F.coalesce(F.element_at(said, F.col(column)), F.array(*[F.lit(0.0)] * k))

    terms = {c: term(c) for c in ("declared", "suffix")}
    joined = text.withColumn("h", F.coalesce("host", F.lit(""))).join(priors, "h")
    full = joined.select("kind", "id", "host", "ll", F.array(*[F.get("ll", F.lit(i)) + F.get(terms["declared"], F.lit(i)) + F.get(terms["suffix"], F.lit(i)) + F.log(F.get("prior", F.lit(i))) for i in range(k)]).alias("s"))
    best = F.array_max("s")
    prob = F.lit(1.0) / F.aggregate(F.transform("s", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, x: a + x)
    lang = F.get(langs, (F.array_position("s", best) - 1).cast("int"))
    text_lang = F.get(langs, (F.array_position("ll", F.array_max("ll")) - 1).cast("int"))
    return full.select("kind", "id", "host", lang.alias("lang"), prob.alias("prob"), text_lang.alias("text_lang"))
