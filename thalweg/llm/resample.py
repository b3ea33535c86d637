"""Importance resampling towards a target corpus, over hashed n-grams (data selection with importance resampling).

Distinct words are mapped to integer ids, n-grams are tuples of ids, and the bytes of each distinct tuple are put together
and hashed once; counts and gains are joined back by tuple. Ids by frequency: the most frequent words and tuples, a
bounded number, are broadcast, so that only rare ones are ever shuffled and no frequent one is a hot key.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.keys import numbered_in_order
from ..shipping import ship
from .common import map_texts, stored, tidy

#: Words in UTF-8 whose A-Z are in lower case.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The most frequent words, and tuples, that are broadcast; of any number beyond, the rest is joined by shuffle.
FREQUENT = 100_000
#: Distinct words that a task counts before it hands its counts on.
COUNTED = 300_000
#: Stands for "no word here" in tuples shorter than the longest.
NONE = -1


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z only."""
    return WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


def count_words(texts: DataFrame) -> DataFrame:
    """texts: (text) -> (word, n); tasks add up what they read before anything is shuffled."""
    ship(texts.sparkSession)

    def run(batches):
        counts = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                if len(counts) > COUNTED:
                    yield flush()
        yield flush()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@tidy
def dictionary(counts: DataFrame, frequent: int = FREQUENT) -> tuple[list[str], DataFrame]:
    """counts: (word, n) -> the `frequent` most frequent words, whose ids are their places, and the table (id, word) of all.

    The others' ids go on from there, in no order; they are written once, with their words.
    """
    counts = stored(counts, "word-counts")
    best = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(frequent).select("word").collect()]
    spark = counts.sparkSession
    top = spark.createDataFrame(pa.table({"id": pa.array(range(len(best)), pa.int64()), "word": pa.array(best, pa.string())}))
    rest = counts.select("word").join(F.broadcast(top.select("word")), "word", "left_anti")
    rest = rest.select((F.monotonically_increasing_id() + len(best)).alias("id"), "word")
    return best, stored(top.unionByName(rest), "dictionary", keep=True)


def encoded(texts: DataFrame, best: list[str]) -> DataFrame:
    """texts: (text, ...) -> the other columns with rid, ids and rare.

    ids: a text's words in order, rare ones as -2, -3, ... for the first, second, ... of the text's own distinct rare words,
    which `rare` lists.
    """
    shared = texts.sparkSession.sparkContext.broadcast({w.encode(): i for i, w in enumerate(best)})

    def start():
        known = shared.value

        def one(text):
            words, rare = words_of(text), {}
            ids = [known.get(w) for w in words]
            for at in [k for k, i in enumerate(ids) if i is None]:
                ids[at] = rare.setdefault(words[at], -2 - len(rare))
            return np.array(ids, np.int64), [w.decode() for w in rare]

        def work(texts):
            found = [one(t) for t in texts]
            ends = np.cumsum([0, *(len(x) for x, _ in found)])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *(x for x, _ in found)]))), [r for _, r in found]

        return work

    carried = {c: F.col(c) for c in texts.columns if c != "text"}
    return stored(map_texts(texts, "text", carried | {"rid": F.monotonically_increasing_id()}, {"ids": "array<bigint>", "rare": "array<string>"}, start), "encoded")


@dataclass(frozen=True)
class Grams:
    """Tuples of up to `most` words as columns g0, g1, ..., shorter ones filled up with NONE."""

    most: int

    @property
    def names(self) -> list[str]:
        return [f"g{k}" for k in range(self.most)]

    def of(self, rows: DataFrame, *keep: str) -> DataFrame:
        """(keep..., g0, ...): a row for each run of 1 to `most` consecutive ids."""
        out = None
        for size in range(1, self.most + 1):
            at = F.sequence(F.lit(1), F.size("ids") - (size - 1))
            runs = F.col("ids") if size == 1 else F.when(F.size("ids") >= size, F.transform(at, lambda i: F.slice("ids", i, size))).otherwise(F.array())
            part = rows.select(*keep, F.explode(runs).alias("g"))
            filled = [F.col("g") if size == 1 and k == 0 else F.get("g", F.lit(k)) if k < size else F.lit(NONE).cast("long") for k in range(self.most)]
            part = part.select(*keep, *[x.alias(n) for x, n in zip(filled, self.names)])
            out = part if out is None else out.unionByName(part)
        return out

    def rare(self) -> Column:
        """Whether a word of the tuple is a rare one that is not looked up yet."""
        return F.least(*self.names, F.lit(0)) < NONE


def _looked_up(grams: Grams, rows: DataFrame, words: DataFrame) -> DataFrame:
    """rows: (rid, side, ids, rare) -> (rid, side, g0, ..., c): the tuples that hold a rare word, by their global ids."""
    with_rare = rows.where(F.size("rare") > 0)
    asked = with_rare.select("rid", F.posexplode("rare").alias("k", "word"))
    found = asked.join(words, "word").groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("known"))
    counted = grams.of(with_rare, "rid", "side").where(grams.rare()).groupBy("rid", "side", *grams.names).agg(F.count(F.lit(1)).alias("c"))
    named = counted.join(found, "rid")
    # each name is replaced in place: select() evaluates all of them on the row as it was
    return named.select("rid", "side", *[F.when(F.col(g) < NONE, F.get("known", (-2 - F.col(g)).cast("int"))).otherwise(F.col(g)).alias(g) for g in grams.names], "c")


def bucket_gains(counts: DataFrame, buckets: int) -> DataFrame:
    """counts: (bucket, s, t) -> (bucket, gain): floor(1000 ln) of the target's smoothed share over the raw one's."""
    whole = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("all_t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * (F.col("all_s") + buckets) / ((s + 1) * (F.col("all_t") + buckets))
    return counts.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


@tidy
def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", max_n: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, min_words: int = 20, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank (all LONG but doc_id, which keeps its type).

    Words are runs of digits, a-z and characters beyond ASCII, A-Z being lower-cased first. Features are all runs of 1 to
    max_n consecutive words joined by one space, repeats counted; a feature's bucket is the CRC-32 of its bytes modulo
    `buckets`. weight: the sum over features of the bucket's gain, floor(1000 ln(smoothed target share / smoothed share in
    docs)). score: weight plus a Gumbel draw in thousandths that depends on seed and doc_id alone. Of the N rows with
    min_words words or more the floor(percent N / 100) of highest score are drawn; ties go to the smaller doc_id, null ones
    last. rank numbers them from 1 and is null for all others.

    Null or empty texts have no features, weight 0. Rows that repeat are rows of their own, with the same score; a null id
    draws like an empty one. Empty docs: no rows; empty target: every gain is that of t = 0. Texts of any length: a task
    holds one text's words at a time.

    Shuffled are distinct words and tuples with their counts, the rare words' tuples of each document, and one row per
    document: never a text, and no frequent word.
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(True).alias("side"))
    aim = target.select(F.lit(None).cast(docs.schema[id_col].dataType).alias("doc_id"), F.col(target_text_col).alias("text"), F.lit(False).alias("side"))
    both = raw.unionByName(aim)
    best, words = dictionary(count_words(both), frequent)
    rows = encoded(both, best)
    grams = Grams(max_n)
    g = grams.names
    rare = stored(_looked_up(grams, rows, words.where(F.col("id") >= len(best))), "rare-tuples")
    of_frequent = grams.of(rows, "side").where(~grams.rare()).groupBy("side", *g).agg(F.count(F.lit(1)).alias("c"))
    every = of_frequent.unionByName(rare.select("side", *g, "c"))
    tuples = stored(every.groupBy(*g).agg(F.sum(F.when(F.col("side"), F.col("c")).otherwise(0)).alias("s"), F.sum(F.when(F.col("side"), 0).otherwise(F.col("c"))).alias("t")), "tuples")
    spelled = tuples
    for k, name in enumerate(g):
        spelled = spelled.join(words.select(F.col("id").alias(name), F.col("word").alias(f"w{k}")), name, "inner" if k == 0 else "left")
    hashed = stored(spelled.select(*g, "s", "t", (F.crc32(F.concat_ws(" ", *[f"w{k}" for k in range(max_n)])) % buckets).alias("bucket")), "hashed")
    # as many rows as there are buckets
    gains = F.broadcast(bucket_gains(hashed.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), buckets))
    gained = stored(hashed.join(gains, "bucket").select(*g, "gain", (F.col("s") + F.col("t")).alias("n")), "tuple-gains")
    top = F.broadcast(gained.orderBy(F.desc("n"), *g).limit(frequent).select(*g, "gain"))
    of_docs = rows.where("side")
    found = grams.of(of_docs, "rid").where(~grams.rare()).join(top, g, "left")
    summed = found.where("gain is not null").groupBy("rid").agg(F.sum("gain").alias("gain"))
    pending = rare.where("side").select("rid", *g, "c")
    if max_n > 1:  # tuples of frequent words may be rare ones; single words are not
        missed = found.where("gain is null").groupBy("rid", *g).agg(F.count(F.lit(1)).alias("c"))
        pending = pending.unionByName(missed)
    summed = summed.unionByName(pending.join(gained, g).select("rid", (F.col("gain") * F.col("c")).alias("gain"))).groupBy("rid").agg(F.sum("gain").alias("weight"))
    n_words = F.size("ids")
    features = sum((F.greatest(n_words - k, F.lit(0)) for k in range(1, max_n)), n_words).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    draw = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = of_docs.select("rid", "doc_id", n_words.alias("n_words"), features.alias("n_features")).join(summed, "rid", "left")
    scored = scored.withColumn("weight", F.coalesce("weight", F.lit(0)).cast("long")).withColumn("score", F.col("weight") + draw)
    scored = stored(scored, "scored", keep=True)
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    ranked = numbered_in_order(able.select("rid", "score", "doc_id"), F.desc("score"), F.asc_nulls_last("doc_id"), "rid", column="rank", start=1)
    ranked = stored(ranked.where(F.col("rank") <= drawn).select("rid", "rank"), "ranks", keep=True)
    return scored.join(ranked, "rid", "left").select("doc_id", "n_features", "weight", "score", "rank")
