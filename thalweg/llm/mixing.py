"""Mixing sources to target weights, in DataFrame operations only.

Words of each source are packed into blocks of fixed length (equal within one word, nothing padded). Output shards draw
multinomial counts of blocks per source; the counts are then settled on each source's quota. The k-th block that the mix
takes from a source is found through that source's pseudorandom permutation of block indexes, and blocks are joined by
index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, field, numbered, sweep, uniform, words

#: Cells that [0, 1) is cut into so that a draw finds its source by an equi-join, whatever the number of sources.
CELLS = 4096
#: Up to so many sources their table is broadcast; beyond that it is joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Documents (expected) of one window when places within a source are summed up.
BUCKET_DOCS = 1_000
#: Places that one window sums up; sums of so many places each are summed up in a second one.
SPAN = 1_024
#: Rounds of the swap-or-not permutation.
ROUNDS = 24


def permuted(index: Column, size: Column, *key) -> Column:
    """The place of index in a pseudorandom permutation of 0..size-1 (swap-or-not; a bijection for every size and key)."""

    def swap(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, i), size) - x, size)
        return F.when(F.xxhash64(*key, i, F.greatest(x, partner)) % 2 == 0, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), index.cast("long"), swap)


def source_targets(sizes: DataFrame, cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """sizes: (source, source_size) -> plus weight and target.

    Sources by code point, null last, weigh 1..cycle, repeating, and share all words by weight; no target exceeds cap
    times its source, and what is over goes to the others by weight until none is above. With sources ordered by
    cap / weight the share per unit of weight that solves this is the largest of the running remainders.
    """
    ranked = sizes.withColumn("weight", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % cycle + 1).withColumn("most", cap * F.col("source_size"))
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = ranked.withColumn("capped", F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).withColumn("left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    unit = rest.withColumn("unit", (F.sum("source_size").over(W.partitionBy()) - F.col("capped")) / F.col("left"))
    return unit.withColumn("target", F.least("most", F.max("unit").over(W.partitionBy()) * F.col("weight"))).select("source", "source_size", "weight", "target")


def sums_before(sums: DataFrame, place: str) -> DataFrame:
    """sums: (source, place, n), a row for each source and place -> (s, p, before): n over the source's earlier places.

    In two levels, so that no window holds all places of a source, however large its share.
    """
    spans = sums.withColumn("span", F.floor(F.col(place) / SPAN))
    per = spans.groupBy("source", "span").agg(F.sum("n").alias("n"))
    ahead = per.select(F.col("source").alias("s"), F.col("span").alias("at"), (F.sum("n").over(W.partitionBy("source").orderBy("span")) - F.col("n")).alias("ahead"))
    inside = spans.select("source", "span", F.col(place).alias("p"), (F.sum("n").over(W.partitionBy("source", "span").orderBy(place)) - F.col("n")).alias("inside"))
    return durable(inside.join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("span") == F.col("at"))).select("s", "p", (F.col("ahead") + F.col("inside")).alias("before")))


class Mixture:
    """A mix of docs.

    Texts without words take no part; null sources are a source of their own, the last; a source without words has
    target 0. Repeated rows are separate documents. An empty table gives an empty mix. No block is taken more than
    ceil(cap) times, so no document is either.

    Rows are numbered once and stored, for summary() with id, source and size alone. documents() needs them with their
    payload: with_documents stores that, too.
    """

    def __init__(self, docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", block_words=256, min_blocks=256, shard_blocks=4096, cap=3.0, seed=0, with_documents=False):
        self.given = {"docs": docs, "id_col": id_col, "text_col": text_col, "source_col": source_col, "block_words": block_words, "min_blocks": min_blocks, "shard_blocks": shard_blocks, "cap": cap, "seed": seed}
        self.docs, self.seed, self.text_col = docs, seed, text_col
        self.stored = numbered(docs, "mix-docs") if with_documents else None
        if with_documents:
            rid, by_id, text, source, rows = F.col("rid"), *(field("row", c) for c in (id_col, text_col, source_col)), self.stored
        else:
            rid, by_id, text, source, rows = F.monotonically_increasing_id(), *(F.col(c) for c in (id_col, text_col, source_col)), docs
        self.meta = durable(rows.select(rid.alias("rid"), by_id.alias("doc_id"), source.cast("string").alias("source"), words(text).alias("size"), F.xxhash64(by_id, text).alias("key")))
        sizes = self.meta.groupBy("source").agg(F.sum("size").alias("source_size"))
        size = F.col("source_size")
        blocks = F.greatest(F.ceil(size / block_words), F.least(size, F.lit(min_blocks)))
        quota = F.when(size > 0, F.round(F.col("target") * F.col("blocks") / size)).otherwise(0).cast("long")
        self.sources = durable(source_targets(sizes, cap).withColumn("blocks", blocks.cast("long")).withColumn("quota", quota))
        sweep(docs.sparkSession)
        self.n_buckets = max(1, -(-self.meta.count() // BUCKET_DOCS))
        self.n_slots, n_sources = (x or 0 for x in self.sources.agg(F.sum("quota"), F.count(F.lit(1))).first())
        self.small = F.broadcast if n_sources <= BROADCAST_SOURCES else lambda df: df
        self.shard_blocks = shard_blocks

    def slots(self) -> DataFrame:
        """(shard, slot, source, k): every place of the mix with the source it holds and the how-manieth of it, from 0."""
        n = max(1, self.n_slots)
        share = W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
        spans = self.sources.where("quota > 0").withColumn("hi", F.sum("quota").over(share)).select("source", "quota", ((F.col("hi") - F.col("quota")) / n).alias("lo"), (F.col("hi") / n).alias("hi"))
        cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
        slots = self.docs.sparkSession.range(self.n_slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / self.shard_blocks).alias("shard"), uniform(self.seed, F.lit("slot"), F.col("id")).alias("u"))
        drawn = slots.withColumn("cell", F.floor(F.col("u") * CELLS)).join(self.small(cells), "cell").where("u >= lo and u < hi").select("slot", "shard", "source", "quota")
        counts = durable(drawn.groupBy("source", "shard").agg(F.count(F.lit(1)).alias("n")))
        before = sums_before(counts, "shard")
        ranked = drawn.withColumn("r", F.row_number().over(W.partitionBy("shard", "source").orderBy("slot")) - 1)
        ranked = ranked.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("p"))).select("slot", "shard", "source", "quota", (F.col("r") + F.col("before")).alias("k"))
        # A source drawn beyond its quota hands its last slots to those drawn short of theirs, in order.
        total = counts.groupBy("source").agg(F.sum("n").alias("n")).select(F.col("source").alias("s"), "n")
        balance = self.sources.where("quota > 0").join(self.small(total), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "quota", F.coalesce("n", F.lit(0)).alias("n"))
        lines = W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
        over = balance.where("n > quota").select(F.col("source").alias("s"), F.coalesce(F.sum(F.col("n") - F.col("quota")).over(lines), F.lit(0)).alias("first"))
        short = balance.where("n < quota").withColumn("first", F.coalesce(F.sum(F.col("quota") - F.col("n")).over(lines), F.lit(0)))
        short = short.select(F.col("source").alias("to"), "n", "first", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("quota") - F.col("n") - 1)).alias("f"))
        spare = ranked.where("k >= quota").join(self.small(over), F.col("source").eqNullSafe(F.col("s"))).withColumn("f", F.col("first") + F.col("k") - F.col("quota")).drop("first")
        moved = spare.join(short, "f").select("slot", "shard", F.col("to").alias("source"), (F.col("n") + F.col("f") - F.col("first")).alias("k"))
        return ranked.where("k < quota").select("slot", "shard", "source", "k").unionByName(moved)

    def blocks_taken(self) -> DataFrame:
        """(slot, shard, source, epoch, block): the block that each place holds; within an epoch no block comes twice."""
        by = self.sources.select(F.col("source").alias("s"), "blocks")
        found = self.slots().join(self.small(by), F.col("source").eqNullSafe(F.col("s"))).withColumn("epoch", F.floor(F.col("k") / F.col("blocks")))
        return durable(found.select("slot", "shard", "source", "epoch", permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.lit(self.seed), F.col("source"), F.col("epoch")).alias("block")))

    def pieces(self) -> DataFrame:
        """(rid, source, block, first, n_words): the words, counted from 0 in the document, that lie in each block.

        A document's place in its source is a running sum kept per source and bucket of a hash of id and text, offset by the
        sums of the buckets before: no window holds more than a bucket, and the order does not depend on how rows are stored
        (row numbers only tell equal rows apart).
        """
        sized = self.meta.where("size > 0").withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 20), F.lit(self.n_buckets)))
        per = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
        before = sums_before(per, "bucket")
        here = sized.withColumn("at", F.sum("size").over(W.partitionBy("source", "bucket").orderBy("key", "doc_id", "rid").rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        here = here.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("p"))).select("rid", "source", "size", (F.col("at") + F.col("before")).alias("at"))
        by = self.sources.where("blocks > 0").select(F.col("source").alias("s"), F.expr("source_size div blocks").alias("q"), (F.col("source_size") % F.col("blocks")).alias("r"))
        here = here.join(self.small(by), F.col("source").eqNullSafe(F.col("s")))

        def block(x: str) -> str:
            return f"if({x} < r * (q + 1), ({x}) div (q + 1), r + ({x} - r * (q + 1)) div q)"

        cut = here.withColumn("block", F.explode(F.sequence(F.expr(block("at")), F.expr(block("at + size - 1")))))
        start, end = F.expr("greatest(at, block * q + least(block, r))"), F.expr("least(at + size, (block + 1) * q + least(block + 1, r))")
        return cut.select("rid", "source", "block", (start - F.col("at")).alias("first"), (end - start).alias("n_words"))

    def taken(self) -> DataFrame:
        """(rid, taken): words that the mix takes from each document, repeats counted."""
        uses = self.blocks_taken().groupBy("source", "block").agg(F.count(F.lit(1)).alias("uses")).select(F.col("source").alias("s"), F.col("block").alias("b"), "uses")
        joined = self.pieces().join(uses, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
        return joined.groupBy("rid").agg(F.sum(F.col("uses") * F.col("n_words")).alias("taken"))

    def summary(self) -> DataFrame:
        """One row per document: doc_id, size, source_size, target (of its source), taken, source."""
        by = self.sources.select(F.col("source").alias("s"), "source_size", "target")
        out = self.meta.join(self.taken(), "rid", "left").join(self.small(by), F.col("source").eqNullSafe(F.col("s")))
        return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")

    def documents(self) -> DataFrame:
        """The mix as documents: for each document and epoch a row whose text is the words taken, in order, with the white
        space around them; all words taken: the text unchanged. Other columns are as they were; n_chars, where there is
        such a column, is that of the new text."""
        if self.stored is None:
            return Mixture(**self.given, with_documents=True).documents()
        at = self.blocks_taken().select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch")
        used = self.pieces().join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
        ranges = used.groupBy("rid", "epoch").agg(F.array_sort(F.collect_list(F.struct("first", "n_words"))).alias("ranges"), F.sum("n_words").alias("n")).drop("epoch")
        columns = {c: f"c{i}" for i, c in enumerate(self.docs.columns)}
        flat = self.stored.select("rid", field("row", self.text_col).alias("whole"), *[field("row", c).alias(n) for c, n in columns.items()])
        got = flat.join(ranges, "rid").join(self.meta.select("rid", "size"), "rid")
        whole = F.col("whole")
        # exploding an array of one makes the split text a column that is computed once for each row
        pieces = F.when(F.col("n") < F.col("size"), F.regexp_extract_all(whole, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+\z)?"), F.lit(0)))
        got = got.withColumn("words", F.explode(F.array(pieces)))
        parts = F.transform("ranges", lambda r: F.array_join(F.slice("words", r["first"].cast("int") + 1, r["n_words"].cast("int")), ""))
        text = F.when(F.col("words").isNull(), whole).otherwise(F.array_join(parts, ""))
        got = got.withColumn("mixed", F.explode(F.array(text)))
        new = {self.text_col.lower(): F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
        return got.select(*[new.get(c.lower(), F.col(n)).alias(c) for c, n in columns.items()])
