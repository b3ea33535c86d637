"""Benchmark decontamination by greedy string tiling (Wise's Running Karp-Rabin Greedy String Tiling).

Words that documents and benchmark items share in runs of five are the seeds. For each document and item that share
enough seeds, tiles are laid: repeatedly the longest matches of unmarked words, found by Karp-Rabin hashes, are marked in
both, so a passage whose parts were moved about is covered as well as one in order. A document that covers enough of an
item is contaminated.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import UPPER, durable, field, map_texts, numbered

MIN_TILE, COVERAGE = 5, 0.8
#: A benchmark of up to so many characters is broadcast (its index takes about 5 bytes a character); a larger one is joined
#: by seed.
BROADCAST_CHARS = 8_000_000
#: Bytes as words see them: A-Z in lower case, ASCII punctuation and controls as white space, the rest as it is.
FOLD = bytes((c + 32 if chr(c) in UPPER else c if c > 127 or chr(c).isalnum() else 32) for c in range(256))
#: Shares of words that differ by less are equal.
SLACK = 1e-12
_SEED = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> np.ndarray:
    """A 64-bit hash of each word."""
    return pd.util.hash_array(np.array([*text.encode("utf-8", "replace").translate(FOLD).split(), None], object), categorize=False)[:-1]


class _Windows:
    """Karp-Rabin hashes of all windows of a length, by prefix sums modulo 2**64."""

    _base = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __init__(self, words: np.ndarray):
        if len(words) >= len(self._base[0]):
            n = 2 * len(words) + 64
            for k, b in enumerate((0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 2**64))):
                self._base[k] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, b, np.uint64), dtype=np.uint64)))
        up, down = self._base
        self.sums, self.up = np.concatenate(([np.uint64(0)], np.cumsum(words * down[: len(words)], dtype=np.uint64))), up

    def free(self, unmarked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each window without a marked word."""
        marked = np.concatenate(([0], np.cumsum(~unmarked)))
        at = np.flatnonzero(marked[size:] == marked[: len(marked) - size]) if len(unmarked) >= size else np.zeros(0, np.int64)
        return at, (self.sums[at + size] - self.sums[at]) * self.up[at]


def _longest_run(free: np.ndarray) -> int:
    ends = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
    return int((ends[1::2] - ends[::2]).max(initial=0))


def tile(pattern: np.ndarray, text: np.ndarray, min_tile: int = MIN_TILE, free: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (start in pattern, start in text, length), none overlapping another on either side: always the longest match
    of unmarked words, of equal ones the first in the pattern, then in the text.

    free: words of the text that may be matched. The longest common length is found by bisection (what matches at one
    length does at every shorter one), and all tiles of that length are laid before shorter ones are looked for. Every step
    is linear, or sorts, whatever words repeat.
    """
    pattern, text = np.asarray(pattern, np.uint64), np.asarray(text, np.uint64)
    free_p, free_t = np.ones(len(pattern), bool), np.ones(len(text), bool) if free is None else free.copy()
    of_p, of_t, tiles = _Windows(pattern), _Windows(text), []

    def common(size):
        (at, h), (to, g) = of_p.free(free_p, size), of_t.free(free_t, size)
        hit = np.isin(h, g)
        return at[hit], h[hit], to, g

    bound = len(pattern)
    while (bound := min(bound, _longest_run(free_p), _longest_run(free_t))) >= min_tile:
        low, high, found = min_tile - 1, bound, None
        size = high
        while low < high:
            if len((now := common(size))[0]):
                low, found = size, now
            else:
                high = size - 1
            size = (low + high + 1) // 2
        if found is None:
            break
        size, (at, h, to, g) = low, found
        inside = np.isin(g, h)
        to, g = to[inside], g[inside]
        order = np.lexsort((to, g))
        to, g = to[order], g[order]
        first = dict(zip(*(x.tolist() for x in np.unique(g, return_index=True))))
        end = -1
        for p, key in zip(at.tolist(), h.tolist()):
            if p < end:
                continue
            k = first[key]
            while k < len(g) and g[k] == key and not free_t[to[k] : to[k] + size].all():
                k += 1
            first[key] = k
            while k < len(g) and g[k] == key and not (free_t[to[k] : to[k] + size].all() and (pattern[p : p + size] == text[to[k] : to[k] + size]).all()):
                k += 1
            if k < len(g) and g[k] == key:
                t = int(to[k])
                free_p[p : p + size] = free_t[t : t + size] = False
                tiles.append((p, t, size))
                end = p + size
        bound = size - 1
    return tiles


def seeds(words: np.ndarray, size: int = MIN_TILE) -> np.ndarray:
    """A hash of each `size` consecutive words."""
    n = len(words) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        h = h * _SEED + words[k : k + n]
    return h


class Benchmark:
    """Items as word hashes, and every place of every seed, in arrays sorted by seed."""

    def __init__(self, items: list[tuple[int, str]], min_tile: int = MIN_TILE, threshold: float = COVERAGE):
        self.min_tile, self.threshold, self.ids, self.words = min_tile, threshold, [], []
        for item_id, text in items:
            words = tokens(text or "")
            if item_id is not None and len(words) >= min_tile:
                self.ids.append(item_id), self.words.append(words)
        lengths = [len(w) - min_tile + 1 for w in self.words]
        h = np.concatenate([np.zeros(0, np.uint64), *(seeds(w, min_tile) for w in self.words)])
        version, place = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in lengths)])
        order = np.argsort(h, kind="stable")
        self.version, self.place = version[order], place[order]
        self.known, self.start = np.unique(h[order], return_index=True)
        self.start = np.append(self.start, len(h))

    def coverage(self, text: str) -> list[tuple[int, float, int]]:
        """(item, share of its words that tiles cover, tiles), by item: all items covered to the threshold at least, and
        the one covered most; others that share seeds may be left out."""
        if not len(self.known) or not (h := seeds(words := tokens(text), self.min_tile)).size:
            return []
        k = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        at = np.flatnonzero(self.known[k] == h)
        if not len(at):
            return []
        k = k[at]
        shared = np.unique(k)
        size = self.start[shared + 1] - self.start[shared]
        rows = np.repeat(self.start[shared] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        seed, version, place = np.repeat(shared, size), self.version[rows], self.place[rows]
        order = np.lexsort((place, version))
        seed, version, place = seed[order], version[order], place[order]
        # tiles cover only what lies under shared seeds, so that is the most that an item can be covered
        same = np.append(version[1:] == version[:-1], False)
        ahead = np.where(same, np.minimum(self.min_tile, np.append(place[1:], 0) - place), self.min_tile)
        cuts = np.flatnonzero(np.append(True, ~same[:-1]))
        most = np.add.reduceat(ahead, cuts) / np.array([len(self.words[v]) for v in version[cuts]])
        ends, top, first, found = np.append(cuts[1:], len(version)), 0.0, None, {}
        ids = [self.ids[v] for v in version[cuts].tolist()]
        for j in sorted(range(len(ids)), key=lambda j: (-most[j], ids[j])):
            if most[j] < self.threshold - SLACK and not could_be_best(most[j], ids[j], top, first):
                if most[j] < top - SLACK:
                    break
                continue
            here = at[np.isin(k, seed[cuts[j] : ends[j]])]
            share, tiles = covered(self.words[version[cuts[j]]], here, words, self.min_tile)
            found[ids[j]] = max(found.get(ids[j], (0.0, 0)), (share, tiles))
            if first is None or share > top or (share == top and ids[j] < first):
                top, first = share, ids[j]
        return [(i, *found[i]) for i in sorted(found)]


def could_be_best(most: float, item: int, top: float, first: int | None) -> bool:
    """Whether an item covered to `most` at most may be covered more than the best so far, or as much with a smaller id."""
    return first is None or most > top + SLACK or (most >= top - SLACK and item < first)


def covered(pattern: np.ndarray, at: np.ndarray, words: np.ndarray, min_tile: int) -> tuple[float, int]:
    """(share, tiles) of a pattern by the words of a document under its seeds, which begin at the places `at`."""
    under = np.zeros(len(words) + 1, np.int64)
    np.add.at(under, at, 1), np.add.at(under, at + min_tile, -1)
    free = np.cumsum(under)[:-1] > 0
    keep = free | np.append(free[1:], False)  # a barred word stays ahead of each stretch
    tiles = tile(pattern, words[keep], min_tile, free[keep])
    return sum(n for _, _, n in tiles) / len(pattern), len(tiles)


VERDICT = {"n_items": "long", "coverage": "double", "n_tiles": "long", "item_ids": "array<bigint>", "contaminated": "boolean"}


def _verdict(found: list[tuple[int, float, int]], threshold: float) -> tuple:
    hit = [x for x in found if x[1] >= threshold]
    best = max(found, key=lambda x: x[1], default=(None, 0.0, 0))
    return len(hit), best[1], best[2], [x[0] for x in hit], bool(hit)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = COVERAGE, min_tile: int = MIN_TILE, broadcast_chars: int = BROADCAST_CHARS, more: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, the columns of `more` (name -> column), n_items, coverage, n_tiles, item_ids, contaminated.

    Words ignore case (A-Z) and ASCII punctuation. n_items and item_ids (LONG, ascending) are the items of which tiles of
    at least min_tile words cover threshold or more; coverage and n_tiles are those of the item covered most (ties: the
    smallest id), 0 where no item shares min_tile words.
    Null or empty text: clean. Items without an id, or of fewer than min_tile words, match nothing; repeated item ids are
    versions, the best covered counts. Repeated documents each get a row; ids may be of any type or null. Empty tables: no
    rows, or clean.

    A benchmark whose size is within broadcast_chars is broadcast and documents are mapped, nothing shuffled. A larger one
    is joined by seed, with the same result.
    """
    carried = {"doc_id": F.col(id_col), **(more or {})}
    size = items.agg(F.coalesce(F.sum(F.length(item_text_col)), F.lit(0))).first()[0]
    if size > broadcast_chars:
        return _joined(docs, text_col, carried, items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item_text")), threshold, min_tile)
    rows = items.select(F.col(item_col).cast("long"), item_text_col).collect()
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark([tuple(r) for r in rows], min_tile, threshold))

    def start():
        bench = shared.value
        return lambda texts: tuple(zip(*(_verdict(bench.coverage(t), threshold) for t in texts))) or tuple([] for _ in VERDICT)

    return map_texts(docs, text_col, carried, VERDICT, start)


def _joined(docs: DataFrame, text_col: str, carried: dict[str, Column], items: DataFrame, threshold: float, min_tile: int) -> DataFrame:
    """The same for a benchmark of any size: seeds of both sides meet in shuffled joins.

    First the seeds that a document shares with any item are found; each text is then read once more for their places and
    words, and only these go to the items that hold them. No text is sent to an item, and a seed that many documents hold is
    a plain join key, which adaptive execution splits.
    """
    stored = numbered(docs.select(F.col(text_col).alias("text"), F.struct(*[c.alias(n) for n, c in carried.items()]).alias("carried")), "decontaminate-docs")
    whole = stored.select("rid", field("row", "text").alias("text"), field("row", "carried").alias("carried"))
    named = numbered(items.where("item_id is not null and item_text is not null"), "decontaminate-items").select(F.col("rid").alias("version"), field("row", "item_id").alias("item_id"), field("row", "item_text").alias("item_text"))

    def start():
        return lambda texts: ([np.unique(seeds(tokens(t), min_tile)).view(np.int64).tolist() for t in texts],)

    of_docs = map_texts(whole, "text", {"rid": F.col("rid")}, {"hs": "array<bigint>"}, start).select("rid", F.explode("hs").alias("h"))

    def start_items():
        def work(texts):
            found = [tokens(t) for t in texts]
            return [seeds(w, min_tile).view(np.int64).tolist() for w in found], [len(w) for w in found]

        return work

    seeded = durable(map_texts(named, "item_text", {"version": F.col("version"), "item_id": F.col("item_id"), "item_text": F.col("item_text")}, {"hs": "array<bigint>", "n_words": "long"}, start_items))
    named = seeded.select("version", "item_id", "item_text", "n_words")
    of_items = durable(seeded.select("version", F.posexplode("hs").alias("place", "h")))
    used = of_docs.join(of_items.select("h").distinct(), "h", "left_semi").groupBy("rid").agg(F.collect_list("h").alias("hs"))

    def start_places():
        def hits(text, hs):
            words = tokens(text or "")
            h = seeds(words, min_tile).view(np.int64)
            return [{"h": int(h[i]), "at": i, "words": words[i : i + min_tile].view(np.int64).tolist()} for i in np.flatnonzero(np.isin(h, hs)).tolist()]

        return lambda rows: ([hits(r["text"], r["hs"]) for r in rows],)

    places = map_texts(whole.join(used, "rid"), F.struct("text", "hs"), {"rid": F.col("rid")}, {"hits": "array<struct<h:bigint,at:bigint,words:array<bigint>>>"}, start_places).select("rid", F.explode("hits").alias("x")).select("rid", "x.*")
    places = durable(places)
    # the most that an item can be covered follows from the seeds that both share, before any word is attached to a pair
    ahead = F.aggregate(F.sequence(F.lit(1), F.size("at")), F.lit(0).cast("long"), lambda a, i: a + F.least(F.lit(min_tile).cast("long"), F.coalesce(F.get("at", i) - F.get("at", i - 1), F.lit(min_tile))))
    met = places.select("rid", "h").distinct().join(of_items, "h").groupBy("rid", "version").agg(F.array_sort(F.collect_list("place")).alias("at"))
    sized = named.select("version", "item_id", "n_words")
    bounds = durable(met.join(sized, "version").select("rid", "version", "item_id", (ahead / F.col("n_words")).alias("most")))

    def start_pairs():
        def one(item, hits):
            pattern, hits = tokens(item), sorted((x["at"], x["words"]) for x in hits)
            words, at, last = [], [], -1
            for place, found in hits:  # only the words under seeds, and a word that matches nothing between stretches
                if place > last and words:
                    words.append(0)
                at.append(len(words) - max(0, last - place))
                words += found[max(0, last - place) :]
                last = place + min_tile
            return covered(pattern, np.array(at), np.array(words, np.int64).view(np.uint64), min_tile)

        return lambda rows: tuple(zip(*(one(r["item"], r["hits"]) for r in rows))) or ([], [])

    def tiled(pairs: DataFrame) -> DataFrame:
        """(rid, item_id, b STRUCT<coverage, n_tiles>) of the given (rid, version)."""
        seeds_of = pairs.select("rid", "version").join(of_items.select("version", "h").distinct(), "version")
        hits = seeds_of.join(places, ["rid", "h"]).groupBy("rid", "version").agg(F.collect_list(F.struct("at", "words")).alias("hits")).join(named, "version")
        found = map_texts(hits, F.struct(F.col("item_text").alias("item"), "hits"), {"rid": F.col("rid"), "item_id": F.col("item_id")}, {"coverage": "double", "n_tiles": "long"}, start_pairs)
        return found.groupBy("rid", "item_id").agg(F.max(F.struct("coverage", "n_tiles")).alias("b"))

    # tiled are all items that may reach the threshold and the likeliest one, then those that may still be covered more
    likeliest = bounds.groupBy("rid").agg(F.max(F.struct(F.col("most"), (-F.col("item_id")).alias("i"), F.col("version"))).alias("x")).select("rid", F.col("x.version").alias("likeliest"))
    ranked = bounds.join(likeliest, "rid").withColumn("first", (F.col("most") >= threshold - SLACK) | (F.col("version") == F.col("likeliest")))
    sure = durable(tiled(ranked.where("first")))
    top = sure.groupBy("rid").agg(F.max(F.struct(F.col("b.coverage"), (-F.col("item_id")).alias("i"))).alias("t")).select("rid", F.col("t.coverage").alias("top"), (-F.col("t.i")).alias("best"))
    open_ = ranked.where("not first").join(top, "rid").where((F.col("most") > F.col("top") + SLACK) | ((F.col("most") >= F.col("top") - SLACK) & (F.col("item_id") < F.col("best"))))
    best = sure.unionByName(tiled(open_)).groupBy("rid", "item_id").agg(F.max("b").alias("b"))
    over = F.col("b.coverage") >= threshold
    per = best.groupBy("rid").agg(
        F.count_if(over).alias("n_items"), F.max(F.struct(F.col("b.coverage"), (-F.col("item_id")).alias("i"), F.col("b.n_tiles"))).alias("top"), F.array_sort(F.collect_list(F.when(over, F.col("item_id")))).alias("item_ids")
    )
    zero = F.lit(0).cast("long")
    return whole.select("rid", "carried").join(per, "rid", "left").select(
        *[field("carried", n).alias(n) for n in carried], F.coalesce("n_items", zero).alias("n_items"), F.coalesce("top.coverage", F.lit(0.0)).alias("coverage"), F.coalesce("top.n_tiles", zero).alias("n_tiles"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), (F.coalesce("n_items", zero) > 0).alias("contaminated")
    )
