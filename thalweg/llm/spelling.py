"""Grouping of spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

One edit leaves one of any two disjoint q-grams of a word whole, at the place where the other word has it or one place
before. So each word is probed with the pair of disjoint grams that the vocabulary holds least of, against an index of all
words by (length, place, gram). What meets there is compared by shorter grams: their sorted postings are merged with a heap,
under the limits of length and place, and words that share as many as one edit must leave are verified.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import UPPER, stored, tidy

#: Letters of a gram.
Q = 3
#: Grams are taken from a word's first so many places; any two disjoint ones serve, so nothing is lost with longer words.
PLACES = 32
#: Counts of grams, by which rare ones are chosen, are kept for so many hash values, whatever the alphabet: 8 MB.
GRAM_BITS = 20
#: Words of an index key that are indexed, and probed, in one task at once.
BLOCK = 4096
#: Words that a task adds up before it hands its sums on.
HELD = 100_000
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5


def lower_ascii(run):
    """A-Z in lower case, nothing else changed."""
    return F.when(run.rlike("[A-Z]"), F.translate(run, UPPER, UPPER.lower())).otherwise(run)


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, run): every maximal run of Latin letters of at least min_length, A-Z in lower case. Null texts have none."""
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("run"))
    return runs.select("doc_id", lower_ascii(F.col("run")).alias("run"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """words: (word) -> (word, n): words of at least min_length code points that occur min_count times or more."""
    return words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def gram_hashes(words: list[str]) -> list[np.ndarray]:
    """For each word the hash, of GRAM_BITS bits, of each of its grams in the first PLACES places."""
    size = np.array([min(len(w), PLACES + Q - 1) for w in words], np.int64)
    codes = np.frombuffer("".join(w[: PLACES + Q - 1] for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(0, len(codes) - Q + 1), np.uint64)
    for k in range(Q):
        h = (h ^ codes[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
    h = (h >> np.uint64(64 - GRAM_BITS)).astype(np.int64)
    ends = np.cumsum(size)
    return [h[e - n : e - Q + 1] for e, n in zip(ends.tolist(), size.tolist())]


def gram_counts(words: DataFrame) -> np.ndarray:
    """How often the vocabulary holds grams of each hash; tasks send a row for each hash that they met."""

    def run(batches):
        counts = np.zeros(1 << GRAM_BITS, np.int64)
        for batch in batches:
            for h in gram_hashes(batch.column(0).to_pylist()):
                np.add.at(counts, h, 1)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], ["h", "n"])

    found = words.select("word").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << GRAM_BITS, np.int64)
    out[found.column("h").to_numpy()] = found.column("n").to_numpy()
    return out


def probe_places(counts: list[int]) -> tuple[int, int]:
    """The two disjoint grams whose counts sum to least (ties: the first), by the counts of a word's grams."""
    best, least, at = None, 0, (0, Q)
    for second in range(Q, len(counts)):
        if counts[second - Q] < counts[least]:
            least = second - Q
        total = counts[least] + counts[second]
        if best is None or total < best:
            best, at = total, (least, second)
    return at


def postings_and_probes(words: DataFrame, counts: np.ndarray, min_length: int) -> DataFrame:
    """words: (word, n) -> (key, probe, word, n, before): a row for each posting of the index and for each probe.

    Keys are length:place:gram of the indexed word. A word probes words of its own length and those one shorter. before: for
    probes with the second gram the place of the first, so that a pair is taken where it meets first; else -1.
    """
    shared = words.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        counts = shared.value
        for batch in batches:
            keys, probes, at, before = [], [], [], []
            words = batch.column(0).to_pylist()
            for k, (word, hashes) in enumerate(zip(words, gram_hashes(words))):
                n = len(word)
                for p in range(len(hashes)):
                    keys.append(f"{n}:{p}:{word[p : p + Q]}"), probes.append(False), at.append(k), before.append(-1)
                first, second = probe_places(counts[hashes].tolist())
                for place, shift, b in ((first, 0, -1), (second, 1, first)):
                    gram = word[place : place + Q]
                    keys.append(f"{n}:{place}:{gram}"), probes.append(True), at.append(k), before.append(b)
                    if n > min_length:
                        keys.append(f"{n - 1}:{place - shift}:{gram}"), probes.append(True), at.append(k), before.append(b)
            at = pa.array(at, pa.int64())
            for i in range(0, len(keys), 10_000):  # long words are repeated, so batches stay small
                cut = slice(i, i + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[cut], pa.string()), pa.array(probes[cut]), batch.column(0).take(at[cut]), batch.column(1).take(at[cut]), pa.array(before[cut], pa.int32())], ["key", "probe", "word", "n", "before"])

    return words.select("word", "n").mapInArrow(run, "key string, probe boolean, word string, n long, before int")


def one_edit(x: str, y: str) -> bool:
    """Whether x becomes y by exactly one replaced or deleted code point; x is as long as y, or one longer."""
    k, n = 0, len(y)
    while k < n and x[k] == y[k]:
        k += 1
    return k < len(x) and x[k + 1 :] == y[k + (len(x) == len(y)) :]


class Postings:
    """Indexed words of one length that share the gram of their key: for each place and pair of letters the numbers of the
    words that have it there, ascending. The pairs within the key's gram are left out, as all words have them."""

    def __init__(self, words: list[str], key_place: int):
        self.words, self.length, self.key_place = words, len(words[0]), key_place
        self.known = range(key_place, key_place + Q - 1)
        self.at: list[dict[str, list[int]]] = [{} for _ in range(self.length - 1)]
        for p, pairs in enumerate(self.at):
            if p not in self.known:
                for i, word in enumerate(words):
                    pairs.setdefault(word[p : p + 2], []).append(i)

    def candidates(self, x: str, place: int) -> list[str]:
        """Words that share as many pairs of letters with x, where one edit would leave them, as one edit must leave.
        place: where x has the key's gram.

        One edit destroys two of x's pairs, so of all but the key's the indexed word has all but two: at least one of any
        three. The postings of the three rarest are merged by a heap, and the others counted for what is met there.
        """
        shifts = (0, 1) if len(x) > self.length else (0,)
        found = []
        for p in range(len(x) - 1):
            if place <= p < place + Q - 1:
                continue
            pair = x[p : p + 2]
            lists = [got for s in shifts if 0 <= p - s < len(self.at) and (got := self.at[p - s].get(pair))]
            found.append((sum(map(len, lists)), p, lists))
        found.sort(key=lambda f: f[0])
        few, rest, bound = found[:3], found[3:], len(found) - 2
        lists = [got for _, _, lists in few for got in lists]
        merged = heapq.merge(*lists) if len(lists) > 1 else iter(lists[0] if lists else ())
        out = []
        for i, run in groupby(merged):
            met, word = sum(1 for _ in run), self.words[i]
            if met < bound:
                met += sum(any(word[p - s : p - s + 2] == x[p : p + 2] for s in shifts if p >= s) for _, p, _ in rest)
            if met >= bound:
                out.append(word)
        return out


def near_in(words: list[tuple[str, int]], probes: list[tuple[str, int, int]], key_place: int):
    """(word, n, other, n of other) for pairs of an indexed and a probed word that are one edit apart and meet first here.

    words have the key's gram at key_place; a longer word probes with its first gram there, with its second one place on.
    """
    index = Postings([w for w, _ in words], key_place)
    n_of = dict(words)
    for x, n, before in probes:
        for y in index.candidates(x, key_place + (before >= 0 and len(x) > index.length)):
            if len(x) == len(y) and x >= y:
                continue  # found when y is probed
            if before >= 0 and y[before : before + Q] == x[before : before + Q]:
                continue  # met by the first gram
            if one_edit(x, y):
                yield x, n, y, n_of[y]


def _compare(batches):
    """Rows sorted by key, part and probe -> (word, n_near, less, other): sums over what this task has compared; less is the
    negated n of the most frequent near word, other that word (ties: the smallest)."""
    held: dict[str, tuple[int, int, str]] = {}
    group, words, probes = None, [], []

    def add(word, n, other):
        count, less, best = held.get(word, (0, 1, ""))
        held[word] = (count + 1, *min((less, best), (-n, other)))

    def close():
        if words and probes:
            for x, n, y, m in near_in(words, probes, int(group[0].split(":", 2)[1])):
                add(x, m, y)
                add(y, n, x)
        words.clear(), probes.clear()

    def flush():
        columns = [list(c) for c in zip(*held.values())] or [[], [], []]
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["word", "n_near", "less", "other"])
        held.clear()
        return out

    for batch in batches:
        for key, i, j, probe, word, n, before in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if (key, i, j) != group:
                close()
                group = key, i, j
            if probe:
                probes.append((word, n, before))
            else:
                words.append((word, n))
        if len(held) > HELD:
            yield flush()
    close()
    yield flush()


def near_words(words: DataFrame, min_length: int, block: int = BLOCK) -> DataFrame:
    """words: (word, n), distinct, of at least min_length -> (word, n_near, best STRUCT<less, other>) where there is any."""
    ship(words.sparkSession)
    rows = stored(postings_and_probes(words, gram_counts(words), min_length), "postings")
    sizes = rows.groupBy("key").agg(F.count_if(~F.col("probe")).alias("words"), F.count_if("probe").alias("probes"))
    parts = [F.ceil(F.col(c) / block).cast("int").alias(a) for c, a in (("words", "wide"), ("probes", "high"))]
    met = rows.join(sizes.where("words > 0 and probes > 0").select("key", *parts), "key")
    # a key beyond a block is cut in blocks of words and blocks of probes, and each meets each
    mine = F.pmod(F.xxhash64("word"), F.when(F.col("probe"), F.col("high")).otherwise(F.col("wide"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("probe"), F.col("wide")).otherwise(F.col("high")) - 1))
    met = met.withColumn("mine", mine).withColumn("other", other)
    met = met.select("key", F.when(F.col("probe"), F.col("other")).otherwise(F.col("mine")).alias("i"), F.when(F.col("probe"), F.col("mine")).otherwise(F.col("other")).alias("j"), "probe", "word", "n", "before")
    found = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare, "word string, n_near long, less long, other string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "other")).alias("best")).where("n_near > 0")


def roots(links: DataFrame) -> DataFrame:
    """links: (word, form) without cycles -> (word, root): the end of each chain, by pointer doubling."""
    links = stored(links.select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        links = now.select("word", "root")
        if now.where("moved").isEmpty():
            return links


@tidy
def spelling_variants(words: DataFrame, ratio: int = RATIO, min_length: int = MIN_LENGTH, block: int = BLOCK) -> DataFrame:
    """words: (word, n), each word once -> word, form, root, n, n_near, form_n: a row for each word.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. form: the near word of largest
    n (ties: the smallest by code point) if its n is at least ratio times the word's, else null; form_n: its n. root: what
    following forms from the word ends at, the word itself if it has no form. n_near: its near words, 0 if none.

    Words have min_length code points or more, at least 6; shorter and null ones are an error of the caller and left out.
    ratio is above 1, so that chains end. Words of any length: grams of the first PLACES places lead to all partners. A word
    repeated: its rows are compared as one word each, so count first. Empty table: no rows.
    """
    if ratio <= 1 or min_length < 2 * Q:
        raise ValueError(f"ratio is above 1, min_length at least {2 * Q}")
    words = stored(words.where(F.char_length("word") >= min_length).select("word", "n"), "words", keep=True)
    near = near_words(words, min_length, block)
    near = stored(near.select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.other").alias("near_word")), "near", keep=True)
    fits = F.col("near_n") >= ratio * F.col("n")
    links = words.join(near, "word").where(fits).select("word", F.col("near_word").alias("form"))
    ends = stored(roots(links), "roots", keep=True)
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", F.when(fits, F.col("near_word")).alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("near_n")).alias("form_n"))
