import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from thalweg.llm.line_dedup import drop_common_lines
from thalweg.llm.mixing import Mixture, permuted, source_targets, sums_before
from thalweg.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards

from .conftest import DOCS, documents

WS = " \t\n\x0b\x0c\r"


def brute_lines(rows):
    held = defaultdict(set)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(doc_id)
    top = {k: max((d for d in ids if d is not None), default=None) for k, ids in held.items() if len(ids) >= 3}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if key(x) not in top or top[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def test_line_dedup(frame):
    rng = random.Random(0)
    common = ["The same licence line, everywhere.", "  the SAME licence line, everywhere.\t", "Élan vital is not lowered Élan", "short line", ""]
    rows = [(k, "\n".join(rng.choice(common) if rng.random() < 0.6 else f"line {rng.random()} of its own kind" for _ in range(rng.randrange(1, 9)))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (None, common[0]), (5, common[0]), (7, rows[7][1]), (63, "x" * 50_000 + "\n" + common[0])]
    df = frame(rows, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("pos", F.lit("clash")).withColumn("gone", F.lit(0))
    got = sorted((tuple(r) for r in drop_common_lines(df).collect()), key=repr)
    assert got == brute_lines(rows)


def test_line_dedup_empty(frame):
    assert drop_common_lines(frame([], "doc_id long, text string")).count() == 0


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 100):
        out = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()]
        assert sorted(out) == list(range(n))
    assert out != list(range(100))


def brute_targets(sizes):
    """Share by weight, cap, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, fixed, left = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            fixed.add(s)
        left = sum(sizes.values()) - sum(target.values())


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 10, "c": 5, None: 400, "é": 0, "Z": 77}, {"x": 5}, {None: 9, "a": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    assert {r["source"]: r["target"] for r in source_targets(df).collect()} == pytest.approx(brute_targets(sizes))


def mixture_docs():
    rng, rows = random.Random(1), []
    for k in range(300):
        source = rng.choice(["a", "a", "a", "a", "b", "c", None])
        rows.append((k, " ".join(f"w{k}_{i}" for i in range(rng.randrange(0, 60))), "en", source, 0))
    return rows + [(300, None, "en", "a", 0), (301, " \n ", "en", "zero", 0), (302, " ".join(f"x{i}" for i in range(9000)), None, "b", 0), (3, "twice the id", "en", "c", 0), (3, "twice the id", "en", "c", 0)]


def test_mixture(frame):
    rows = mixture_docs()
    df = frame(rows, DOCS)
    got = Mixture(df).summary().collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r[0], len((r[1] or "").split())) for r in rows)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
    for s, target in brute_targets(sizes).items():
        assert taken[s] == pytest.approx(target, rel=0.02, abs=2)
    again = Mixture(frame(rows[::-1], DOCS, 7)).summary().collect()  # stored in another order and number of files
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mixed_documents_are_parts_of_documents(frame):
    rows = mixture_docs()
    df = frame(rows, DOCS)
    m = Mixture(df, block_words=16)
    out = m.documents().collect()
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1])
    words, whole = Counter(), 0
    for r in out:
        assert r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(r["text"].split())
        own = [t.split() for t in texts[r["doc_id"]] if t]
        assert any(set(r["text"].split()) <= set(t) for t in own)
        whole += r["text"] in texts[r["doc_id"]]
    assert whole
    expected = Counter()
    for r in m.summary().collect():
        expected[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in expected.items() if v} == dict(words)


def test_mixture_draws_counts_per_shard(frame):
    """Counts of a source over shards scatter as a multinomial does, no more and no less than by a factor."""
    df = frame([(k, " ".join(["w"] * 40), "en", "ab"[k % 2], 0) for k in range(2000)], DOCS)
    m = Mixture(df, block_words=4, shard_blocks=200)
    counts = [r["n"] for r in m.slots().where("source = 'a'").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).orderBy("shard").collect()][:-1]
    p, mean = 1 / 3, 200 / 3
    variance = sum((c - mean) ** 2 for c in counts) / len(counts)
    assert 0.5 < variance / (200 * p * (1 - p)) < 1.8


def test_empty_mixture(frame):
    df = frame([], DOCS)
    assert Mixture(df).summary().count() == 0 and Mixture(df).documents().count() == 0
    none = frame([(1, None, None, None, 0), (2, "", None, "a", 0)], DOCS)
    assert [r["taken"] for r in Mixture(none).summary().collect()] == [0, 0]


def test_hypergeometric_law(spark):
    from math import comb

    n = 20_000
    draws = spark.range(n).select(hypergeometric(F.lit(20).cast("long"), F.lit(8).cast("long"), F.lit(6).cast("long"), (F.col("id") + 0.5) / n).alias("k"))
    seen = Counter(r["k"] for r in draws.collect())
    for k in range(7):
        assert seen[k] / n == pytest.approx(comb(8, k) * comb(12, 6 - k) / comb(20, 6), abs=2e-4)
    for total, marked, drawn in ((0, 0, 0), (5, 5, 3), (5, 0, 3), (5, 2, 5), (10**9, 5 * 10**8, 10**6)):
        k = spark.range(1).select(hypergeometric(*[F.lit(x).cast("long") for x in (total, marked, drawn)], F.lit(0.5))).first()[0]
        assert max(0, drawn - total + marked) <= k <= min(marked, drawn)


@pytest.mark.parametrize("counts", [[5], [0, 7, 0, 12], [100] * 9, [1] * 70])
def test_matrix_sums(spark, counts):
    df = spark.createDataFrame([(k, n) for k, n in enumerate(counts) if n], "pid long, n long")
    rows = [r for r in communication_matrix(df, 7, 3).collect()]
    total = [sum(x) for x in zip(*[r["sends"] for r in rows])]
    assert {r["pid"]: sum(r["sends"]) for r in rows if sum(r["sends"])} == {k: n for k, n in enumerate(counts) if n}
    assert max(total) - min(total) <= 1 and all(x >= 0 for r in rows for x in r["sends"])


def test_shuffle(frame):
    rows = [(k, f"t{k % 50}", None, "s", 1) for k in range(997)] + [(1, None, None, None, None)] * 3
    df = frame(rows, DOCS, 5).withColumn("shard", F.lit("old"))
    out = shuffle_into_shards(df, 40, 1).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and {len(v) for v in slots.values()} == {25} and len(slots) == 40
    assert sorted(repr(tuple(r)[:5]) for r in out) == sorted(map(repr, rows))
    assert sorted(map(repr, shuffle_into_shards(df, 40, 1).collect())) == sorted(map(repr, out))


def test_shuffle_is_uniform(frame):
    """Rows that were neighbours do not stay so: the first tenth of the input spreads over all slots."""
    df = frame([(k, "", None, "s", 0) for k in range(4000)], DOCS, 4)
    out = shuffle_into_shards(df, 4, 2).where("doc_id < 400").collect()
    by = Counter(r["shard"] for r in out)
    assert all(60 < by[s] < 140 for s in range(4))
    assert 380 < sum(r["slot"] for r in out) / len(out) < 620


def test_shuffle_empty(frame):
    assert shuffle_into_shards(frame([], DOCS), 4).count() == 0


def test_shuffle_does_not_depend_on_parallelism(frame, restless):
    """No row is lost or doubled when splits change between the jobs of one shuffle, or before its result is read."""
    docs = frame([(k, f"text {k}", k % 7) for k in range(10_000)], "doc_id long, text string, x int", 5)
    out = shuffle_into_shards(docs, 40)
    rows = out.collect()
    assert sorted((r["doc_id"], r["text"], r["x"]) for r in rows) == [(k, f"text {k}", k % 7) for k in range(10_000)]
    assert {(r["shard"], r["slot"]) for r in rows} == {(s, k) for s in range(40) for k in range(250)}


def test_mixture_does_not_depend_on_parallelism(spark, frame, restless):
    docs = frame([(k, f"w{k} " * (k % 9), f"s{k % 3}") for k in range(400)], "doc_id long, text string, source string", 5)
    mix = Mixture(docs, with_documents=True)
    got = sorted((r["doc_id"], r["text"]) for r in mix.documents().collect())
    words = {}
    for d, t in got:
        words[d] = words.get(d, 0) + len(t.split())
        assert set(t.split()) == {f"w{d}"}
    assert words == {r["doc_id"]: r["taken"] for r in Mixture(docs).summary().collect() if r["taken"]}


def test_matrix_of_many_partitions(spark):
    """Counts of 20,000 partitions are dealt as rows, level by level."""
    n = F.pmod(F.xxhash64("id"), F.lit(5)) + 8
    counts = spark.range(20_000).select(F.col("id").alias("pid"), n.alias("n"))
    matrix = communication_matrix(counts, 40).cache()
    assert matrix.count() == 20_000
    assert matrix.join(counts, "pid").where(F.aggregate("sends", F.lit(0).cast("long"), lambda a, x: a + x) != F.col("n")).count() == 0
    sums = [r[0] for r in matrix.select(F.posexplode("sends")).groupBy("pos").agg(F.sum("col").alias("n")).select("n").collect()]
    assert len(sums) == 40 and max(sums) - min(sums) <= 1
    matrix.unpersist()


@pytest.mark.parametrize("rows", [[("a", k, 1) for k in range(5000)] + [(None, 3, 2), (None, 1, 5), ("b", 0, 4)], []])
def test_sums_before(spark, rows):
    """Two levels of windows give what one window gives."""
    df = spark.createDataFrame(rows, "source string, place long, n long")
    got = {(r["s"], r["p"]): r["before"] for r in sums_before(df, "place").collect()}
    assert got == {(s, p): sum(n for t, q, n in rows if t == s and q < p) for s, p, n in rows if s != "a"} | {("a", k): k for k in range(5000 if rows else 0)}


def test_registered_queries(spark, sf):
    from thalweg.llm.queries import QUERIES

    out = QUERIES["op8_sharding"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    import zlib

    for r in out.itertuples():
        text = (docs.text[r.doc_id] or "").encode()
        assert r.size == len(text) + 16 and r.text_crc32 == zlib.crc32(text) and r.law == "rows"
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    kept = {r["doc_id"]: r for r in QUERIES["op9_line_dedup"](spark, sf).collect()}
    for doc_id, n, dropped, text in brute_lines([(d, t) for d, t in docs.text.items()]):
        assert tuple(kept[doc_id])[1:] == (n, dropped, hashlib.sha256(text.encode()).hexdigest())
    assert documents(["a"])[0][1] == "a"
