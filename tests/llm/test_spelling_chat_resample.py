import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from thalweg.llm import chat
from thalweg.llm.resample import importance_resample
from thalweg.llm.spelling import Postings, letter_runs, near_in, one_edit, probe_places, spelling_variants, vocabulary

# ---- spelling variants


def near(a, b):
    """Exactly one inserted, deleted or replaced code point, by trying all deletions and replacements."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(words, ratio=5):
    out, form = {}, {}
    for w, n in words.items():
        found = sorted((-m, o) for o, m in words.items() if near(w, o))
        fits = found and -found[0][0] >= ratio * n
        form[w] = found[0][1] if fits else None
        out[w] = [form[w], None, n, len(found), -found[0][0] if fits else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def variants(spark, words, **options):
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants(frame, **options).collect()}


def drawn_words(seed, count):
    rng = random.Random(seed)
    words = {}
    while len(words) < count:
        word = "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
        words[word] = rng.choice([5, 6, 30, 31, 160, 900])
    return words


@pytest.mark.parametrize("block", [4096, 3])
def test_variants_equal_all_pairs(spark, block):
    words = drawn_words(1, 400) | {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 700, "banana" * 20: 5, "banana" * 20 + "s": 50, "x" * 31 + "y" * 40: 9, "x" * 31 + "z" + "y" * 40: 45}
    assert variants(spark, words, block=block) == by_hand(words)


def test_chains_ties_and_the_ratio(spark):
    words = {"letter": 1000, "lettr": 9, "lettera": 200, "letteraa": 40, "letteraaa": 8, "zzzzzzz": 5, "singled": 5, "singleb": 25, "singlea": 25, "mingled": 24}
    found = variants(spark, words)
    words.pop("lettr")  # too short to be a word
    assert found == by_hand(words)
    assert found["letteraaa"][:2] == ("letteraa", "letter") and found["singled"][0] == "singlea" and found["zzzzzzz"] == (None, "zzzzzzz", 5, 0, None)
    with pytest.raises(ValueError):
        variants(spark, words, ratio=1)


def test_words_of_any_length(spark):
    long = "ab" * 100_000
    assert variants(spark, {long: 5, long[:50] + long[51:]: 50, long[:-1] + "x": 6})[long][:2] == (long[:50] + long[51:],) * 2


def test_no_words(spark):
    assert spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_runs_and_vocabulary(spark, frame):
    docs = frame([(1, "Letters LETTERS, lettersÀ letters1letters short", "n"), (None, None, "n"), (2, "", "n"), (2, "letters×letters", "n")], "doc_id long, text string, word string")
    runs = letter_runs(docs)
    assert Counter(r["run"] for r in runs.collect()) == {"letters": 4, "lettersÀ": 1, "letters×letters": 1}
    counted = vocabulary(runs.select(F.col("run").alias("word")), min_count=4)
    assert [tuple(r) for r in counted.collect()] == [("letters", 4)]


def test_small_parts():
    assert probe_places([9, 1, 9, 9, 2, 9, 1]) == (1, 6) and probe_places([1, 1, 1, 5]) == (0, 3)
    assert one_edit("abcdefg", "abcefg") and one_edit("abcdef", "abcdeg") and not one_edit("abcdef", "abcdef") and not one_edit("abcdefg", "abdceg") and one_edit("aaaaaaa", "aaaaaa")
    assert Postings(["abcdef", "abcdeg", "abcxyz"], 0).candidates("abcdef", 0) == ["abcdef", "abcdeg"]
    # met by the first gram at place 0; the second, which lies at place 3 of both, is left to it
    assert list(near_in([("abcdef", 3)], [("abcdefg", 1, -1)], 0)) == [("abcdefg", 1, "abcdef", 3)]
    assert list(near_in([("abcdef", 3)], [("abcxdef", 1, 0)], 3)) == []
    assert list(near_in([("abcdef", 3)], [("xabcdef", 1, 0)], 3)) == [("xabcdef", 1, "abcdef", 3)]


# ---- chat formatting

TURNS = "conv_id long, turn long, role string, text string, loss string"


def chats(spark, rows, **options):
    made = chat.format_chats(spark.createDataFrame([(*r, "x") for r in rows], TURNS), **options)
    read = made.select("*", chat.read_turns(F.col("formatted"), options.get("template", chat.DEFAULT)).alias("turns"), chat.trained_text(F.col("segments")).alias("trained"))
    return {r["conv_id"]: r for r in read.collect()}


def test_format_and_marks(spark):
    found = chats(spark, [(1, 1, "assistant", "yes"), (1, 0, "user", "well?")])[1]
    assert found["formatted"] == "[INST] well? [/INST] <s> yes </s>\n" and found["bad_turn"] is None
    assert [(s["text"], s["loss"]) for s in found["segments"]] == [("[INST] ", False), ("well?", False), (" [/INST] ", False), ("<s> ", False), ("yes", True), (" </s>\n", False)]


def test_whatever_texts_say_is_read_back(spark):
    rng = random.Random(3)
    parts = ["[INST]", "[/INST]", "</s>", "<s>", "[SYS]", "[AS]", "[OF]", "[/AS]", "\\", "\n", " ", "<", "[", "/", "s>", "INST]", "é", "😀", "ok", "$1", "\\\\["]
    rows, said = [], {}
    for conv in range(300):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool", "[OF]", "", None])
            text = rng.choice(["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))), None])
            rows.append((conv, turn, role, text))
            said.setdefault(conv, []).append((role or "", text or ""))
    found = chats(spark, rows)
    for conv, turns in said.items():
        assert [tuple(t) for t in found[conv]["turns"]] == turns
        assert found[conv]["trained"] == "".join(t for r, t in turns if r == "assistant")
        assert found[conv]["formatted"] == "".join(s["text"] for s in found[conv]["segments"])


def test_order_of_turns_is_validated(spark):
    orders = ["user assistant", "system user assistant", "user", "assistant user", "user user assistant", "user assistant system", "system", "user tool assistant", "user assistant user assistant"]
    found = chats(spark, [(k, t, r, "x") for k, o in enumerate(orders) for t, r in enumerate(o.split())])
    assert [found[k]["bad_turn"] for k in range(len(orders))] == [None, None, 1, 0, 1, 2, 1, 1, None]


def test_long_repeated_and_null_turns(spark):
    long = "[INST] \\ </s>" * 100_000
    found = chats(spark, [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, None, None, None)])
    assert [t["text"] for t in found[1]["turns"]] == [long, long] and found[1]["trained"] == long
    assert len(found[2]["turns"]) == 2 and [tuple(t) for t in found[None]["turns"]] == [("", "")]
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_another_template(spark):
    other = chat.Template(roles={"q": chat.Marks("<|q|>", "<|end|>"), "a": chat.Marks("<|a|>", "<|end|>", loss=True)}, moves={("start", "q"): "q", ("q", "a"): "a"}, accepting=frozenset({"a"}), other=chat.Marks("<|as|>", "<|end|>"), named="<|of|>")
    found = chats(spark, [(1, 0, "q", "<|q|> <|end|>"), (1, 1, "a", "\\<|a|>")], template=other)[1]
    assert [tuple(t) for t in found["turns"]] == [("q", "<|q|> <|end|>"), ("a", "\\<|a|>")] and found["trained"] == "\\<|a|>"
    with pytest.raises(ValueError):
        chat.Template(roles={"q": chat.Marks("<<q>>", "<</q>>")}, moves={}, accepting=frozenset())


def test_formatting_runs_no_python(spark):
    plan = chat.format_chats(spark.createDataFrame([(1, 0, "user", "x", "x")], TURNS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1


# ---- importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def resampled_by_hand(docs, target, max_n=1, buckets=10_000, seed=2024, percent=10, min_words=20):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        words = WORD.findall((text or "").translate(fold))
        return len(words), [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for doc_id, text in docs:
        n, found = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def texts_of(seed, count):
    rng = random.Random(seed)
    pool = [f"wörd{i}" for i in range(60)] + ["The", "THE", "a1", "x-y", "é_é"]
    return [" ".join(rng.choice(pool[: rng.randint(1, len(pool))]) for _ in range(rng.randint(0, 60))) for _ in range(count)]


@pytest.mark.parametrize("options", [{}, {"max_n": 3, "buckets": 50}, {"max_n": 2, "seed": 1, "percent": 50, "min_words": 1}])
@pytest.mark.parametrize("frequent", [5, 100_000])
def test_resampling_equals_its_definition(spark, frame, options, frequent):
    docs = [*enumerate(texts_of(1, 80)), (90, None), (91, ""), (92, "?! .."), (None, "wörd1 " * 30)]
    target = [*texts_of(2, 5), None, ""]
    found = importance_resample(frame([(k, t, "clash", 1) for k, t in docs], "doc_id long, text string, rank string, weight long"), frame([(t, 0) for t in target], "text string, bucket long"), frequent=frequent, **options)
    assert found.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == resampled_by_hand(docs, target, **options)


def test_repeated_rows_long_texts_and_empty_tables(spark, frame):
    schema = "doc_id long, text string"
    docs = [(1, "one two " * 40), (1, "one two " * 40), (2, "three " * 300_000 + " ".join(f"r{i}" for i in range(30_000)))]
    found = importance_resample(frame(docs, schema), frame([(1, "one")], schema), percent=100, frequent=10)
    rows, expected = found.collect(), resampled_by_hand(docs, ["one"], percent=100)
    assert sorted(r["rank"] for r in rows) == [1, 2, 3]  # which of the equal rows comes first is left open
    assert sorted(tuple(r)[:4] for r in rows) == sorted(r[:4] for r in expected)
    assert importance_resample(frame([], schema), frame([(1, "one")], schema)).count() == 0
    got = importance_resample(frame([(1, "one two")], schema), frame([], schema)).first()
    assert (1, 2, got["weight"], got["score"], None) == resampled_by_hand([(1, "one two")], [])[0]
