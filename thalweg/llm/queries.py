"""One query per corpus operator, with production parameters over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, pii
from .common import durable, fresh_path, table
from .decontaminate import decontaminate
from .embedding_dedup import near_vectors
from .language import fit, identify
from .line_dedup import drop_common_lines
from .mixing import Mixture
from .secrets import BASE_KINDS, scan_history
from .ngram_join import jaccard_classes
from .resample import importance_resample
from .sharding import assign_shards
from .spelling import letter_runs, spelling_variants, vocabulary
from .token_counts import count_tokens


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mixture(table(spark, sf_dir, "documents")).summary()


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def _digest(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_links", "class_id", "kept", "depth")


def _count(array, value: str):
    return F.size(F.filter(array, lambda x: x == value))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run: the ledger starts empty, in the shared folder. n_* count base spans; n_more those the other rules add."""
    found = scan_history(table(spark, sf_dir, "documents"), fresh_path(spark, "secret-ledger"))
    base = F.filter("findings", lambda s: s["kind"].isin(*BASE_KINDS))
    kinds = F.transform("findings", lambda s: s["kind"])
    counts = [_count(kinds, k).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("findings")).alias("spans"), (F.size("findings") - F.size(base)).cast("long").alias("n_more"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* count base spans; n_model those that the network adds."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find_personal_data(docs, pii.fit(docs))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [_count(kinds, k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_model"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`; a null text counts as empty: size 16, CRC 0."""
    text = F.coalesce("text", F.lit(""))
    rows = durable(table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("rid"), "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")))
    placed = rows.join(assign_shards(rows, 40), "rid")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_common_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return identify(docs, fit(docs), named={"held_out": held_out}).select("doc_id", "held_out", "lang_pred", "score")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 199th run, by a hash of document and run, loses a letter; variants are looked for among the words that result.
    A null id counts as empty there."""
    runs = letter_runs(table(spark, sf_dir, "documents"))
    hashed = runs.select("run", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return spelling_variants(vocabulary(hashed.select(F.when(F.col("h") % 199 == 0, shorter).otherwise(F.col("run")).alias("word"))))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns are read back from what format_chats() gives; the conversation -1 says what looks like marks."""
    marks = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))
    read = made.select("conv_id", "formatted", "bad_turn", chat.read_turns(F.col("formatted")).alias("turns"), chat.trained_text(F.col("segments")).alias("trained"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), F.col("bad_turn").isNull().alias("valid"),
    )


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The unsigned CRC-32 of the UTF-8 bytes of `s`, bit by bit: a byte at a time, eight shifts each.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, len(hex(encode(s))), 2), lambda i: (instr('0123456789ABCDEF', hex(encode(s))[i]) - 1) * 16 + instr('0123456789ABCDEF', hex(encode(s))[i + 1]) - 1)),
    lambda c, b: xor(c >> 8, list_reduce([xor(c, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, o: xor(v >> 1, (v & 1) * 3988292384)))), 4294967295)"""

OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, t, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, t, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (c.key IS NOT NULL AND doc_id <> keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY doc_id, t
"""

OP11_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id || ':' || run AS s, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{6,}}')) AS run FROM documents
  ) GROUP BY ALL
), hashed AS (
  SELECT run, c, {CRC32_SQL} AS h FROM runs
), words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(i)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)
), ends AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT f.word, e.root FROM forms f JOIN ends e ON f.form = e.word
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""

OP12_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
         + len(regexp_extract_all(text, '\[/?(SYS|INST|AS)\]|\[OF\]|</?s>'))
         + CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 ELSE NULL END AS chars,
         lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn) AS before,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       bool_and(CASE role WHEN 'system' THEN before = 'start' WHEN 'user' THEN before IN ('start', 'system', 'assistant')
                WHEN 'assistant' THEN before = 'user' ELSE false END AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM sized GROUP BY conv_id
"""

OP13_SQL = rf"""
WITH texts AS (
  SELECT doc_id, true AS raw, row_number() OVER () AS rid, text FROM documents UNION ALL SELECT NULL, false, -row_number() OVER (), text FROM benchmark
), words AS (
  SELECT rid, doc_id, raw, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts
), tokens AS (
  SELECT rid, raw, s, count(*) AS c FROM (SELECT rid, raw, unnest(ws) AS s FROM words) GROUP BY ALL
), hashed AS (
  SELECT s, {CRC32_SQL} % 10000 AS bucket FROM (SELECT DISTINCT s FROM tokens)
), sums AS (
  SELECT bucket, coalesce(sum(c) FILTER (raw), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (NOT raw), 0)::DOUBLE AS t FROM tokens JOIN hashed USING (s) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM sums
), weights AS (
  SELECT rid, sum(c * gain)::BIGINT AS weight FROM tokens JOIN hashed USING (s) JOIN gains USING (bucket) WHERE raw GROUP BY rid
), scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (rid) WHERE raw
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= able * 10 // 100 THEN r END AS rank FROM ranked
"""

QUERIES = {
    "op1_mixture": op1_mixture,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_counts": op4_token_counts,
    "op5_pii": op5_pii,
    "op6_ngram_join": op6_ngram_join,
    "op7_secrets": op7_secrets,
    "op8_sharding": op8_sharding,
    "op9_line_dedup": op9_line_dedup,
    "op10_language": op10_language,
    "op11_spelling": op11_spelling,
    "op12_chat": op12_chat,
    "op13_resample": op13_resample,
}
ORACLES = {"op9_line_dedup": OP9_SQL, "op11_spelling": OP11_SQL, "op12_chat": OP12_SQL, "op13_resample": OP13_SQL}
