"""Secret scans by an incremental blob ledger.

Every version of every path is addressed by its content. The ledger, a table in a shared folder, holds the findings of
each (blob, rule version) that was ever scanned; a run scans only pairs it does not hold, appends them, and joins the
findings back to all paths.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_texts

RULE_VERSION = "3"
FINDINGS = "array<struct<kind:string,start:bigint,end:bigint>>"
BASE_KINDS = ("assign", "access", "hex")


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: (kind, pattern, test of a match), in the order in which kinds are listed; a failing match is dropped without a retry.
#: The first three are the base; the others add spans. A web token begins where its run of characters does
#: and runs are matched possessively, so that no text is read more than a few times.
RULES = [
    ("assign", re.compile(rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: m.end(1) - m.start(1) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]{16,}"), None),
    ("hex", re.compile(r"[0-9a-f]{24,}"), None),
    ("private_key", re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"), None),
    ("web_token", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"), None),
    ("url_login", re.compile(r"://[A-Za-z0-9._-]{1,64}:[^\s:@/]{3,64}@"), None),
]
_ORDER = {kind: i for i, (kind, _, _) in enumerate(RULES)}
#: Strings of which a match holds at least one, looked for first because plain search is fast; "": always run.
_NEEDS = {"assign": ("password", "passwd", "secret", "token", "api"), "access": ("akia",), "hex": ("",), "private_key": ("-----begin",), "web_token": ("eyj",), "url_login": ("://",)}


def scan(text: str) -> list[tuple[str, int, int]]:
    """Findings (kind, start, end) in code points, by start, then kind as listed."""
    lower, found = text.lower(), []
    for kind, pattern, test in RULES:
        if any(x in lower for x in _NEEDS[kind]):
            found.extend((kind, m.start(), m.end()) for m in pattern.finditer(text) if test is None or test(m))
    return sorted(found, key=lambda x: (x[1], _ORDER[x[0]]))


def read_ledger(spark, path: str, rule_version: str) -> DataFrame | None:
    """(blob, findings) under a rule version, or None before the first scan. A pair that two runs at once have both
    scanned is in the ledger twice, with equal findings, and comes once."""
    try:
        ledger = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return ledger.where(F.col("rule_version") == rule_version).groupBy("blob").agg(F.first("findings").alias("findings"))


def scan_history(versions: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """One row per input row (a version of a path): doc_id, blob, findings (array of kind, start, end).

    Null text is the empty blob. Repeated rows and copies are one blob, scanned once. Null ids come back as they are.
    Empty table: no rows, the ledger is left alone. Content addresses are SHA-256.

    Rows are known by their address alone, never by a number, so it does not matter how the table is split when it is read
    again. One text for each unseen address is picked by an aggregate: copies meet in the task that reads them first, so a
    blob that a third of all rows hold is no hot key. Joining findings back is a join of two stored tables, which adaptive
    execution splits where a blob is hot.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    address = F.unhex(F.sha2(text, 256)).alias("blob")
    ids = durable(versions.select(F.col(id_col).alias("doc_id"), address))
    known = read_ledger(spark, ledger, rule_version)
    texts = versions.select(address, text.alias("text"))
    if known is not None:
        due = durable(ids.select("blob").distinct().join(known, "blob", "left_anti"))
        texts = texts.join(due, "blob", "left_semi")
    if not (ids if known is None else due).isEmpty():

        def start():
            return lambda texts: ([[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in texts],)

        one = texts.groupBy("blob").agg(F.first("text").alias("text"))
        found = map_texts(one, "text", {"blob": F.col("blob")}, {"findings": FINDINGS}, start)
        found.select("blob", F.lit(rule_version).alias("rule_version"), "findings").write.mode("append").parquet(ledger)
        known = read_ledger(spark, ledger, rule_version)
    if known is None:
        return ids.select("doc_id", "blob", F.lit(None).cast(FINDINGS).alias("findings"))
    return ids.join(known, "blob").select("doc_id", "blob", "findings")
