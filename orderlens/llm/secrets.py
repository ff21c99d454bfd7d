"""Secret scans over a ledger of blobs: every version of a text is scanned once per rule version.

A text's address is the SHA-256 of its UTF-8 bytes, so equal texts at many
paths are one blob. The ledger is a Parquet folder with one row per (blob,
rule version) and that blob's findings. ``scan`` works out which pairs the
ledger lacks, scans only those blobs with only those rules, appends them, and
``findings`` joins the ledger back to all paths. A run that dies before its
append is committed has added nothing; running it again scans the same pairs.
A change of a rule's version makes every blob unseen for that rule alone.

Defined results: null and empty texts are one blob without findings; rows with
equal ids or texts are all reported; a null id stays null; other columns are
ignored. Positions are code points, ends exclusive; matches are leftmost and
don't overlap within a rule; matches failing a rule's test are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm.common import digest_of_strings


@dataclass(frozen=True)
class Rule:
    """``hint``: one of these strings is in any text (its ASCII letters in lower case if ``fold``) with a match."""

    kind: str
    version: int
    pattern: str
    holds: Callable[[re.Match], bool]
    flags: int = re.ASCII
    hint: tuple[str, ...] = ()
    fold: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def entropy(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in the order in which spans at one start are listed; the first three are always reported.
RULES = (
    Rule("assign", 1, ASSIGN, lambda m: len(m.group(2)) >= 6, re.ASCII | re.IGNORECASE,
         ("password", "passwd", "secret", "token", "apikey", "api_key"), fold=True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20, hint=("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,40}PRIVATE KEY-----)?",
         lambda m: True, hint=("PRIVATE KEY-----",)),
    Rule("signed_token", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
         lambda m: entropy(m.group()) >= 3.5, hint=("eyJ",)),
    Rule("service_key", 1, r"(?<![A-Za-z0-9_])(?:ghp_|gho_|xox[abp]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}",
         lambda m: entropy(m.group()) >= 3, hint=("ghp_", "gho_", "xox", "sk_live_", "AIza")),
)
BASE = ("assign", "access", "hex")
LEDGER = "blob string, rule string, findings array<struct<kind:string,start:bigint,end:bigint>>"


def spans(rule: Rule, text: str, folded: str) -> list[tuple[str, int, int]]:
    if rule.hint and not any(h in (folded if rule.fold else text) for h in rule.hint):
        return []
    pattern = rule.pattern if rule.kind != "hex" else r"[0-9a-f]{24,}"  # the same runs, sooner found
    return [(rule.kind, m.start(), m.end()) for m in re.finditer(pattern, text, rule.flags) if rule.holds(m)]


def addressed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(""))) \
        .withColumn("blob", F.sha2(F.col(text_col), 256))


class Ledger:
    """The findings of every (blob, rule version) pair scanned so far, in a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        store = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if store.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(store):
            return self.spark.read.schema(LEDGER).parquet(self.path)
        return self.spark.createDataFrame([], LEDGER)

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> None:
        """Scan what the ledger lacks of the blobs in ``docs``; commit in one append."""
        names = [r.name for r in rules]
        seen = (self.read().filter(F.col("rule").isin(names)).groupBy("blob")
                .agg(F.collect_set("rule").alias("_done")))  # at most one entry per rule
        texts = addressed(docs.select(text_col), text_col)
        blobs = texts.groupBy("blob").agg(F.first(text_col).alias("_text"))  # copies meet before the shuffle
        todo = (blobs.join(seen, "blob", "left")
                .select("blob", "_text", F.array_except(F.array(*map(F.lit, names)),
                                                        F.coalesce("_done", F.array().cast("array<string>"))).alias("_rules"))
                .filter(F.size("_rules") > 0))
        found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_name = {r.name: r for r in rules}
            for batch in batches:
                out: tuple[list, list, list] = ([], [], [])
                for blob, text, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    folded = text.lower()
                    for name in names:
                        out[0].append(blob)
                        out[1].append(name)
                        out[2].append([dict(zip(("kind", "start", "end"), s, strict=True))
                                       for s in spans(by_name[name], text, folded)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], found)],
                    ["blob", "rule", "findings"])

        todo.mapInArrow(scanned, LEDGER).write.mode("append").parquet(self.path)

    def findings(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
        """(id, blob, spans): every row of ``docs`` with its blob's findings, by start and the rules' order."""
        order = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)))
        known = (self.read().filter(F.col("rule").isin([r.name for r in rules]))
                 .dropDuplicates(["blob", "rule"])  # two runs at once may both have scanned a pair
                 .filter(F.size("findings") > 0).groupBy("blob")
                 .agg(F.flatten(F.collect_list("findings")).alias("spans")))  # one entry per rule
        placed = F.transform("spans", lambda s: F.struct(
            s["start"], order[s["kind"]].alias("rule"), s["end"], s["kind"]))
        known = known.select("blob", F.array_sort(placed).alias("spans"))
        paths = addressed(docs.select(id_col, text_col), text_col).select(id_col, "blob")
        return paths.join(known, "blob", "left").select(id_col, "blob", "spans")


def span_digest(found: DataFrame) -> DataFrame:
    """The query's columns from ``Ledger.findings``."""
    spans = F.coalesce(F.col("spans"), F.array().cast(dict(found.dtypes)["spans"]))
    as_text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE),
                        digest_of_strings(F.transform(base, as_text)).alias("base_sha256"),
                        F.array_join(F.transform(spans, as_text), ",").alias("spans"))
