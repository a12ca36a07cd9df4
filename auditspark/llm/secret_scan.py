"""Secret scans with an incremental blob ledger.

Every historical version of a file is content-addressed: its blob is the SHA-256 of its text. The
ledger is a folder of two Parquet tables, ``scanned`` (blob, rule, version) and ``findings`` (blob,
rule, version, start, end). A scan reads the versions and asks the ledger, by blob ids alone, which (blob, rule
version) pairs are due. Only texts of due blobs are shuffled, one per blob (map-side first, so a text that a
third of all rows hold is shuffled once per task); they are scanned, the ledger is appended to, and findings are joined
back to every path by blob id. A run over versions that the ledger knows moves no text. Raising a rule's version
scans all blobs again for that rule alone.

Both tables of a run are written before the run's entry in ``scanned`` is; a run that dies between
leaves findings that the next run writes again under its own batch, and readers take distinct rows.

All patterns take time in proportion to the text: runs are entered at their start only.

Spans are code points, end exclusive. Defined results: a null text is empty and has no findings;
repeated rows each get their blob's findings; an empty table gives an empty result; only the key
and text columns are read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.common import checkpoint_dir, stage

#: Fixed by the contract: kinds in order, their patterns, and the least length that counts.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
#: Maximal runs, so asking for the least length in the pattern drops the same matches.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Rules of the operator's own.
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+")

RULES: dict[str, tuple[int, re.Pattern, int, int]] = {
    # kind: (version, pattern, group whose length counts, least length)
    "assign": (1, ASSIGN, 2, 12),
    "access": (1, ACCESS, 0, 18),
    "hex": (1, HEX, 0, 16),
    "pem": (1, PEM, 0, 0),
    "jwt": (2, JWT, 0, 0),
}
KINDS = tuple(RULES)

SCANNED = "blob string, rule string, version int"
FINDINGS = "blob string, rule string, version int, start int, end int"


def find_spans(text: str, kind: str, rules=RULES) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of one rule that are long enough."""
    _, pattern, group, least = rules[kind]
    return [m.span() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def blob_id(text) -> F.Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def scan(versions: DataFrame, ledger: str, text_col: str = "text", rules=RULES) -> DataFrame:
    """Bring the ledger in ``ledger`` up to date with ``versions``; return all findings of the
    current rule versions for blobs known to it (blob, rule, start, end)."""
    spark = versions.sparkSession
    current = spark.createDataFrame([(k, v[0]) for k, v in rules.items()], "rule string, version int")
    names = F.array(*[F.concat_ws("@", F.lit(k), F.lit(v[0])) for k, v in rules.items()])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = versions.select(blob_id(F.col(text_col)).alias("blob"), text.alias("text"))
    seen = (_read(spark, f"{ledger}/scanned", SCANNED)
            .groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("seen")))
    asked = stage(rows.select("blob").distinct().join(seen, "blob", "left")
                  .select("blob", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))).alias("due")))
    due = asked.where(F.size("due") > 0)
    n_due, n_all = due.count(), asked.count()
    if n_due:
        # first() of a text needs no comparison; the partial aggregate leaves one row per blob and task. If most blobs are
        # due, grouping comes first, as it deals the texts out by blob anyway; else only due texts get that far.
        if 2 * n_due > n_all:
            todo = rows.groupBy("blob").agg(F.first("text").alias("text")).join(due, "blob")
        else:
            todo = rows.join(due, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("due").alias("due"))
        _extend(todo.select("blob", "text", "due"), ledger, rules)
    return (_read(spark, f"{ledger}/findings", FINDINGS).distinct().join(F.broadcast(current), ["rule", "version"])
            .select("blob", "rule", "start", "end"))


def _extend(todo: DataFrame, ledger: str, rules) -> None:
    """Scan the due pairs of ``todo`` (blob, text, due) and append them to the ledger."""
    spark = todo.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for blob, body, due in zip(*(c.to_pylist() for c in batch.columns)):
                for name in due:
                    kind, version = name.split("@")
                    # A row without a span records that the pair has been scanned.
                    out.append((blob, kind, int(version), None, None))
                    out += [(blob, kind, int(version), a, b) for a, b in find_spans(body, kind, rules)]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()))],
                ["blob", "rule", "version", "start", "end"])

    batch_id = uuid.uuid4().hex
    raw = f"{ledger}/batches/{batch_id}"
    todo.mapInArrow(run, FINDINGS).write.parquet(raw)
    fresh = spark.read.schema(FINDINGS).parquet(raw)
    fresh.where(F.col("start").isNotNull()).write.mode("append").parquet(f"{ledger}/findings")
    fresh.where(F.col("start").isNull()).select("blob", "rule", "version").write.mode("append").parquet(f"{ledger}/scanned")
    target = spark._jvm.org.apache.hadoop.fs.Path(raw)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spans_by_blob(findings: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """One row per blob with findings: its spans ordered by start, then kind as listed, then end.

    Gathers the spans of one text, so a row is bounded by that text."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("rule")).cast("int")
    return (findings.groupBy("blob")
            .agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "rule"))).alias("found")))


def new_ledger(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/ledger-{uuid.uuid4().hex}"


def scan_documents(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, blob and ``found`` (array of start, rank, end, rule; null if none) of every row."""
    ledger = ledger or new_ledger(docs.sparkSession)
    # Written, so that the join below has a side of known size and a hot blob's rows can be split.
    by_blob = stage(spans_by_blob(scan(docs, ledger)))
    paths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob_id(F.col("text")).alias("blob"))
    return paths.join(by_blob, "blob", "left").select("doc_id", "blob", "found")


MASK = "[SECRET]"


def mask(text: F.Column, spans: F.Column, mask_text: str = MASK) -> F.Column:
    """``text`` with every span of ``spans`` (start, end; by start) replaced; overlapping ones merge. Texts without spans
    (a null) stay in the JVM; the others are cut once from front to back."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series, found: pd.Series) -> pd.Series:
        out: list[str | None] = []
        for body, own in zip(texts, found):
            if body is None or own is None:
                out.append(None)
                continue
            parts, at = [], 0
            for span in own:
                if span["start"] >= at:
                    parts += [body[at:span["start"]], mask_text]
                at = max(at, span["end"])
            out.append("".join([*parts, body[at:]]))
        return pd.Series(out, dtype=object)

    return F.coalesce(masked(F.when(spans.isNotNull(), text), spans), text)
