"""CSV with malformed records in two outputs: rows, and a quarantine.

A line whose number of fields differs from the header's is not read as it stands, because its fields would
fall into the wrong columns. Commas that should have been quoted make a line too long: its fields are
put together again by dynamic programming over (column, field). A text column may take one or more
neighbouring unquoted fields, a column of another type exactly one that reads as its type (or is blank or NA).
If there is exactly one such alignment the line is mended; with several it is ambiguous, with none
it fits no alignment, and a line with too few fields is short: these go to the quarantine as they were, with
the reason. So no field is lost, and none is guessed.

Whole lines are read and counted by Spark; only lines that do not fit pass through the alignment, whose
work is linear in their fields. Quoted line breaks need ``multi_line`` readers and are not handled here: the
parts of such a record are lines of their own, and short.

Defined results: an empty file gives no rows; blank lines are skipped, as by the reader; a quote that is not
closed, or that is followed by other text, is one reason ("quotes"); a field that does not read as its
column's type in a line of the right length is NULL, as everywhere in these readers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, IntegralType, NumericType, StringType, StructField, StructType

from auditspark.operators.ordered import materialize
from auditspark.sources.csv import RECORD, read_csv

_FIELD = re.compile(r'(?:"((?:[^"]|"")*)"|([^",][^,]*|))(?=,|$)')
_WHOLE = re.compile(r"\s*[+-]?[0-9]+\s*")
_NUMBER = re.compile(r"\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*")
_DATE = re.compile(r"\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\s*")
MISSING = ("", "NA")


def split_line(line: str) -> list[tuple[str, bool]] | None:
    """Fields of a line and whether they were quoted; None if its quotes do not pair up."""
    out, at = [], 0
    while True:
        m = _FIELD.match(line, at)
        if m is None:
            return None
        out.append((m[1].replace('""', '"'), True) if m[1] is not None else (m[2], False))
        at = m.end()
        if at == len(line):
            return out
        at += 1  # the comma


def reads_as(kind: DataType) -> Callable[[str], bool] | None:
    """Whether a field can be of a column's type; None for text, which takes anything."""
    if isinstance(kind, StringType):
        return None
    pattern = _WHOLE if isinstance(kind, IntegralType) else _NUMBER if isinstance(kind, NumericType) else (
        _DATE if isinstance(kind, DateType) else None)
    if pattern is None:
        raise ValueError(f"no rule for fields of type {kind.simpleString()}")
    return lambda field: field in MISSING or pattern.fullmatch(field) is not None


def align(fields: list[tuple[str, bool]], checks: list[Callable[[str], bool] | None]) -> tuple[str, list[str] | None]:
    """("aligned", values), or ("short" | "none" | "ambiguous", None)."""
    k, m = len(checks), len(fields)
    if m < k:
        return "short", None
    # ways[j]: alignments of the columns so far with the first j fields, 2 standing for more; joined[i][j]: whether
    # column i, ending with field j, can begin at it (1), earlier (2) or both (3).
    spare = m - k
    ways = [1] + [0] * m
    how: list[bytearray] = []
    for i, check in enumerate(checks):
        now, marks, run = [0] * (m + 1), bytearray(spare + 1), 0
        for j in range(i + 1, i + spare + 2):
            text, quoted = fields[j - 1]
            one = ways[j - 1] if check is None or check(text) else 0
            # A run goes on if both this field and the ones it joins are unquoted; ``run`` counts ways into it.
            more = run if check is None and not quoted else 0
            run = 0 if quoted else min(2, more + ways[j - 1])
            now[j] = min(2, one + more)
            marks[j - i - 1] = (1 if one else 0) | (2 if more else 0)
        how.append(marks)
        ways = now
    if ways[m] != 1:
        return ("ambiguous" if ways[m] else "none"), None
    values, j = [], m
    for i in range(k - 1, -1, -1):
        parts = [fields[j - 1][0]]
        # The one way is walked back: a mark of 2 alone says that the column began earlier.
        while how[i][j - i - 1] == 2:
            j -= 1
            parts.append(fields[j - 1][0])
        values.append(",".join(reversed(parts)))
        j -= 1
    return "aligned", values[::-1]


def _mended(lines: DataFrame, schema: StructType) -> DataFrame:
    """outcome, line and values (of aligned lines) of whole lines that do not fit the header."""
    kinds = [f.dataType for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checks = [reads_as(k) for k in kinds]
        for batch in batches:
            results = []
            for line in batch.column(0).to_pylist():
                fields = split_line(line)
                results.append(("quotes", None) if fields is None else align(fields, checks))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r for r, _ in results], pa.string()),
                                              pa.array([v for _, v in results], pa.list_(pa.string()))], ["line", "outcome", "values"])

    return lines.mapInArrow(run, "line string, outcome string, values array<string>")


def _typed(field: StructField, value: Column) -> Column:
    if isinstance(field.dataType, StringType):
        return F.when(value != "NA", value).alias(field.name)
    return F.trim(value).try_cast(field.dataType).alias(field.name)


def read_aligned(spark: SparkSession, path: str, schema: StructType, profile: str = "base",
                 encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """Rows of the declared types with their ``outcome`` ("row" or "aligned"), and the quarantine: ``outcome`` (the
    reason) and ``line`` of every line that is none."""
    text = StructType([StructField(f.name, StringType()) for f in schema.fields])
    # The reader hands over the line when its number of fields is wrong, which it sees only while it parses all of them: the
    # parsed table is written once, and both outputs read from that, whatever columns are asked of them.
    read = materialize(read_csv(spark, path, schema=text, profile=profile, keep_corrupt=True, encoding=encoding))
    fitting = read.where(F.col(RECORD).isNull())
    mended = materialize(_mended(read.where(F.col(RECORD).isNotNull()).select(RECORD), schema))
    rows = fitting.select(F.lit("row").alias("outcome"), *[_typed(f, F.col(f"`{f.name}`")) for f in schema.fields])
    more = mended.where(F.col("values").isNotNull()).select(
        "outcome", *[_typed(f, F.col("values")[i]) for i, f in enumerate(schema.fields)])
    return rows.unionByName(more), mended.where(F.col("values").isNull()).select("outcome", "line")
