"""Operator 13: fill-in-middle transformation.

Each text becomes an array of UTF-32 code points. The code points get classes; where neighbouring classes differ a
unit begins, so flatnonzero of the comparison gives the boundaries. Two ranks, drawn from a hash of the row's id,
choose the boundaries between prefix, middle and suffix; the slices are encoded again and put together in one of
two orders round three marks, or the text stays as it is. The work is one pass of mapInArrow without a shuffle.

Units: "point", every code point is one; "word", runs of ASCII white space and of other characters; "line", lines
with their ends.

Defined cases: null counts as empty; an empty text, and one that holds a mark, stays plain; the decimal form of a
null id is empty text; a text of one unit can give an empty prefix, middle or suffix; rows that share an id are cut
by the same draws; other columns pass through `with_infill`, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..shipping import ship
from .common import documents, pieces, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred rows so many are transformed, and of a hundred of those so many put the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SPACES = np.array([32, 9, 10, 11, 12, 13], np.uint32)
MADE = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def letters(part: np.ndarray) -> str:
    return part.tobytes().decode("utf-32-le", "surrogatepass")


def boundaries(codes: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin, then the end of the text: always one more than there are units."""
    if unit == "point":
        classes = np.arange(len(codes))
    elif unit == "word":
        classes = np.isin(codes, SPACES).astype(np.int64)
    elif unit == "line":
        ends = codes == 10
        classes = np.cumsum(ends) - ends  # an end of line belongs to the line before it
    else:
        raise ValueError(f"unknown unit: {unit}")
    inner = np.flatnonzero(classes[1:] != classes[:-1]) + 1
    return np.concatenate([np.zeros(min(len(codes), 1), np.int64), inner, [len(codes)]])


def draws(doc_id) -> list[int]:
    """Four numbers of 32 bits from the id."""
    digest = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def transform(text: str, doc_id, unit: str = "point") -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output)."""
    codes = points(text)
    at = boundaries(codes, unit)
    n = len(at) - 1
    h1, h2, h3, h4 = draws(doc_id)
    if not n or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= TRANSFORMED:
        return n, "plain", None, None, text
    low, high = (int(at[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (letters(part) for part in (codes[:low], codes[low:high], codes[high:]))
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text before it was transformed: no piece holds a mark, and none can begin inside another mark."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, _, rest = output[len(first) :].partition(second)
    b, _, middle = rest.partition(MIDDLE)
    return a + middle + b if form == "psm" else b + middle + a


def mapped(df: DataFrame, inputs: list[F.Column], name: str, kind: T.DataType, fn) -> DataFrame:
    """df with one more column, or a new one in its place: fn of each row's inputs. All other columns pass through."""
    spark = ship(df.sparkSession)
    small_batches(spark)
    kept, width = [f for f in df.schema.fields if f.name != name], len(inputs)
    own = "".join(["_", *df.columns])  # no column's name
    sent = df.select(*(F.col(f"`{f.name}`") for f in kept), *(c.alias(f"{own}{k}") for k, c in enumerate(inputs)))

    def run(batches):
        for b in pieces(batches, 256):
            made = [fn(*row) for row in zip(*(b.column(len(kept) + k).to_pylist() for k in range(width)), strict=True)]
            yield pa.record_batch([*b.columns[: len(kept)], pa.array(made, to_arrow_type(kind))], [*b.schema.names[: len(kept)], name])

    return sent.mapInArrow(run, T.StructType([*kept, T.StructField(name, kind)]))


def with_infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "infill", unit: str = "point") -> DataFrame:
    """docs with a struct column: n (units), form, prefix_chars, middle_chars and output, the transformed text."""
    cut = lambda doc_id, text: dict(zip(MADE.names, transform(text, doc_id, unit), strict=True))
    return mapped(docs, [docs[id_col].cast("string"), F.coalesce(docs[text_col], F.lit(""))], name, MADE, cut)


def with_restored(docs: DataFrame, infill_col: str = "infill", name: str = "restored") -> DataFrame:
    """docs with the text rebuilt from output and form alone."""
    return mapped(docs, [docs[infill_col]["output"], docs[infill_col]["form"]], name, T.StringType(), restored)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = with_restored(with_infill(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return made.select("doc_id", "infill.n", "infill.form", "infill.prefix_chars", "infill.middle_chars", digest("infill.output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


OP13_SQL = f"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         list_transform(range(4), lambda k: CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8 * k + 1, 8) AS BIGINT)) AS h
  FROM documents),
formed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
         CASE WHEN n = 0 OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h[3] % 100 >= {TRANSFORMED} THEN 'plain'
              WHEN h[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
cut AS (
  SELECT *, substr(text, 1, low) AS p, substr(text, low + 1, high - low) AS m, substr(text, high + 1) AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
