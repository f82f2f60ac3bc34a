"""Fill-in-the-middle transformation: texts are cut at token boundaries and their middle is moved to the end.

Each text is decoded to an array of UTF-32 code points. A token is a run of white space with the word behind it, or
white space at the end, so that a boundary is where a word's character stands before a white one: neighbouring classes
are compared, `flatnonzero` gives the boundaries, and the two ranks that the row's hash chooses are looked up in them.
The three pieces are slices of the array, encoded again. Rows do not meet: there is no shuffle.

The choice is made by `sha256(seed:key)`: its first two 8-digit groups give the cuts, the third whether the text is
changed at all (`rate` of 100), the fourth its form (`suffix_first` of 100).

Defined results: a null text is an empty one; an empty text, one that holds a mark and a row without an id stay as they
are (`plain`); a text of white space is one token; bytes that are no UTF-8 are carried through unchanged; rows equal in
id have equal choices; texts of any length are read whole; other columns of any name are not looked at; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import keyed, table

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Where tokens end, from 0, the end of none, to the text's end: entry k is the place behind k tokens."""
    if not len(codes):
        return np.zeros(1, np.int64)
    white = (codes == 32) | ((codes >= 9) & (codes <= 13))
    return np.concatenate(([0], np.flatnonzero(~white[:-1] & white[1:]) + 1, [len(codes)]))


def choices(seed: int, key: int) -> list[int]:
    """The four numbers that decide about the row of a key."""
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]


def moved(key: int | None, raw: bytes, seed: int, rate: int, suffix_first: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of prefix and middle, output) of one text."""
    codes = np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = boundaries(codes)
    n = len(at) - 1
    if not n or key is None or any(mark.encode() in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    h1, h2, h3, h4 = choices(seed, key)
    if h3 % 100 >= rate:
        return n, "plain", None, None, raw
    lo, hi = sorted((int(at[h1 % (n + 1)]), int(at[h2 % (n + 1)])))
    prefix, middle, suffix = (part.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape") for part in (codes[:lo], codes[lo:hi], codes[hi:]))
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < suffix_first:
        return n, "spm", lo, hi - lo, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", lo, hi - lo, b"".join((p, prefix, s, suffix, m, middle))


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, number of tokens, form (plain, psm or spm), code points of prefix and middle, and the output."""

    def run(batches):
        for batch in batches:
            for part in ta.slices(batch, "text"):
                texts = part.column("text").cast(pa.large_binary())
                rows = [moved(k, t or b"", seed, rate, suffix_first) for k, t in zip(part.column("doc_id").to_pylist(), texts.to_pylist(), strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return keyed(docs, key, text).mapInArrow(run, RESULT).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No mark stands in a changed text, and none can arise where a piece meets a
    mark, so that each mark's only place is its own."""

    def parts(first: str) -> tuple[Column, Column, Column]:
        rest = F.split_part(output, F.lit(first), F.lit(2))
        return F.substring(F.split_part(output, F.lit(first), F.lit(1)), 4, (1 << 31) - 1), F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))

    prefix, suffix, middle = parts(SUFFIX)
    suffix_, prefix_, middle_ = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = {
    "op12_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
k AS (SELECT *, len(w) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 IS NULL OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(w[1:lo], '') AS pre, array_to_string(w[lo + 1:hi], '') AS mid, array_to_string(w[hi + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
