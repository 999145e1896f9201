"""Fill-in-the-middle transformation with a sparse index of multibyte characters.

A text is cut at two unit borders (a unit is a run of ASCII letters or any other single character), and prefix, suffix and middle
are put in the order of its form, each behind its marker. Unit borders are found on the UTF-8 bytes. The index holds
only the multibyte characters: where each lies and how many bytes it has beyond one. Between them code points and
bytes run in step, so one searchsorted in the index converts a border from bytes to code points or back, and text
that is all ASCII has an empty index.

What is cut and how it is put follows from sha256 of seed and doc_id, so a row gives the same result on every run and machine. Null
and empty texts, and texts that hold a marker, stay plain. A null doc_id counts as the empty string. Repeated rows give repeated
results. Very long texts are cut whole, one step each. Empty table: no rows. Clashing further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, small_batches, table, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts: how many are transformed, and how many of those put the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
TURNED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_MARKS = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


class Exceptions:
    """The multibyte characters of UTF-8 bytes: their byte positions, and the excess bytes of all before each."""

    def __init__(self, data: np.ndarray):
        self.bytes = np.flatnonzero(data >= 0xC0)
        lead = data[self.bytes]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype=np.int64)])
        self.chars = self.bytes - self.excess[:-1]

    def to_chars(self, at: np.ndarray) -> np.ndarray:
        """Code points before byte borders."""
        return at - self.excess[np.searchsorted(self.bytes, at)]

    def to_bytes(self, at: np.ndarray) -> np.ndarray:
        """Bytes before code-point borders."""
        return at + self.excess[np.searchsorted(self.chars, at)]


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where units begin, and the first unit of each text (and one past the last)."""
    begins = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(begins)
    return at, np.searchsorted(at, offsets)


def drawn(doc_id: int | None, seed: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def _turned(ids: list[int | None], texts: pa.Array, seed: str) -> list[tuple]:
    data, offsets = utf8(texts)
    at, first = units(data, offsets)
    whole, n = data.tobytes(), np.diff(first)
    hashes = [drawn(i, seed) for i in ids]
    ends = np.append(at, len(data))
    picks = np.array([sorted((h[0] % (int(m) + 1), h[1] % (int(m) + 1))) for h, m in zip(hashes, n, strict=True)], np.int64).reshape(-1, 2)
    own = first[:-1, None] + picks
    borders = np.where(picks < n[:, None], ends[own], offsets[1:, None])
    chars = Exceptions(data).to_chars(np.column_stack([offsets[:-1], borders]))
    out = []
    for k, (doc_id, h) in enumerate(zip(ids, hashes, strict=True)):
        a, b = int(offsets[k]), int(offsets[k + 1])
        text = whole[a:b]
        if not text or h[2] % 100 >= TRANSFORMED or any(m in text for m in _MARKS):
            out.append((doc_id, int(n[k]), "plain", None, None, text))
            continue
        x, y = int(borders[k, 0]) - a, int(borders[k, 1]) - a
        prefix, middle, suffix = _MARKS[0] + text[:x], _MARKS[2] + text[x:y], _MARKS[1] + text[y:]
        form = "spm" if h[3] % 100 < SUFFIX_FIRST else "psm"
        out.append((doc_id, int(n[k]), form, int(chars[k, 1] - chars[k, 0]), int(chars[k, 2] - chars[k, 1]), (suffix + prefix if form == "spm" else prefix + suffix) + middle))
    return out


def fill_in_middle(docs: DataFrame, seed: str = "1") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain) and output of every
    row of docs (doc_id, text). Rows are worked on where they lie; none is shuffled."""
    small_batches(docs.sparkSession)
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in TURNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "text"):
            rows = _turned(piece.column("doc_id").to_pylist(), piece.column("text"), seed)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()).cast(t) if n == "output" else pa.array(c, t) for c, t, n in zip(zip(*rows, strict=True), types, names, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TURNED)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that output was made of. A transformed text holds no marker, and no marker can arise where a part meets one, so the first occurrence of each is the one that was put there."""
    o = F.col(output)
    p, s, m = (F.instr(o, F.lit(x)) for x in (PREFIX, SUFFIX, MIDDLE))
    psm = F.concat(F.substring(o, F.lit(4), s - 4), F.substring(o, m + 3, F.length(o)), F.substring(o, s + 3, m - s - 3))
    spm = F.concat(F.substring(o, p + 3, m - p - 3), F.substring(o, m + 3, F.length(o)), F.substring(o, F.lit(4), p - 4))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(o)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = fill_in_middle(table(spark, sf_dir, "documents"))
    return turned.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
      CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
      text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 AS plain FROM u),
p AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS pre, coalesce(array_to_string(units[a + 1:b], ''), '') AS mid, coalesce(array_to_string(units[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN h4 % 100 < 20 THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
