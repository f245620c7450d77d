"""Fill-in-middle transformation: a text is cut in prefix, middle and suffix, and put together with the middle last.

Cuts are numbers of units, a unit being a code point. A text is encoded as its maximal runs of characters of one class, the class being the bytes that
a character takes in UTF-8. A run is stored with the units and the bytes before it, both cumulative; in a run all units have the same width. So
the place of a cut is found by binary search for the run that contains it, and by arithmetic inside the run: no text is walked to a
cut. `runs` gives the encoding as a column, `infill` uses it for whole batches.

The document's id and a seed decide by a hash where the cuts are and which form the output takes: plain (the text), psm (prefix, suffix, middle) or
spm (suffix, prefix, middle), each part behind its sentinel. Texts that are empty or hold a sentinel stay plain, so that `restored` gives every text back exactly.

A null text is an empty one. A null id counts like an empty id; rows that repeat an id are cut by the same hash, each on its own text. Texts of any length are
taken whole, batches end by bytes. Empty tables give an empty result. The results take the place of columns of their names in any case; all other columns are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.shared import fresh, lean, slices, text_bytes

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")
#: Bytes of a UTF-8 character by its first byte; 0 for bytes inside a character.
_WIDTH = np.repeat(np.array([1, 0, 2, 3, 4], dtype=np.uint8), [128, 64, 32, 16, 16])


@dataclass
class Runs:
    """Runs of some texts, one after the other: units and bytes before each (from the first text's start) and the width of its units; first run, unit and byte by text, with one entry more."""

    unit: np.ndarray
    byte: np.ndarray
    width: np.ndarray
    first: np.ndarray
    units: np.ndarray
    bytes: np.ndarray

    def place(self, text: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The byte (from the first text's start) at which unit `cut` of each text starts; its end, if it has no such unit."""
        unit = self.units[text] + cut
        run = np.searchsorted(self.unit, unit, side="right") - 1
        inside = self.byte[run] + (unit - self.unit[run]) * self.width[run] if len(self.unit) else np.zeros(len(text), np.int64)
        return np.where(unit < self.units[text + 1], inside, self.bytes[text + 1])


def encode(data: np.ndarray, offsets: np.ndarray) -> Runs:
    """The runs of texts with UTF-8 data and offsets."""
    widths = _WIDTH[data]
    at = np.flatnonzero(widths)
    widths = widths[at]
    units = np.searchsorted(at, offsets)
    starts = np.ones(len(at), dtype=bool)
    starts[1:] = widths[1:] != widths[:-1]
    starts[units[:-1][units[:-1] < len(at)]] = True
    unit = np.flatnonzero(starts)
    return Runs(unit, at[unit].astype(np.int64), widths[unit].astype(np.int64), np.searchsorted(unit, units), units.astype(np.int64), offsets)


def _source(documents: DataFrame) -> str:
    """The column text, as it is written."""
    return next(c for c in documents.columns if c.lower() == "text")


def runs(documents: DataFrame) -> DataFrame:
    """documents with runs: array of (unit, byte, width), the units and bytes before each run and the bytes of its units."""
    schema = documents.select(*[c for c in documents.columns if c.lower() != "runs"]).schema
    source = _source(documents)
    keep, kind = list(schema.names), pa.struct([("unit", pa.int64()), ("byte", pa.int64()), ("width", pa.int32())])
    schema = schema.add("runs", T.ArrayType(T.StructType([T.StructField("unit", T.LongType()), T.StructField("byte", T.LongType()), T.StructField("width", T.IntegerType())])))

    def run(batches):
        for batch in batches:
            for part in slices(batch, source):
                r = encode(*text_bytes(part.column(source)))
                each = np.repeat(np.arange(part.num_rows), np.diff(r.first))
                rows = pa.StructArray.from_arrays([pa.array(r.unit - r.units[each]), pa.array(r.byte - r.bytes[each]), pa.array(r.width.astype(np.int32))], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.ListArray.from_arrays(pa.array(r.first.astype(np.int32)), rows)], names=schema.names)

    return documents.select(*keep).mapInArrow(lean(run), schema)


def hashes(key: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers that the id and the seed decide."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return [F.conv(F.substring(F.sha2(F.encode(text, "utf-8"), 256), 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def infill(documents: DataFrame, plain_percent: int = 10, spm_percent: int = 20, seed: int = 1, key: str = "doc_id") -> DataFrame:
    """documents with n (units of the text), form, prefix_chars and middle_chars (units; null if plain) and output."""
    keep = [c for c in documents.columns if c.lower() not in RESULTS]
    draws, source = fresh(documents, "draws"), _source(documents)
    schema = documents.select(*keep).schema
    for field in ("n long", "form string", "prefix_chars long", "middle_chars long", "output string"):
        schema = schema.add(*field.split())
    sentinels = [s.encode() for s in SENTINELS]
    p, s, m = sentinels

    def run(batches):
        for batch in batches:
            for part in slices(batch, source):
                data, offsets = text_bytes(part.column(source))
                r = encode(data, offsets)
                text, n = np.arange(part.num_rows), np.diff(r.units)
                h = np.array(part.column(draws).flatten(), dtype=np.int64).reshape(-1, 4)
                cuts = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
                begin, end = r.place(text, cuts[:, 0]), r.place(text, cuts[:, 1])
                whole, spans, forms, out = data.tobytes(), zip(offsets[:-1].tolist(), begin.tolist(), end.tolist(), offsets[1:].tolist(), strict=True), [], []
                stay, turn = (h[:, 2] % 100 >= 100 - plain_percent).tolist(), (h[:, 3] % 100 < spm_percent).tolist()
                for i, (a, b, c, d) in enumerate(spans):
                    if a == d or stay[i] or any(whole.find(x, a, d) >= 0 for x in sentinels):
                        forms.append(PLAIN)
                        out.append(whole[a:d])
                    else:
                        forms.append(SPM if turn[i] else PSM)
                        before, middle, after = p + whole[a:b], m + whole[b:c], s + whole[c:d]
                        out.append(after + before + middle if turn[i] else before + after + middle)
                cut = np.array([f == PLAIN for f in forms], dtype=bool)
                columns = [pa.array(n), pa.array(forms, pa.string()), pa.array(cuts[:, 0], mask=cut), pa.array(cuts[:, 1] - cuts[:, 0], mask=cut), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *columns], names=schema.names)

    drawn = documents.withColumn(draws, F.array(*hashes(key, seed)))
    return drawn.select(*keep, draws).mapInArrow(lean(run), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that `infill` made output of. No part of it holds a sentinel, so each sentinel stands where it was put."""
    part = lambda x, sentinel, i: F.split_part(x, F.lit(sentinel), F.lit(i))
    head, middle = part(output, MIDDLE, 1), part(output, MIDDLE, 2)
    psm = F.concat(part(part(head, SUFFIX, 1), PREFIX, 2), middle, part(head, SUFFIX, 2))
    spm = F.concat(part(head, PREFIX, 2), middle, part(part(head, PREFIX, 1), SUFFIX, 2))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def op12_infilling(spark, sf_dir: str) -> DataFrame:
    """Cuts and hashes of every document's output and of the text rebuilt from it."""
    made = infill(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    sha = lambda x: F.sha2(F.encode(x, "utf-8"), 256)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


OP12_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
    list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(sha256('1:' || doc_id), i, 8))::BIGINT) AS h FROM documents),
cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts),
back AS (
  SELECT *, CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN split_part(split_part(output, '<S>', 1), '<P>', 2) || split_part(output, '<M>', 2) || split_part(split_part(output, '<M>', 1), '<S>', 2)
    ELSE split_part(split_part(output, '<M>', 1), '<P>', 2) || split_part(output, '<M>', 2) || split_part(split_part(output, '<P>', 1), '<S>', 2) END AS r FROM made)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256, sha256(r) AS restored_sha256 FROM back
"""
