r"""Fill-in-the-middle: texts cut at word boundaries and rearranged around sentinels, as a pyarrow.compute pipeline.

A unit is a word with the white space before it, or white space at the end of the text. Per block of a batch the units
become one list array; it is flattened with its parent indices, the ordinal of a unit in its text tells its role (prefix,
middle or suffix), each role is filtered out and rebuilt as lists, and the pieces are joined by binary_join. The two
places of the cut, the choice of texts and of the form come from SHA-256 of `seed:doc_id`, so they depend on nothing else.

Edge cases: null and empty texts are plain and come out as the empty text; texts that hold a sentinel stay plain, so every
output can be turned back; a null doc_id is drawn as the empty string; rows that repeat an id share their draw, each row
is transformed by itself; a middle or a suffix may be empty; an empty table gives an empty result; extra columns are
ignored. Texts are taken whole: a block holds whole texts, one very long text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelloom.llm._spark import read

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_WORD = r"[^\x20\x09-\x0D]+"
#: A byte that no UTF-8 text holds; it marks the end of a word while a text is split.
_MARK = b"\xff"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _remainder(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _joined(pieces: pa.Array, counts: pa.Array) -> pa.Array:
    """One binary per text from its `counts` consecutive pieces."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.asarray(counts))]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pieces), b"")


def cut_units(texts: pa.Array, first: pa.Array, second: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """Units per text, and the three texts that end after min and max of (first, second) modulo units + 1 units."""
    marked = pc.replace_substring_regex(texts, pattern=_WORD, replacement=rb"\0" + _MARK)
    # What follows the last mark is white space at the end, or nothing, which is no unit.
    lists = pc.split_pattern(marked, pattern=_MARK)
    units, parents = pc.list_flatten(lists), pc.cast(pc.list_parent_indices(lists), pa.int64())
    real = pc.greater(pc.binary_length(units), 0)
    units, parents = units.filter(real), parents.filter(real)
    n = pa.array(np.bincount(np.asarray(parents), minlength=len(texts)), pa.int64())
    before = pc.subtract(pc.cumulative_sum(n), n)
    ordinal = pc.subtract(pa.array(np.arange(len(units)), pa.int64()), before.take(parents))
    places = pc.add(n, 1)
    a, b = _remainder(first, places), _remainder(second, places)
    low, high = pc.min_element_wise(a, b), pc.max_element_wise(a, b)
    in_prefix, in_middle = pc.less(ordinal, low.take(parents)), pc.less(ordinal, high.take(parents))
    roles = [in_prefix, pc.and_not(in_middle, in_prefix), pc.invert(in_middle)]
    counts = [low, pc.subtract(high, low), pc.subtract(n, high)]
    return n, [_joined(units.filter(role), count) for role, count in zip(roles, counts)]


def arrange(texts: pa.Array, parts: list[pa.Array], form: pa.Array) -> pa.Array:
    """The output of each text under its form: plain, psm or spm."""
    prefix, middle, suffix = parts
    join = lambda *x: pc.binary_join_element_wise(*x, b"")
    p, s, m = (pa.scalar(x.encode(), pa.binary()) for x in (PREFIX, SUFFIX, MIDDLE))
    psm, spm = join(p, prefix, s, suffix, m, middle), join(s, suffix, p, prefix, m, middle)
    return pc.if_else(pc.equal(form, "plain"), texts, pc.if_else(pc.equal(form, "psm"), psm, spm))


def restored(output: pa.Array, form: pa.Array) -> pa.Array:
    """The original texts from outputs and forms: the three pieces between sentinels in their first order."""
    plain = pc.equal(form, "plain")
    pieces = pc.split_pattern_regex(pc.if_else(plain, f"{PREFIX}{SUFFIX}{MIDDLE}", output), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    one, two, last = (pc.list_element(pieces, i) for i in (1, 2, 3))
    psm = pc.equal(form, "psm")
    whole = pc.binary_join_element_wise(pc.if_else(psm, one, two), last, pc.if_else(psm, two, one), "")
    return pc.if_else(plain, output, whole)


def _blocks(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows of about `limit` bytes of text."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    low = 0
    while low < batch.num_rows:
        start = size[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(size, start + limit, side="right")))
        yield batch.slice(low, high - low)
        low = high


def _transform(fim_percent: int, spm_percent: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch, 1, limit):
                ids, text, h1, h2, h3, h4 = (block.column(i) for i in range(6))
                text = pc.fill_null(text, "")
                raw = pc.cast(text, pa.binary())
                n, parts = cut_units(raw, h1, h2)
                barred = pc.or_(pc.equal(pc.binary_length(text), 0), pc.match_substring_regex(text, f"{PREFIX}|{SUFFIX}|{MIDDLE}"))
                hundred = pa.array(np.full(len(text), 100), pa.int64())
                plain = pc.or_(barred, pc.greater_equal(_remainder(h3, hundred), fim_percent))
                form = pc.if_else(plain, "plain", pc.if_else(pc.less(_remainder(h4, hundred), spm_percent), "spm", "psm"))
                output = pc.cast(arrange(raw, parts, form), pa.string())
                chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(pc.cast(x, pa.string())), pa.int64())) for x in parts[:2]]
                yield pa.RecordBatch.from_arrays([ids, n, form, *chars, output], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: str = "42", fim_percent: int = 50, spm_percent: int = 80, id_column: str = "doc_id", text_column: str = "text", limit: int = 1 << 22) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    fim_percent: texts that are rearranged, of a hundred; spm_percent: those of them with the suffix first. limit: bytes
    of text in a block, which bounds the memory of a task together with the longest text.
    """
    own = F.col(id_column).cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    return docs.select(own.alias("doc_id"), F.col(text_column).alias("text"), *draws).mapInArrow(_transform(fim_percent, spm_percent, limit), SCHEMA)


def _restore(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("output")
            for block in _blocks(batch, at, limit):
                text = restored(block.column(at), block.column(block.schema.get_field_index("form")))
                yield pa.RecordBatch.from_arrays([*block.columns, text], names=[*block.schema.names, "restored"])

    return run


def restore(rows: DataFrame, limit: int = 1 << 22) -> DataFrame:
    """Adds `restored`, the text that (output, form) were made from."""
    return rows.mapInArrow(_restore(limit), StructType([*rows.schema.fields, StructField("restored", StringType())]))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, rearranged and turned back."""
    rows = restore(fill_in_middle(read(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u
  from documents
), k as (
  select *, len(u) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
         ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4
  from d
), f as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
              when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from k
), p as (
  select *, array_to_string(u[1:low], '') as a, array_to_string(u[low + 1:high], '') as m, array_to_string(u[high + 1:n], '') as s from f
)
select doc_id, n::bigint as n, form,
       case when form <> 'plain' then length(a) end::bigint as prefix_chars,
       case when form <> 'plain' then length(m) end::bigint as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || a || '<S>' || s || '<M>' || m
              else '<S>' || s || '<P>' || a || '<M>' || m end) as output_sha256,
       sha256(text) as restored_sha256
from p
"""


def queries() -> dict:
    return {"op12_infill": op12_infill}


def oracle_sql() -> dict[str, str]:
    return {"op12_infill": ORACLE}
