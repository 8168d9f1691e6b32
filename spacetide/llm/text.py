"""What the text operators share: column names that cannot clash, row-wise Arrow mapping, folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words, as a character class body.
SPACE = r"\x20\x09-\x0D"
#: The same six characters as a string.
SPACES = " \t\n\x0b\x0c\r"
#: Text bytes that one step of a row-wise Python function gets at once (a longer text comes alone).
STEP_BYTES = 4 << 20


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names near ``names`` that no column of ``df`` has, so that extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, names: list[str], text: str) -> DataFrame:
    """``df`` less the columns that results of these names replace (the text column itself cannot be replaced)."""
    low = {n.lower() for n in names}
    if text.lower() in low:
        raise ValueError(f"the text column {text} cannot be a result")
    return df.drop(*[c for c in df.columns if c.lower() in low])


def fold(doc_id: Column, folds: int) -> Column:
    """``crc32(doc_id as text) mod folds``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text: Column) -> Column:
    """Words between white space as an array; null and blank texts give an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def steps(batch: pa.RecordBatch, column: int, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows holding about ``most`` bytes of text each."""
    if not batch.num_rows:
        return
    sizes = batch.column(column).cast(pa.large_binary())
    ends = np.frombuffer(sizes.buffers()[1], np.int64, batch.num_rows + 1, 8 * sizes.offset)
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + most, "right")) - 1)
        yield batch.slice(begin, min(end, batch.num_rows) - begin)
        begin = end


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def map_texts(df: DataFrame, text: str, fields: list[tuple[str, str, pa.DataType]], make: Callable[[], Callable], keep_text: bool = True, most: int = STEP_BYTES) -> DataFrame:
    """Append columns computed row by row from one text column, in Arrow batches inside the tasks.

    ``make()`` runs once per task and returns ``f(list of UTF-8 texts) -> list of columns`` for texts of about ``most`` bytes;
    ``fields`` gives each new column's name, Spark type and Arrow type. All columns of ``df`` pass through, the
    text only with ``keep_text``, and columns that have a new column's name not at all.
    """
    df = without(df, [name for name, _, _ in fields], text)
    place = df.columns.index(text)
    stay = [i for i in range(len(df.columns)) if keep_text or i != place]
    schema = T.StructType([df.schema.fields[i] for i in stay] + [T.StructField(name, T._parse_datatype_string(kind)) for name, kind, _ in fields])
    kinds = [kind for _, _, kind in fields]
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for part in steps(batch, place, most):
                made = [pa.array(x, kind) for x, kind in zip(apply(raw_texts(part.column(place))), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in stay], *made], names=names)

    return df.mapInArrow(run, schema)
