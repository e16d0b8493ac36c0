"""What the operators share around tables: lineage cuts, columns by their exact names, and how large a side may be broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalens.operators.tables import drop, new_path, numbered, scratch, shared_dir, tidy, written

__all__ = ["BROADCAST_BYTES", "column", "count_of", "drop", "hinted", "is_small", "new_path", "numbered", "scratch", "shared_dir", "slices", "tidy", "written"]

#: A side of a join is broadcast only if its rows, decoded, take at most this much; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Rows of an Arrow batch that a worker handles at once; it bounds memory.
ROWS = 1024


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        for at in range(0, rb.num_rows, ROWS):
            yield rb.slice(at, ROWS)


def is_small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a table made by written() may be broadcast: its rows are counted and, where their width is not fixed, their bytes
    added up."""
    width, varying = 16, []
    for f in df.schema:
        if isinstance(f.dataType, T.NumericType | T.BooleanType | T.DatetimeType):
            width += 8
        else:
            varying.append(F.octet_length(F.to_json(F.struct(column(df, f.name)))))
    more = sum(varying, F.lit(0)) if varying else F.lit(0)
    n, size = df.select(F.count("*"), F.coalesce(F.sum(more), F.lit(0))).first()
    return n * width + size <= most


def hinted(df: DataFrame) -> DataFrame:
    """A table made by written(), or columns made from one, to be broadcast in a join if it is small."""
    return F.broadcast(df) if is_small(df) else df


def count_of(text, characters: str):
    """How many of a text's characters are among these (a pattern is a third of the time of translate())."""
    return F.regexp_count(text, F.lit("[" + "".join("\\" + c if c in "\\[]^-&~" else c for c in characters) + "]"))


def column(df: DataFrame, name: str):
    """The column of exactly this name, whatever characters are in it."""
    return df["`" + name.replace("`", "``") + "`"]
