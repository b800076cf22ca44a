"""Arrow batches cut by bytes, so that a Python task holds a bounded amount of text however long its rows are."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Pieces of each batch whose ``column`` holds about ``limit`` bytes (one row at least), with its texts; null reads as empty."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for at, size in enumerate(lengths):
            if held and held + size > limit:
                yield _piece(batch, column, start, at)
                start, held = at, 0
            held += size
        if start < batch.num_rows:
            yield _piece(batch, column, start, batch.num_rows)


def _piece(batch: pa.RecordBatch, column: str, start: int, end: int) -> tuple[pa.RecordBatch, list[str]]:
    piece = batch.slice(start, end - start)
    return piece, [t or "" for t in piece.column(column).to_pylist()]


def extended(piece: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The rows of ``piece`` with further columns; a column of the same name is replaced."""
    kept = [(n, piece.column(n)) for n in piece.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*[c for _, c in kept], *columns.values()], [*[n for n, _ in kept], *columns])


def add_columns(rows: DataFrame, text: str, added: Sequence[T.StructField], run: Callable[[Iterator[pa.RecordBatch], str], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``rows`` with further columns that ``run`` puts on each piece; it is told the name under which it finds ``text``.

    Columns of the same names are replaced. Columns go by number meanwhile, since Arrow functions take no name with a dot.
    """
    new = {f.name for f in added}
    names = [f.name for f in rows.schema]
    plain = rows.toDF(*[f"_in{i}" for i in range(len(names))])
    own = f"_in{names.index(text)}"
    out = plain.mapInArrow(lambda batches: run(batches, own), T.StructType([*plain.schema, *added]))
    kept = [i for i, name in enumerate(names) if name not in new]
    return out.select(*[f"_in{i}" for i in kept], *[f.name for f in added]).toDF(*[names[i] for i in kept], *[f.name for f in added])


def quoted(name: str) -> str:
    """A column name as an expression that reads it, dots and all."""
    return "`" + name.replace("`", "``") + "`"
