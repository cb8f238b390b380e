"""SG9: work on rows in child processes, so that a row which fails, hangs or kills its process becomes an error of its own."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType


def _child(work: Callable[[dict], dict], rows: list[dict], out) -> None:
    for row in rows:
        try:
            got = (work(row), None)
        except Exception as e:
            got = (None, f"{type(e).__name__}: {e}"[:200])
        out.send(got)
    out.close()


def _dicts(b: pa.RecordBatch) -> list[dict]:
    """Rows of a batch; arrays of floats and doubles stay as they lie, others become Python values."""

    def values(c: pa.Array) -> list:
        if pa.types.is_list(c.type) and pa.types.is_floating(c.type.value_type):
            return [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in c]
        return c.to_pylist()

    columns = [values(b.column(i)) for i in range(b.num_columns)]
    return [dict(zip(b.schema.names, r, strict=True)) for r in zip(*columns, strict=True)]


def outcomes(work: Callable[[dict], dict], rows: list[dict], seconds: float) -> list[tuple[dict | None, str | None]]:
    """(result, error) of each row. A child works through the rows and sends back each result; when it dies or takes too
    long, that is the row's error it was at, and another child goes on behind it."""
    fork, out = multiprocessing.get_context("fork"), []
    while len(out) < len(rows):
        mine, theirs = fork.Pipe(duplex=False)
        child = fork.Process(target=_child, args=(work, rows[len(out) :], theirs), daemon=True)
        child.start()
        theirs.close()
        try:
            while len(out) < len(rows):
                if not mine.poll(seconds):
                    out.append((None, f"no result after {seconds:g} s"))
                    break
                out.append(mine.recv())
        except EOFError:
            child.join()
            out.append((None, f"process ended with {child.exitcode}"))
        finally:
            mine.close()
            if child.is_alive() and len(out) < len(rows) or out and out[-1][1] and out[-1][1].startswith("no result"):
                child.kill()
            child.join()
    return out


def isolated(rows: DataFrame, keys: list[str], work: Callable[[dict], dict], schema: StructType, seconds: float = 45.0, together: int = 64) -> DataFrame:
    """``keys``, the fields of ``work``'s result, and ``error``, for each row; nothing a row does fails its task.

    ``work`` takes a row as a dict of Python values, but of numpy arrays for arrays of floats and doubles, and returns a dict
    of the schema's fields. A row with an error has nulls. ``seconds`` is the most one row may take, ``together`` the rows of one child.
    """
    kinds = StructType([*[rows.schema[k] for k in keys], *[StructField(f.name, f.dataType, True) for f in schema], StructField("error", StringType())])
    arrow, names = to_arrow_schema(kinds), schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, together):
                part = _dicts(b.slice(s, together))
                got = outcomes(work, part, seconds)
                lines = [{**{k: r[k] for k in keys}, **{n: (x or {}).get(n) for n in names}, "error": e} for r, (x, e) in zip(part, got, strict=True)]
                yield pa.RecordBatch.from_pylist(lines, schema=arrow)

    return rows.mapInArrow(run, kinds)
