"""Vectors as integers, and blocks of them as single rows for work in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Integers must be smaller than 2**MAX_BITS, so that products and squared distances of up to 512 components fit a long.
MAX_BITS = 27


def usable(vector: Column | str) -> Column:
    """Whether there is a vector all of whose components are finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))), F.lit(False))


def integers(vector: Column | str) -> Column:
    """floor(SCALE * x) of each component of a usable vector; a component that is too large is an error, not a wrong result."""
    v = F.col(vector) if isinstance(vector, str) else vector

    def one(x: Column) -> Column:
        scaled = F.floor(x.cast("double") * SCALE)
        return F.when(F.abs(x.cast("double")) * SCALE < 2**MAX_BITS, scaled.cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact products")).cast("int"))

    return F.transform(v, one)


def arrow_schema(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


BLOCK = "dim int, n int, ids binary, rows binary, labels binary, points binary"


def packed(df: DataFrame, most: int) -> DataFrame:
    """Rows of (vec_id long, row long, label int, v array<int>) as blocks (``BLOCK``) of up to ``most`` vectors of one dimension.

    Only the vectors of a block are held at a time; the rows of a partition stay in it, so nothing is shuffled.
    """

    schema = arrow_schema(BLOCK)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}

        def block(dim: int, parts: list):
            ids, rows, labels, points = (np.concatenate(x) for x in zip(*parts))
            made = [{"dim": dim, "n": len(ids), "ids": ids.tobytes(), "rows": rows.tobytes(), "labels": labels.tobytes(), "points": points.astype("<i4").tobytes()}]
            return pa.RecordBatch.from_pylist(made, schema)

        for batch in batches:
            vectors = batch.column("v")
            sizes = np.diff(vectors.offsets.to_numpy())
            flat, start = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype("<i8") for c in ("vec_id", "row", "label")]
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                for lo in range(0, len(at), most):
                    some = at[lo : lo + most]
                    points = flat[(start[some][:, None] + np.arange(dim)[None, :])].reshape(len(some), dim)
                    parts = held.setdefault(dim, [])
                    parts.append((*[c[some] for c in columns], points))
                    if sum(len(p[0]) for p in parts) >= most:
                        yield block(dim, parts)
                        del held[dim]
        for dim, parts in held.items():
            yield block(dim, parts)

    return df.select("vec_id", "row", "label", "v").mapInArrow(run, BLOCK)


def unpacked(block: dict):
    """(ids, rows, labels, points as int64) of a block."""
    import numpy as np

    longs = [np.frombuffer(block[c], "<i8") for c in ("ids", "rows", "labels")]
    return *longs, np.frombuffer(block["points"], "<i4").reshape(block["n"], block["dim"]).astype(np.int64)


def over_blocks(df: DataFrame, work: Callable[[Iterator[dict]], Iterator[list[dict]]], schema: str) -> DataFrame:
    """``work`` over the rows of each partition of a table of blocks, one block at a time; it yields lists of result rows."""

    out = arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        blocks = ({c: batch.column(c)[i].as_py() for c in batch.schema.names} for batch in batches for i in range(batch.num_rows))
        for columns in work(blocks):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)
