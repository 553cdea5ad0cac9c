"""Small DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.plans.stage import cleared, made, released, removed, shared_dir, written  # noqa: F401

#: Bytes of a block of rows that are compared with each other.
GROUP_BYTES = 16 << 20
#: Bytes of text that one vectorised block holds (a longer single text is a block of its own).
BLOCK_BYTES = 1 << 20


#: Spark's own bound on the bytes of an Arrow batch, and the one that sessions get which haven't chosen another.
_WIDE, BATCH_BYTES = "67108864b", 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """Bound the session's Arrow batches by bytes: both ends of a worker's pipe hold one, whatever the length of texts."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, _WIDE) == _WIDE:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def lean(run: Callable) -> Callable:
    """``run``, which gives memory back to the system when a task ends; workers that wait for their next task then hold little."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library isn't glibc
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def by_place(df: DataFrame, *wanted: str) -> tuple[DataFrame, tuple[str, ...]]:
    """``df`` with columns named _c0, _c1, ... in order, and which of these the wanted ones are; so names can't clash."""
    cols = bounded(df).columns
    return df.toDF(*[f"_c{i}" for i in range(len(cols))]), tuple(f"_c{cols.index(w)}" for w in wanted)


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Select ``new=old`` by exact, positional match, so columns that differ only in case (or repeat) don't clash."""
    cols = bounded(df).columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(cols))])
    return plain.select(*[F.col(f"_c{cols.index(old)}").alias(new) for new, old in names.items()])


def counted(plain: DataFrame, text: str, names: list[str]) -> DataFrame:
    """Columns by place (``names`` has their own names) with ``n_chars``, where there is one, counted again."""
    if "n_chars" not in names:
        return plain
    return plain.withColumn(f"_c{names.index('n_chars')}", F.length(F.coalesce(text, F.lit(""))).cast("long"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows with equal values in the first ``keys`` columns, of batches that come sorted by them."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*[batch.column(i).to_pylist() for i in range(keys)], strict=True))
        cuts = [i for i in range(1, len(values)) if values[i] != values[i - 1]]
        table = pa.Table.from_batches([batch])
        for a, z in zip([0, *cuts], [*cuts, len(values)], strict=True):
            if held and values[a] != last:
                yield pa.concat_tables(held) if len(held) > 1 else held[0]
                held = []
            held.append(table.slice(a, z - a))
            last = values[a]
    if held:
        yield pa.concat_tables(held) if len(held) > 1 else held[0]


def block_count(size: Column, weight: Column, block: int) -> Column:
    """Blocks that a group of ``size`` rows and ``weight`` bytes needs, of about ``block`` rows and ``GROUP_BYTES`` at most."""
    return F.ceil(F.greatest(size / F.lit(block), weight / F.lit(GROUP_BYTES))).cast("int")


def block_tasks(rows: DataFrame, node: str, n: Column) -> DataFrame:
    """Deal each group out to pairs of its ``n`` blocks: columns ``i`` <= ``j`` (the pair) and ``own`` (the row's block). A row goes to one pair for each block of its group, so any two rows meet in just one pair,
    except rows of one block, which meet in the pair (i, i) as well as in others."""
    with_own = rows.withColumn("_n", n).withColumn("own", F.pmod(F.xxhash64(F.col(node)), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_o")
    out = with_own.select("*", other)
    return out.select(*[c for c in rows.columns], "own", F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j"))


class Forest:
    """Union-find that tells which links join two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
