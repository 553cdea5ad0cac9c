"""Nearest-neighbour candidates by cosine, without comparing all pairs.

Vectors are counts in hash places, mostly zeros, and one dense component at the end. Each pass puts the places into a random order, sorts
all rows by their first few non-zero places in it and then by the dense component, and compares a row with its neighbours: rows
that share values lie side by side in some passes. A pass costs one sort by ranges and ``2 * window`` comparisons a row, whatever the
number of rows and however many of them are alike. In the end the nearest of a row's nearest are compared with it as well.

What is shuffled is kept small: a pass carries two bytes for each count, and a row tells only neighbours that are no farther than its k-th best of
earlier passes. Rows of the same places and counts are compared once, in a pass of their own, since every other pass would find them again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.features import hashed_features
from alertloom.plans.stage import released, removed, shared_dir, written
from alertloom.schema import FieldRoles, clean

#: Weight of the time scale against one shared value.
TIME_WEIGHT = 5.0

#: A row's vector: ``at`` is its last component, ``body`` its other ones. See ``_unit_rows``.
_UNITS = "id long, at double, body binary"
#: A row's best others so far, the cosine that a further one must reach, and their cosines and ids packed (``_PAIR``).
_NEAR = "id long, least float, found binary"
_PAIR = np.dtype([("cosine", "<f4"), ("other", "<i8")])
_PLACE = np.dtype([("place", "<u4"), ("x", "<f4")])


def alert_vector(df: DataFrame, roles: FieldRoles, time: str | None = "EndDate", size: int = 64) -> DataFrame:
    """``df`` with ``vector``: counts of an alert's role values in ``size`` hash places (values that stand for none count for nothing), and its time between the
    first (0) and the last (5)."""
    roles.check(df)
    cols = [*roles.addresses, *roles.usernames]
    none: Column = F.array(*[F.lit(0.0)] * size)
    parts = [F.when(clean(c).isNotNull(), hashed_features([c], size)).otherwise(none) for c in cols]
    total = parts[0]
    for p in parts[1:]:
        total = F.zip_with(total, p, lambda a, b: a + b)
    if not time:
        return df.withColumn("vector", total)
    us = F.unix_micros(time).cast("double")
    ends = df.agg(F.min(us).alias("_low"), F.max(us).alias("_high"))  # one row
    placed = F.coalesce((us - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * TIME_WEIGHT, F.lit(0.0))
    return df.crossJoin(F.broadcast(ends)).withColumn("vector", F.concat(total, F.array(placed))).drop("_low", "_high")


def _sliced(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: the bytes of ``data`` between consecutive ``ends``, which count its items."""
    offsets = (np.concatenate([[0], ends]) * data.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors (id, v) as ``_UNITS``. Places with counts up to 255 are two bytes each; where others occur, or places from 256 on, all of a
    row's places with their values in the vector of length 1 are stored, and one byte more, so that the number of bytes is odd."""
    for batch in batches:
        if batch.num_rows:
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
            norm = np.linalg.norm(x, axis=1)
            some = norm > 0
            x, norm = x[some], norm[some]
            rest = x[:, :-1]
            whole = ((rest >= 0) & (rest <= 255) & (rest == np.floor(rest))).all(1) & ~(rest[:, 256:] != 0).any(1)
            row, place = np.nonzero(np.where(whole[:, None], rest, 0.0))
            pairs = np.stack([place, rest[row, place]], axis=1).astype("u1")
            body = _sliced(pairs.view("<u2").ravel(), np.cumsum(np.bincount(row, minlength=len(x))))
            if not whole.all():
                full = (x / norm[:, None]).astype(np.float32)
                full[whole] = 0
                row, place = np.nonzero(full)
                held = np.empty(len(row), dtype=_PLACE)
                held["place"], held["x"] = place, full[row, place]
                wide = _sliced(held, np.cumsum(np.bincount(row, minlength=len(x)))).to_pylist()
                body = pa.array([a if w else b + b"\0" for a, b, w in zip(body.to_pylist(), wide, whole)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), pa.array(x[:, -1]), body], ["id", "at", "body"])


def _matrix(bodies: list[bytes], at: np.ndarray, width: int) -> np.ndarray:
    """Vectors of length 1 of what ``_unit_rows`` stored."""
    n = len(bodies)
    size = np.fromiter(map(len, bodies), dtype=np.int64, count=n)
    whole = size % 2 == 0
    full = np.zeros((n, width), dtype=np.float32)
    pairs = np.frombuffer(b"".join(bodies if whole.all() else [b for b, w in zip(bodies, whole) if w]), dtype="u1").reshape(-1, 2)
    row = np.repeat(np.flatnonzero(whole), size[whole] // 2)
    x = pairs[:, 1].astype(float)
    norm = np.sqrt(np.bincount(row, x * x, n) + at * at)
    full[row, pairs[:, 0]] = x / norm[row]
    full[whole, -1] = at[whole] / norm[whole]
    if not whole.all():
        held = np.frombuffer(b"".join(b[:-1] for b, w in zip(bodies, whole) if not w), dtype=_PLACE)
        full[np.repeat(np.flatnonzero(~whole), size[~whole] // _PLACE.itemsize), held["place"]] = held["x"]
    return full


def _best(k: int):
    """Rows of ``_NEAR``, ordered by id, put together: the ``k`` best others of each id; of equal cosines those of the smaller ids."""

    def ranked(ids: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine, other = pairs["cosine"], pairs["other"]
        order = np.lexsort((-cosine, other, ids))
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (ids[order][1:] != ids[order][:-1]) | (other[order][1:] != other[order][:-1])
        order = order[new]
        order = order[np.lexsort((other[order], -cosine[order], ids[order]))]
        ids = ids[order]
        keep = np.arange(len(ids)) - np.searchsorted(ids, ids) < k
        return ids[keep], pairs[order[keep]]

    def packed(ids: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
        own, count = np.unique(ids, return_counts=True)
        ends = np.cumsum(count)
        least = np.where(count == k, pairs["cosine"][ends - 1], -np.inf).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(least), _sliced(pairs, ends)], ["id", "least", "found"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pairs = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_PAIR)
        for batch in batches:
            found = batch.column(2).to_pylist()
            size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // _PAIR.itemsize
            new = np.repeat(batch.column(0).to_numpy(), size)
            ids, pairs = ranked(np.concatenate([ids, new]), np.concatenate([pairs, np.frombuffer(b"".join(found), dtype=_PAIR)]))
            cut = np.searchsorted(ids, ids[-1]) if len(ids) else 0  # the last id may go on
            if cut:
                yield packed(ids[:cut], pairs[:cut])
                ids, pairs = ids[cut:], pairs[cut:]
        if len(ids):
            yield packed(ids, pairs)

    return best


def _told(ids: np.ndarray, row: np.ndarray, cosine: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    """``_NEAR`` rows of others found for the rows ``row``, which ascend, of ``ids``."""
    own, count = np.unique(row, return_counts=True)
    pairs = np.empty(len(row), dtype=_PAIR)
    pairs["cosine"], pairs["other"] = cosine, other
    return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(np.zeros(len(own), dtype=np.float32)), _sliced(pairs, np.cumsum(count))], ["id", "least", "found"])


def nearest_candidates(df: DataFrame, vector: str, id_col: str, k: int = 10, passes: int = 36, window: int = 6, places: int = 3, through: int = 5, seed: int = 7) -> DataFrame:
    """``id``, ``other`` and ``cosine`` of up to ``k`` nearest rows of each row, among those that surround it in any pass and the ``through`` nearest of its
    ``through`` nearest; ties go to the smaller id.

    Rows with a null id or vector are left out, as are zero vectors; vectors must be of one length; ids are whole numbers, and rows
    of one id stand for each other. Windows end at the borders of sorted ranges, which cuts the neighbourhood of few rows in one pass.
    Rows are sorted by fewer than ``places`` places where the numbers of so many don't fit 63 bits.
    """
    spark, base = df.sparkSession, shared_dir(df.sparkSession)
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    first = rows.select(F.size("v").alias("n")).first()
    if first is None:
        return spark.createDataFrame([], "id long, other long, cosine double")
    width = first.n
    rng = np.random.default_rng(seed)
    orders = [rng.permutation(width - 1) for _ in range(passes)]
    while places > 1 and passes * (width + 1) ** places >= 1 << 63:
        places -= 1
    span = (width + 1) ** places

    units = written(rows.mapInArrow(_unit_rows, _UNITS).dropDuplicates(["id"]), "units", base)

    def coded(some: range):
        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                full = _matrix(batch.column(2).to_pylist(), batch.column(1).to_numpy(), width)[:, :-1] > 0
                for p in some:
                    ahead = np.sort(np.where(full, orders[p][None, :], width), axis=1)[:, :places]
                    key = np.full(len(full), p, dtype=np.int64)
                    for j in range(places):
                        key = key * (width + 1) + (ahead[:, j] if j < ahead.shape[1] else width)
                    yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(1), batch.column(0), batch.column(2), batch.column(3)], ["key", "at", "id", "body", "least"])

        return keys

    def compared(alike: bool):
        """Neighbours in order of key, ``at`` and id: those of equal bodies (their hash is the key), or those of others in one pass."""

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), np.zeros(0, dtype=np.int64), np.zeros((0, width), dtype=np.float32))
            done = 0  # of the held rows, those whose neighbours have been found

            def found(upto: int) -> pa.RecordBatch:
                part, ids, least, same, v = held
                n = len(ids)
                sims, other = np.full((n, 2 * window), -np.inf, dtype=np.float32), np.zeros((n, 2 * window), dtype=np.int64)
                for o in range(1, min(window, n - 1) + 1):
                    s = np.einsum("ij,ij->i", v[:-o], v[o:])
                    s[(part[:-o] != part[o:]) | ((same[:-o] == same[o:]) != alike)] = -np.inf
                    sims[:-o, o - 1], other[:-o, o - 1] = s, ids[o:]
                    sims[o:, window + o - 1], other[o:, window + o - 1] = s, ids[:-o]
                sims, other, own = sims[done:upto], other[done:upto], ids[done:upto]
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                s, o = np.take_along_axis(sims, top, 1), np.take_along_axis(other, top, 1)
                keep = np.isfinite(s) & (s >= least[done:upto, None])
                return _told(own, np.nonzero(keep)[0], s[keep], o[keep])

            for batch in batches:
                bodies = batch.column(3).to_pylist()
                v = _matrix(bodies, batch.column(1).to_numpy(), width)
                key = batch.column(0).to_numpy()
                new = (key if alike else key // span, batch.column(2).to_numpy(), batch.column(4).to_numpy(), np.fromiter(map(hash, bodies), dtype=np.int64, count=len(bodies)), v)
                held = tuple(np.concatenate([a, b]) for a, b in zip(held, new, strict=True))
                upto = len(held[1]) - window
                if upto > done:
                    yield found(upto)
                    cut = max(0, upto - window)
                    held, done = tuple(x[cut:] for x in held), upto - cut
            if len(held[1]) > done:
                yield found(len(held[1]))

        return compare

    def best(found: DataFrame) -> DataFrame:
        return found.repartition("id").sortWithinPartitions("id").mapInArrow(_best(k), _NEAR)

    order, keyed = ["key", "at", "id"], "key long, at double, id long, body binary, least float"
    near, none = None, F.lit(float("-inf")).cast("float")
    start = max(1, passes // 9)  # few passes tell all that they find, the others what is no worse
    for step, some in enumerate((None, range(start), range(start, passes))):
        if some is not None and not len(some):
            continue
        known = units.withColumn("least", none) if near is None else units.join(near.select("id", "least"), "id", "left").select("id", "at", "body", F.coalesce("least", none).alias("least"))
        keys = known.select(F.xxhash64("body").alias("key"), "at", "id", "body", "least") if some is None else known.mapInArrow(coded(some), keyed)
        found = keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compared(some is None), _NEAR)
        near = written(best(found if near is None else near.unionByName(found)), f"near{step}", base)
        if step:
            removed(spark, f"{base}/near{step - 1}")
        del known, keys, found
        released(spark)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ``through`` nearest of a row are asked for theirs: a row for each, with the asking row's id, vector and least cosine."""
        for batch in batches:
            found = [f[: through * _PAIR.itemsize] for f in batch.column(2).to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(f) // _PAIR.itemsize for f in found])
            other = np.frombuffer(b"".join(found), dtype=_PAIR)["other"]
            yield pa.RecordBatch.from_arrays([pa.array(other), *[batch.column(i).take(pa.array(row)) for i in (0, 3, 4, 1)]], ["of", "id", "at", "body", "least"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that ask, each with the nearest (without ``least``) of the row that it asks, which come first."""
        held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, width), dtype=np.float32))
        for batch in batches:
            of, ids, least = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(5).to_numpy()
            v, asks = _matrix(batch.column(4).to_pylist(), batch.column(3).to_numpy(), width), batch.column(1).to_numpy(zero_copy_only=False)
            held = tuple(np.concatenate([a, b[~asks]]) for a, b in zip(held, (of, ids, v), strict=True))
            at = np.flatnonzero(asks)
            low, high = np.searchsorted(held[0], of[at], "left"), np.searchsorted(held[0], of[at], "right")
            row = np.repeat(at, high - low)
            to = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
            s = np.einsum("ij,ij->i", v[row], held[2][to])
            keep = (ids[row] != held[1][to]) & (s >= least[row])
            if keep.any():
                yield _told(ids, row[keep], s[keep], held[1][to][keep])
            if len(of):
                held = tuple(x[held[0] == of[-1]] for x in held)

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2).to_pylist()
            pairs = np.frombuffer(b"".join(found), dtype=_PAIR)
            ids = np.repeat(batch.column(0).to_numpy(), [len(f) // _PAIR.itemsize for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(pairs["other"]), pa.array(pairs["cosine"].astype(float))], ["id", "other", "cosine"])

    asking = near.join(units, "id").select("id", "least", "found", "at", "body").mapInArrow(asked, "of long, id long, at double, body binary, least float")
    bare = near.mapInArrow(lambda batches: (b.select(["of", "id"]) for b in asked(pa.RecordBatch.from_arrays([*b.columns, *[b.column(0)] * 2], ["id", "least", "found", "at", "body"]) for b in batches)), "of long, id long")
    # the nearest of each row with their vectors, under that row's id
    given = bare.select(F.col("of").alias("id"), F.col("id").alias("of")).join(units, "id").select("of", F.lit(False).alias("asks"), "id", "at", "body", F.lit(0.0).cast("float").alias("least"))
    both = given.unionByName(asking.withColumn("asks", F.lit(True)))
    further = both.repartition("of").sortWithinPartitions("of", "asks").mapInArrow(met, _NEAR)
    near = written(best(near.unionByName(further)), "near", base)
    return near.mapInArrow(exploded, "id long, other long, cosine double")
