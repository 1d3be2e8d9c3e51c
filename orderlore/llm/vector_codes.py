"""Vector compression to a code of one byte a part, by k-means with adaptive distance bounds (operator 12).

Each part of a vector keeps, from round to round, its entry, the `b` next closest entries with ordered lower bounds on
their distances, and one outer bound for all other entries. After the entries have moved, the bounds are lowered by the
moves. If the distance to the own entry, which is computed anew, lies below all bounds, nothing else is looked at; if it lies
below the bound at position z, only the entries before z are; else all entries are. Whatever isn't settled by a clear
margin is compared in integers, ties going to the lower index, so the bounds never decide a close case. `b` is set anew
for each round from the positions z that the parts needed in the last one.

The state is a Parquet table that each round reads once and writes once. Besides the states, each task writes what it moves between
entries (sums and counts of the parts that changed their entry), which Spark adds up, so no round reads the vectors
again for the sums. The driver holds the codebooks: parts x entries x components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlore.llm.tables import stored

PARTS, ENTRIES, ROUNDS, SCALE, LEAST_B, ROWS = 4, 256, 4, 1024, 4, 2048
_MARGIN = 1e-6
_STATE = "{id}, {label}, vector binary, code binary, near binary, low binary, outer_low binary, error bigint, moved int, sums array<bigint>, needed array<bigint>"


def _squares(x: np.ndarray, book: np.ndarray, exact: bool) -> np.ndarray:
    """Squared distances of parts (n x width) to entries (k x width), as integers."""
    if exact:  # every product and sum is below 2^53, so doubles hold them exactly
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in book], axis=1)


def _below(values: np.ndarray) -> np.ndarray:
    """Single precision, never above the value."""
    return np.nextafter(np.maximum(values * (1 - 1e-7), 0).astype(np.float32), np.float32(0))


def _ranked(x: np.ndarray, book: np.ndarray, b: int, exact: bool) -> tuple[np.ndarray, ...]:
    """Entry, squared distance, b next entries, their lower bounds and the outer bound of parts, from all distances."""
    squares = _squares(x, book, exact)
    rank = np.argsort(squares, axis=1, kind="stable")[:, : b + 2]  # stable: ties to the lower index
    near = np.take_along_axis(squares, rank, 1)
    far = np.sqrt(near.astype(np.float64))
    outer = _below(far[:, b + 1]) if len(book) > b + 1 else np.full(len(x), np.inf, np.float32)
    return rank[:, 0].astype(np.uint8), near[:, 0], rank[:, 1 : b + 1].astype(np.uint8), _below(far[:, 1 : b + 1]), outer


def _settle(x, book, moves, code, near, low, outer, b: int, exact: bool):
    """The state of parts after the entries have moved, and the position that each part needed."""
    held = near.shape[1]
    own = ((x - book[code]) ** 2).sum(1)
    outer = outer - np.float32(moves.max() * (1 + _MARGIN))
    low = low - (moves * (1 + _MARGIN)).astype(np.float32)[near]
    # ordered: no bound lies above one after it, the outer one included
    low = np.minimum.accumulate(np.concatenate([low, outer[:, None]], 1)[:, ::-1], axis=1)[:, ::-1]
    reach = np.sqrt(own.astype(np.float64)) * (1 + _MARGIN) + _MARGIN
    clear = low > reach[:, None]
    needed = np.where(clear.any(1), clear.argmax(1), held + 1)
    code, near, error = code.copy(), near.copy(), own.copy()
    low, outer = low[:, :held].copy(), low[:, held].copy()
    for z in range(1, held + 1):
        rows = np.flatnonzero(needed == z)
        if not len(rows):
            continue
        choice = np.concatenate([code[rows, None], near[rows, :z]], 1)
        choice.sort(1)  # by index, so that a stable sort gives ties to the lower one
        squares = ((x[rows, None, :] - book[choice]) ** 2).sum(2)
        rank = np.argsort(squares, axis=1, kind="stable")
        choice, squares = np.take_along_axis(choice, rank, 1), np.take_along_axis(squares, rank, 1)
        code[rows], error[rows], near[rows, :z] = choice[:, 0], squares[:, 0], choice[:, 1:]
        # the entries looked at have exact distances now; a bound after them may be smaller, and stays true for all before it
        low[rows, :z] = _below(np.sqrt(squares[:, 1:].astype(np.float64)))
    near, low, outer = _fit(near, low, outer, b)
    rows = np.flatnonzero(needed > held)
    if len(rows):
        code[rows], error[rows], near[rows], low[rows], outer[rows] = _ranked(x[rows], book, near.shape[1], exact)
    return code, error, near, low, outer, needed


def _fit(near, low, outer, b: int):
    """Keeps the first b bounds; what falls out is covered by the outer bound."""
    if b >= near.shape[1]:
        return near, low, outer
    return near[:, :b], low[:, :b], np.minimum(outer, low[:, b:].min(1))


def _moved_sums(parts: np.ndarray, before: np.ndarray | None, code: np.ndarray, totals: np.ndarray) -> None:
    """Adds what changed its entry to the sums and counts (parts x entries x width + 1)."""
    for p in range(parts.shape[1]):
        changed = np.arange(len(parts)) if before is None else np.flatnonzero(before[:, p] != code[:, p])
        ones = np.concatenate([parts[changed, p], np.ones((len(changed), 1), np.int64)], 1)
        np.add.at(totals[p], code[changed, p], ones)
        if before is not None:
            np.subtract.at(totals[p], before[changed, p], ones)


def _round(books: np.ndarray, moves: np.ndarray | None, b: int, exact: bool, last: bool):
    """One pass over the state; moves is None in the first, which has no bounds yet."""
    parts, entries, width = books.shape
    b = min(b, entries - 1)

    def columns(batch: pa.RecordBatch, name: str, dtype, shape):
        data = batch.column(name)
        return np.frombuffer(b"".join(data.to_pylist()), dtype).reshape(len(data), *shape)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, needed_by = np.zeros((parts, entries, width + 1), np.int64), np.zeros(entries + 2, np.int64)
        schema = None
        for batch in batches:
            schema = batch.schema
            for at in range(0, batch.num_rows, ROWS):
                cut = batch.slice(at, ROWS)
                n = cut.num_rows
                x = columns(cut, "vector", "<i4", (parts, width)).astype(np.int64)
                code, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                before = None
                if moves is not None:
                    before = columns(cut, "code", np.uint8, (parts,))
                    near0, low0 = columns(cut, "near", np.uint8, (parts, -1)), columns(cut, "low", "<f4", (parts, -1))
                    outer0 = columns(cut, "outer_low", "<f4", (parts,))
                    fit = min(b, near0.shape[2])
                else:
                    fit = b
                near, low, outer = np.zeros((n, parts, fit), np.uint8), np.zeros((n, parts, fit), np.float32), np.zeros((n, parts), np.float32)
                for p in range(parts):
                    if moves is None:
                        code[:, p], squares, near[:, p], low[:, p], outer[:, p] = _ranked(x[:, p], books[p], b, exact)
                    else:
                        code[:, p], squares, near[:, p], low[:, p], outer[:, p], z = _settle(x[:, p], books[p], moves[p], before[:, p], near0[:, p], low0[:, p], outer0[:, p], b, exact)
                        needed_by += np.bincount(z, minlength=entries + 2)
                    error += squares
                _moved_sums(x, before, code, totals)
                made = {"code": code, "near": near, "low": low, "outer_low": outer}
                out = {k: pa.array([row.tobytes() for row in v], pa.binary()) for k, v in made.items()}
                out["error"] = pa.array(error)
                for name in ("moved", "sums", "needed"):
                    out[name] = pa.nulls(n, schema.field(name).type)
                yield pa.RecordBatch.from_arrays([out.get(f.name, cut.column(f.name)) for f in schema], schema=schema)
        if schema is not None and not last:
            flat = totals.reshape(parts * entries, width + 1)
            touched = np.flatnonzero((flat != 0).any(1))
            yield _extra(schema, {"moved": touched.tolist(), "sums": flat[touched].tolist()}, len(touched))
            yield _extra(schema, {"needed": [needed_by.tolist()]}, 1)

    return rows


def _extra(schema: pa.Schema, values: dict[str, list], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(n, f.type) for f in schema], schema=schema)


def _as_integers(parts: int, width: int, scale: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("vector")
            vectors = np.zeros((len(data), parts * width), "<i4")
            values = np.floor(scale * data.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype("<i4")
            sizes = data.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            row = np.repeat(np.arange(len(data)), sizes)
            vectors[row, np.arange(len(values)) - starts[row]] = values
            packed = pa.array([v.tobytes() for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed], ["vec_id", "label", "vector"])

    return rows


def _new_books(books: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Floors of the means; entries without parts stay."""
    counts = totals[..., -1:]
    return np.where(counts > 0, totals[..., :-1] // np.maximum(counts, 1), books)


def _digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, b: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (one byte a part) and error of each vector, and the codebooks (parts x entries x width).

    Vectors that are null or hold null or non-finite components are dropped. Vectors shorter than the longest one are filled
    up with zeros, as are all if the parts would be unequal. The codebooks start from the smallest vec_ids (null ids last,
    equal ids by their vector); with fewer vectors there are fewer entries. Repeated rows each keep their row. An
    empty table gives an empty result and empty codebooks. Components so large that an error might not fit in 64 bits
    raise ValueError. Other columns are ignored. `b` is the number of bounds to begin with (an eighth of the entries).
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has one byte: 1 to 256 entries")
    finite = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = embeddings.where(finite).select("vec_id", "label", F.col("embedding").alias("vector"))
    longest, largest = kept.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))))).first()
    width = -(-(longest or 0) // parts)
    largest = int((largest or 0) * scale) + 1
    if parts * width * (2 * largest) ** 2 >= 1 << 63 or largest >= 1 << 31:
        raise ValueError(f"components up to {largest / scale:g} are too large for errors of 64 bits")
    exact = max(width, 1) * (2 * largest) ** 2 < 1 << 52
    ids = {n: f"{n} {t}" for n, t in kept.dtypes}
    whole = stored(kept.mapInArrow(_as_integers(parts, width, scale), f"{ids['vec_id']}, {ids['label']}, vector binary"), "vectors")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()  # at most 256 rows
    books = np.zeros((len(first), parts * width), np.int64)
    for i, row in enumerate(first):
        books[i, : len(row["vector"])] = np.floor(scale * np.array(row["vector"], np.float64))
    books = np.ascontiguousarray(books.reshape(len(first), parts, width).transpose(1, 0, 2))
    schema = _STATE.format(id=ids["vec_id"], label=ids["label"])
    names = [c.split()[0] for c in schema.split(", ")]
    types = dict(c.split(maxsplit=1) for c in schema.split(", "))
    state = whole.select(*[F.col(n) if n in whole.columns else F.lit(None).cast(types[n]).alias(n) for n in names])
    if not first:
        return state.select("vec_id", "label", "code", "error"), books
    b, moves = b or max(LEAST_B, entries // 8), None
    totals = np.zeros((parts, len(first), width + 1), np.int64)
    for done in range(rounds + 1):
        last = done == rounds
        out = stored(state.mapInArrow(_round(books, moves, b, exact, last), schema), "vector-states")
        state = out.where("moved is null and needed is null")
        if last:
            break
        sums = out.where("moved is not null").groupBy("moved").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width + 1)]).alias("sums"))
        for row in sums.collect():  # parts x entries at most
            totals.reshape(-1, width + 1)[row["moved"]] += np.array(row["sums"], np.int64)
        fresh = _new_books(books, totals)
        moves = np.sqrt(((fresh - books) ** 2).sum(2).astype(np.float64))
        books = fresh
        if done:
            b = _next_b(out, b, len(first))
    return state.select("vec_id", "label", "code", "error"), books


def _next_b(out: DataFrame, b: int, entries: int) -> int:
    """The least number of bounds that would have settled 19 of 20 parts, never more than there are."""
    size = entries + 2
    found = out.where("needed is not null").agg(*[F.sum(F.col("needed")[i]) for i in range(min(size, b + 2))]).first()
    counts = np.array(found, np.int64)
    return int(np.clip(np.searchsorted(np.cumsum(counts), 0.95 * counts.sum()), min(LEAST_B, b), b))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels (nulls together)."""
    sums = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_of")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_of"))).drop("_of")


def digests(codes: DataFrame, books: np.ndarray) -> DataFrame:
    code = F.lower(F.hex("code")).alias("code")
    return with_label_errors(codes).select("vec_id", code, "error", "label_error", F.lit(_digest(books)).alias("codebooks_sha256"))
