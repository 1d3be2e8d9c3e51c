"""Comparison of two documents, field by field, where both fit in a row."""

from __future__ import annotations

import math
import struct
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from orderlore.functions.similarity import indel_ratio

# the functions below travel inside the UDF, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# what \s of the text functions stands for
WHITE_SPACE = " \t\n\x0b\f\r"
# how many bytes a value has, by its first byte, for those whose bytes tell all: texts of up to 63 bytes, null, booleans, numbers
BYTES = [{0: 1, 1: 1, 2: 1, 3: 2, 4: 3, 5: 5, 6: 9, 7: 9, 8: 6, 9: 10, 10: 18}.get(b >> 2, 0) if b & 3 == 0 else 1 + (b >> 2) if b & 3 == 1 else 0 for b in range(256)]
KNOWN_NAMES, KNOWN_PATHS = 1_000, 1_000


def numbers(data: bytes, start: int, count: int, width: int):
    """Unsigned numbers of `width` bytes each."""
    if width == 1:
        return data[start : start + count]
    if width == 2:
        return struct.unpack_from(f"<{count}H", data, start)
    return [int.from_bytes(data[i : i + width], "little") for i in range(start, start + count * width, width)]


def field_names(metadata: bytes) -> list[str]:
    """The names that the metadata of a VARIANT lists."""
    width = (metadata[0] >> 6) + 1
    count = int.from_bytes(metadata[1 : 1 + width], "little")
    ends, first = numbers(metadata, 1 + width, count + 1, width), 1 + (count + 2) * width
    return [metadata[first + a : first + b].decode() for a, b in zip(ends, ends[1:])]


def extent(data: bytes, at: int, info: int) -> tuple[int, int, int]:
    """Of an object or list: how many values it holds, where their numbers begin, and how many bytes a place takes."""
    sized = 4 if info >> (4 if data[at] & 3 == 2 else 2) & 1 else 1
    return int.from_bytes(data[at + 1 : at + 1 + sized], "little"), at + 1 + sized, (info & 3) + 1


def read(data: bytes, names: list[str], at: int = 0):
    """The part of a VARIANT at a place, as JSON has it. All numbers are doubles; those that JSON can't write are texts."""
    kind, info = data[at] & 3, data[at] >> 2
    if kind == 1:
        return data[at + 1 : at + 1 + info].decode()
    if kind:
        count, at, width = extent(data, at, info)
        if kind == 3:
            first, items = at + (count + 1) * width, []
            for i in numbers(data, at, count, width):
                i += first
                head = data[i]
                items.append(data[i + 1 : i + 1 + (head >> 2)].decode() if head & 3 == 1 else read(data, names, i))
            return items
        id_width = (info >> 2 & 3) + 1
        ids, at = numbers(data, at, count, id_width), at + count * id_width
        first = at + (count + 1) * width
        return {names[k]: read(data, names, first + i) for k, i in zip(ids, numbers(data, at, count, width))}
    at += 1
    if info <= 2:
        return info == 1 if info else None
    if info <= 6:
        return float(int.from_bytes(data[at : at + (1 << info - 3)], "little", signed=True))
    if info == 7:
        number = struct.unpack_from("<d", data, at)[0]
        return number if math.isfinite(number) else "NaN" if number != number else "Infinity" if number > 0 else "-Infinity"
    if info <= 10:  # the quotient of two whole numbers is rounded once
        return int.from_bytes(data[at + 1 : at + 1 + (4 << info - 8)], "little", signed=True) / 10 ** data[at]
    if info == 16:
        return data[at + 4 : at + 4 + int.from_bytes(data[at : at + 4], "little")].decode()
    raise ValueError("not a type that JSON has")


def leaves(data: bytes, names: list[str], known: dict) -> dict[str, int]:
    """Place by dotted path. Objects of any depth are opened, all else is a leaf.

    `known` keeps the paths of objects met before with these names.
    """
    found: dict[str, int] = {}
    opened, count = [("", 0)], 0
    for path, at in opened:
        head = data[at]
        if head & 3 != 2:  # a document that is no object
            return {"": 0}
        id_width, width = (head >> 4 & 3) + 1, (head >> 2 & 3) + 1
        if head & 64:
            size, at = int.from_bytes(data[at + 1 : at + 5], "little"), at + 5
        else:
            size, at = data[at + 1], at + 2
        end = at + size * id_width
        key = path, data[at:end]
        paths = known.get(key)
        if paths is None:
            if len(known) >= KNOWN_PATHS:
                known.clear()
            own = [names[k] for k in numbers(data, at, size, id_width)]
            paths = known[key] = [f"{path}.{name}" for name in own] if path else own
        first = end + (size + 1) * width
        count += size
        for below, i in zip(paths, data[end : end + size] if width == 1 else numbers(data, end, size, width)):
            i += first
            if data[i] & 3 == 2:
                opened.append((below, i))
            else:
                found[below] = i
    if len(found) + len(opened) - 1 != count:
        raise ValueError("two leaves of one path")
    return found


def outcome(t, p, tolerance: float, limit: float) -> str:
    """exact, partial or wrong, for values whose numbers are doubles. Lists agree if all their elements are equal."""
    if t == p:
        return "exact"
    if type(t) is str and type(p) is str:
        a, b = t.strip(WHITE_SPACE).lower(), p.strip(WHITE_SPACE).lower()
        if a == b:
            return "exact"
        possible = 2.0 * min(len(a), len(b)) > limit * (len(a) + len(b))
        return "partial" if possible and indel_ratio(a, b) > limit else "wrong"
    if type(t) in (float, bool) and type(p) in (float, bool):
        return "exact" if abs(t - p) <= tolerance * max(abs(t), abs(p)) else "wrong"
    return "wrong"


def outcomes_of(truth: Column, predicted: Column, tolerance: float, limit: float, most_bytes: int) -> Column:
    """Array of (path, outcome) of two VARIANT columns, the outcome being exact, partial, wrong, missing or extra.

    NULL where the two have more than `most_bytes`, where a document has two leaves of one path, or values or levels that can't
    be read here. A document that is NULL has no leaves.
    """

    @F.arrow_udf("array<struct<path:string,outcome:string>>")
    def compared(truths: pa.Array, predictions: pa.Array) -> pa.Array:
        known: dict[bytes, tuple[list[str], dict]] = {}

        def of(metadata: bytes) -> tuple[list[str], dict]:
            if metadata not in known:
                if len(known) >= KNOWN_NAMES:
                    known.clear()
                known[metadata] = field_names(metadata), {}
            return known[metadata]

        def pair(tm: bytes, tv: bytes | None, pm: bytes, pv: bytes | None) -> tuple[list[str], list[str]]:
            tn, t = ((), {}) if tv is None else ((x := of(tm))[0], leaves(tv, *x))
            pn, p = ((), {}) if pv is None else ((x := of(pm))[0], leaves(pv, *x))
            found = []
            for path, i in t.items():
                j = p.get(path)
                if j is None:
                    found.append("missing")
                elif (n := BYTES[tv[i]]) and tv[i : i + n] == pv[j : j + n]:
                    found.append("exact")
                else:
                    found.append(outcome(read(tv, tn, i), read(pv, pn, j), tolerance, limit))
            extra = [path for path in p if path not in t]
            return [*t, *extra], found + ["extra"] * len(extra)

        sides = [[side.field(part).to_pylist() for part in ("metadata", "value")] for side in (truths, predictions)]
        for side, column in zip(sides, (truths, predictions)):
            for i in range(len(column)) if column.null_count else ():
                if not column[i].is_valid:
                    side[1][i] = None
        ends, paths, outcomes = [0], [], []
        for tm, tv, pm, pv in zip(*sides[0], *sides[1]):
            try:
                if len(tv or b"") + len(pv or b"") > most_bytes:
                    raise ValueError("long documents")
                of_paths, found = pair(tm, tv, pm, pv)
            except (ValueError, RecursionError):
                ends[-1] = None  # the row between this place and the next is NULL
            else:
                paths += of_paths
                outcomes += found
            ends.append(len(paths))
        rows = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(outcomes, pa.string())], ["path", "outcome"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return compared(truth, predicted)
