"""Flat tables from deeply nested JSON by columnar shredding (problem 2).

Every text becomes, per leaf path, a column of values with a repetition and a definition level (as in the Dremel paper).
A repetition level says at which repeated ancestor the value starts a new member (0: a new record), a definition level
how many ancestors on the path are present. Tables are rebuilt from these level sequences alone: a member of ancestor k
begins where repetition <= k and definition >= k, its number is a running count that restarts where repetition < k.

Shredding runs batch by batch in Arrow tasks, without any shuffle; a record is never split.

Defined results: null, empty, blank and unreadable texts (also NaN and Infinity, which aren't JSON, and texts nested some ten
thousand levels deep, which the decoder can't read) give no rows. A text
that is a JSON string counts as the text inside. A lone object counts as a list of one, null and other members that are
no objects get no number. Rows of equal text, or equal key, each give their own rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


@dataclass(frozen=True)
class Repeated:
    """A repeated ancestor: its key in the parent, the leaf members of its objects by type, and its child."""

    name: str
    key: str
    leaves: tuple[tuple[str, str], ...]
    child: Repeated | None = None


# The members of a composition text and their types.
DAMAGE = Repeated("damage", "kahjustused", (("kood", "string"), ("aste", "double")))
MEASUREMENT = Repeated("measurement", "mootmised", (("aasta", "double"), ("diameeter", "double"), ("korgus", "double")), DAMAGE)
ELEMENT = Repeated(
    "element",
    "elemendid",
    (
        ("rinne_kood", "string"), ("puuliik_kood", "string"), ("osakaal", "double"), ("vanus", "double"), ("korgus", "double"), ("enamus", "boolean"),
        ("sunniaasta", "double"), ("paritolu", "string"), ("diameeter", "double"), ("rinnaspindala", "double"), ("tagavara", "double"),
        ("arv", "double"), ("märkus", "string"),
    ),
    MEASUREMENT,
)


def chain(root: Repeated) -> list[Repeated]:
    out = [root]
    while out[-1].child:
        out.append(out[-1].child)
    return out


def _no_constant(name: str):
    raise ValueError(name)


_decode = json.JSONDecoder(parse_constant=_no_constant).decode


def parse(text: str | None):
    """The JSON value, unwrapped from JSON strings; None where there is none."""
    try:
        value = _decode(text)
        while isinstance(value, str):
            value = _decode(value)
        return value
    except (ValueError, TypeError, RecursionError):
        return None


def objects(value) -> list[dict]:
    if isinstance(value, dict):
        return [value]
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _search(value, key: str) -> list[tuple[dict, dict]] | None:
    """The objects of every list named key, outside in and in order, each with what the objects around it say; None if there is no such list."""
    found, seen = [], False
    todo = [(o, {}) for o in reversed(objects(value))]
    while todo:
        o, inherited = todo.pop()
        own = inherited | {k: v for k, v in o.items() if not isinstance(v, (dict, list))}
        if key in o:
            seen = True
            found += [(x, own) for x in objects(o[key])]
        else:
            todo += [(x, own) for v in reversed(o.values()) for x in reversed(objects(v))]
    return found if seen else None


def roots(value, key: str, text: str = "\\u") -> list[tuple[dict, dict]]:
    """Members of the first repeated ancestor with what the objects around them say: those of the lists named key, else the outermost objects."""
    found = _search(value, key) if key in text or "\\u" in text else None
    return [(o, {}) for o in objects(value)] if found is None else found


class Column:
    """One leaf path: values with record numbers, repetition and definition levels."""

    def __init__(self, depth: int, leaf: str | None):
        self.depth, self.leaf, self.record, self.rep, self.defi, self.value = depth, leaf, [], [], [], []

    def put(self, record: int, rep: int, defi: int, value=None) -> None:
        self.record.append(record), self.rep.append(rep), self.defi.append(defi), self.value.append(value)


def shred(texts: list, root: Repeated, paths: list[tuple[int, str | None]]) -> list[Column]:
    """Columns of the asked (depth, leaf) paths; leaf None asks for the presence of the ancestor only."""
    levels = chain(root)
    columns = [Column(d, leaf) for d, leaf in paths]

    def member(o: dict, around: dict, record: int, rep: int, depth: int, cols: list[Column]) -> None:
        deeper = []
        for c in cols:
            if c.depth > depth:
                deeper.append(c)
            elif c.leaf is None:
                c.put(record, rep, depth)
            else:
                v = o.get(c.leaf)
                if v is None and around:
                    v = around.get(c.leaf)
                c.put(record, rep, depth + (v is not None), v)
        if deeper:
            children = objects(o.get(levels[depth].key))
            if not children:
                for c in deeper:
                    c.put(record, rep, depth)
            for i, child in enumerate(children):
                member(child, {}, record, depth + 1 if i else rep, depth + 1, deeper)

    for record, text in enumerate(texts):
        value = parse(text)
        members = roots(value, root.key, text) if value is not None else []
        if not members:
            for c in columns:
                c.put(record, 0, 0)
        for i, (o, around) in enumerate(members):
            member(o, around, record, 1 if i else 0, 1, columns)
    return columns


def ordinals(rep: np.ndarray, defi: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where members of ancestor ``depth`` begin, and there the numbers of all ancestors from the first to it."""
    starts = (rep <= depth) & (defi >= depth)
    numbers = []
    for k in range(1, depth + 1):
        begins = (rep <= k) & (defi >= k)
        count = np.cumsum(begins)
        restart = rep < k
        base = np.maximum.accumulate(np.where(restart, count - begins, 0)) if len(count) else count
        numbers.append((count - base)[starts])
    return starts, numbers


_ARROW = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def _typed(values: list, kind: str) -> pa.Array:
    """Numbers also from text, with comma or point; what isn't of the kind becomes null."""

    def one(v):
        if v is None or isinstance(v, (dict, list)):
            return None
        if kind == "string":
            return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        if kind == "boolean":
            return v if isinstance(v, bool) else {"true": True, "false": False}.get(str(v).strip().lower())
        try:
            x = float(v.strip().replace(",", ".")) if isinstance(v, str) else float(v) if not isinstance(v, bool) else None
            return x if x is None or np.isfinite(x) else None
        except (ValueError, OverflowError):
            return None

    return pa.array([one(v) for v in values], _ARROW[kind])


def flat_table(df: DataFrame, key: str, text: str, depth: int, root: Repeated = ELEMENT, leaves: bool = True) -> DataFrame:
    """Table of the repeated ancestor at ``depth`` (1: the first): key, the number of every ancestor down to it, its leaves.

    The numbers tie each row to its parent (the same numbers but the last) and, with key, to the row of df.
    """
    levels = chain(root)[:depth]
    wanted = levels[-1].leaves if leaves else ()
    kind = df.schema[key].dataType
    schema = ", ".join([f"`{key}` {kind.simpleString()}", *(f"{x.name}_no int" for x in levels), *(f"`{n}` {t}" for n, t in wanted)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = shred(b.column(1).to_pylist(), root, [(depth, n) for n, _ in wanted] or [(depth, None)])
            rep, defi, record = (np.asarray(x, np.int64) for x in (cols[0].rep, cols[0].defi, cols[0].record))
            starts, numbers = ordinals(rep, defi, depth)
            at = np.flatnonzero(starts)
            arrays = [b.column(0).take(pa.array(record[at])), *(pa.array(n, pa.int32()) for n in numbers)]
            arrays += [_typed([c.value[i] for i in at], t) for c, (_, t) in zip(cols, wanted)]
            yield pa.RecordBatch.from_arrays(arrays, [key, *(f"{x.name}_no" for x in levels), *(n for n, _ in wanted)])

    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, schema)


def level_columns(df: DataFrame, key: str, text: str, root: Repeated = ELEMENT) -> DataFrame:
    """The shredded form itself: per record and leaf path the sequences of repetition and definition levels and values (as text)."""
    levels = chain(root)
    paths = [(d, n) for d, x in enumerate(levels, 1) for n, _ in x.leaves]
    names = [".".join([*(x.name for x in levels[:d]), n]) for d, n in paths]
    kind = df.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, path string, reps array<int>, defs array<int>, vals array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = shred(b.column(1).to_pylist(), root, paths)
            keys, path, reps, defs, values = [], [], [], [], []
            for c, name in zip(cols, names):
                record = np.asarray(c.record)
                cuts = np.flatnonzero(np.diff(record, prepend=-1))
                for i, j in zip(cuts, [*cuts[1:], len(record)]):
                    keys.append(record[i]), path.append(name), reps.append(c.rep[i:j]), defs.append(c.defi[i:j])
                    values.append([None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in c.value[i:j]])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keys, pa.int64())), pa.array(path, pa.string()), pa.array(reps, pa.list_(pa.int32())), pa.array(defs, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.string()))],
                [key, "path", "reps", "defs", "vals"],
            )

    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, schema)


def numbers(df: DataFrame, key: str, text: str, root: Repeated = ELEMENT) -> DataFrame:
    """The members of all ancestors in one pass: key and one number per ancestor, 0 for those below the member.

    One level column of the deepest path carries the structure of every ancestor above it.
    """
    levels = chain(root)
    names = [f"{x.name}_no" for x in levels]
    schema = ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}", *(f"{n} int" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (c,) = shred(b.column(1).to_pylist(), root, [(len(levels), None)])
            rep, defi, record = (np.asarray(x, np.int64) for x in (c.rep, c.defi, c.record))
            for depth in range(1, len(levels) + 1):
                starts, found = ordinals(rep, defi, depth)
                found += [np.zeros(int(starts.sum()), np.int64)] * (len(levels) - depth)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(record[starts])), *(pa.array(n, pa.int32()) for n in found)], [key, *names])

    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, schema)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """fid, element_no, measure_no, damage_no of every element, measurement and damage."""
    return numbers(table(spark, folder, "eraldis"), "fid", "composition").withColumnRenamed("measurement_no", "measure_no")


def p2_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Elements with their values; a member that an element lacks is taken from the object around its list."""
    return flat_table(table(spark, folder, "eraldis"), "fid", "composition", 1)


def p2_measurements(spark: SparkSession, folder: str) -> DataFrame:
    return flat_table(table(spark, folder, "eraldis"), "fid", "composition", 2)


def p2_damages(spark: SparkSession, folder: str) -> DataFrame:
    return flat_table(table(spark, folder, "eraldis"), "fid", "composition", 3)


def p2_levels(spark: SparkSession, folder: str) -> DataFrame:
    return level_columns(table(spark, folder, "eraldis"), "fid", "composition")
