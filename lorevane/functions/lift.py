"""Python functions of one value as vectorised column functions, Arrow batch by Arrow batch.

For cutting texts at places that depend on the cut before: one pass over a text in Python, where a fold in a lambda would copy what it
has so far at every step.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: What Unicode calls white space.
SPACES = "\t\n\v\f\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


#: Values of a batch that are Python objects at once, with what is made of them.
PART = 64


def in_parts(f: Callable, type_: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``f`` of each row of a batch, null where the first column is. A batch can have tens of thousands of texts, which as objects take
    many times their Arrow form, so a part of it is handled at a time."""
    out = [pa.array([], type_)]
    for at in range(0, len(columns[0]), PART):
        rows = zip(*(c.slice(at, PART).to_pylist() for c in columns))
        out.append(pa.array([None if row[0] is None else f(*row) for row in rows], type_))
    return pa.concat_arrays(out)


def lift(f: Callable, kind: str) -> Callable[..., Column]:
    """``f`` as a function of columns; kind: its result's type. Lists of structs are lists of tuples. Where the first argument is null,
    the result is."""
    type_ = to_arrow_type(DataType.fromDDL(kind))

    def one(x: pa.Array) -> pa.Array:
        return in_parts(f, type_, x)

    def two(x: pa.Array, y: pa.Array) -> pa.Array:
        return in_parts(f, type_, x, y)

    def use(*columns: str | Column) -> Column:
        return F.arrow_udf(one if len(columns) == 1 else two, kind)(*columns)

    return use
