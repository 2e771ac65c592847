"""Types for UDFs that are declared before a session exists, and names for values within expressions."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIMPLE = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "double": T.DoubleType()}


def of(name: str) -> T.DataType:
    """string, long, ... or array<...> of one."""
    return T.ArrayType(of(name[6:-1])) if name.startswith("array<") else SIMPLE[name]


def struct(fields: str) -> T.StructType:
    """A struct from "name type, name type"."""
    return T.StructType([T.StructField(n, of(t)) for n, t in (f.split() for f in fields.split(", "))])


def guarded(f: Callable, failed: Callable[[object, str], object]) -> Callable:
    """f, with failed(value, error) in place of a row's result where f raises: one odd row does not fail the job."""

    def run(value: object) -> object:
        try:
            return f(value)
        except Exception as e:  # whatever it is, the other rows still count
            return failed(value, f"{type(e).__name__}: {e}"[:200])

    return run


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)
