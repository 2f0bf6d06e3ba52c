"""Lists of rows in expressions: map, filter, sort, slice, concat and reduce of tables, as DataFrame operations.

An expression's lambda runs once, over a row whose fields are columns; what it gives is a column. No row reaches the driver. Operations
are chosen by the type of the column, and mean what they mean of Python values, so that the same lambda does for a list: an absent value is
false, equals only None, and counts as nothing in sums.
"""

from __future__ import annotations

import functools
import operator
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TABLE: ContextVar[DataFrame] = ContextVar("table")


@contextmanager
def _over(df: DataFrame):
    token = _TABLE.set(df)
    try:
        yield
    finally:
        _TABLE.reset(token)


def _type(c: Column) -> T.DataType:
    """The type that a column has over the table in hand: analysis only, nothing runs."""
    return _TABLE.get().select(c.alias("x")).schema[0].dataType


def _field(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Row:
    """A row in a lambda: its fields are columns."""

    def __init__(self, names: list[str]):
        self._names = names

    def keys(self) -> list[str]:
        return self._names

    def __getitem__(self, name: str) -> Column:
        if name not in self._names:
            raise ValueError(f"no field {name}; there are {', '.join(self._names)}")
        return _field(name)

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]


class Desc:
    """A sort key from high to low."""

    def __init__(self, value: object):
        self.value = value


def _column(x: object) -> Column:
    if isinstance(x, (list, tuple)):
        return F.array(*map(_column, x))
    if isinstance(x, dict):
        return F.struct(*(_column(v).alias(k) for k, v in x.items()))
    if isinstance(x, Row):
        return F.struct(*(x[k].alias(k) for k in x.keys()))
    return x if isinstance(x, Column) else F.lit(x)


# Operations on values or columns ---------------------------------------------------


def truth(x: object) -> object:
    """Whether a value counts as true: as Python has it, by type."""
    if not isinstance(x, Column):
        return bool(x)
    t = _type(x)
    if isinstance(t, T.BooleanType):
        return F.coalesce(x, F.lit(False))
    if isinstance(t, T.StringType):
        return F.coalesce(F.length(x) > 0, F.lit(False))
    if isinstance(t, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(x) > 0, F.lit(False))
    return F.coalesce(x != 0, F.lit(False)) if isinstance(t, T.NumericType) else x.isNotNull()


def choice(when: object, yes, no) -> object:
    """yes() or no(), thunks, by a condition; of columns both are built."""
    if not isinstance(when, Column):
        return yes() if when else no()
    return F.when(truth(when), _column(yes())).otherwise(_column(no()))


def both(*parts) -> object:
    """a and b: thunks, of which a later one is only asked when the earlier ones are true."""
    return functools.reduce(lambda a, b: _joined(a, b, True), parts[1:], parts[0]())


def either(*parts) -> object:
    return functools.reduce(lambda a, b: _joined(a, b, False), parts[1:], parts[0]())


def _joined(a: object, b, needs: bool) -> object:
    if not isinstance(a, Column):
        return b() if bool(a) is needs else a
    b = b()
    if not _alike(_type(a), _type(_column(b))):
        return truth(a) & _column(truth(b)) if needs else truth(a) | _column(truth(b))
    return choice(a, (lambda: b) if needs else (lambda: a), (lambda: a) if needs else (lambda: b))


def _alike(a: T.DataType, b: T.DataType) -> bool:
    """Whether `a or b` can be one of the two values; of booleans and of unlike types it is only true or false."""
    return T.NullType() in (a, b) or isinstance(a, T.NumericType) and isinstance(b, T.NumericType) or type(a) is type(b) and not isinstance(a, T.BooleanType)


def negated(x: object) -> object:
    return ~truth(x) if isinstance(x, Column) else not x


def _holds(x: object, part: object) -> object:
    if isinstance(x, Column):
        return F.coalesce(F.array_contains(x, part) if isinstance(_type(x), T.ArrayType) else F.contains(x, _column(part)), F.lit(False))
    if isinstance(part, Column):
        if isinstance(x, str):
            return F.coalesce(F.contains(F.lit(x), part), F.lit(False))
        return functools.reduce(operator.or_, (part.eqNullSafe(F.lit(v)) for v in x), F.lit(False))
    return part in x


def _same(a: object, b: object) -> object:
    if isinstance(a, Column) or isinstance(b, Column):
        return _column(a).eqNullSafe(_column(b))
    return a == b


_COMPARE = {
    "Eq": _same, "NotEq": lambda a, b: negated(_same(a, b)), "Is": lambda a, b: _same(a, b) if isinstance(a, Column) else a is b, "IsNot": lambda a, b: negated(_same(a, b)) if isinstance(a, Column) else a is not b,
    "In": lambda a, b: _holds(b, a), "NotIn": lambda a, b: negated(_holds(b, a)), "Lt": operator.lt, "LtE": operator.le, "Gt": operator.gt, "GtE": operator.ge,
}


def compare(names: tuple[str, ...], *values: object) -> object:
    parts = [_COMPARE[n](a, b) for n, a, b in zip(names, values, values[1:], strict=False)]
    if any(isinstance(p, Column) for p in parts):
        return functools.reduce(operator.and_, map(_column, parts))
    return all(parts)


def _added(a: object, b: object) -> object:
    kinds = [_type(x) if isinstance(x, Column) else None for x in (a, b)]
    if any(isinstance(k, (T.StringType, T.ArrayType)) for k in kinds):
        return F.concat(_column(a), _column(b))
    return a + b


_BINARY = {
    "Add": _added, "Sub": operator.sub, "Mult": operator.mul, "Div": operator.truediv, "Mod": lambda a, b: F.pmod(_column(a), _column(b)), "Pow": operator.pow,
    "FloorDiv": lambda a, b: F.floor(_column(a) / _column(b)),
}


def binary(name: str, a: object, b: object) -> object:
    if isinstance(a, Column) or isinstance(b, Column):
        if name not in _BINARY:
            raise ValueError(f"{name} isn't there for fields")
        return _BINARY[name](a, b)
    if isinstance(a, Rows) and isinstance(b, (Rows, DataFrame)) and name == "Add":
        return a.concat(b)
    return getattr(operator, {"Div": "truediv", "Mult": "mul", "LShift": "lshift", "RShift": "rshift", "BitOr": "or_", "BitAnd": "and_", "BitXor": "xor", "MatMult": "matmul"}.get(name, name.lower()))(a, b)


def item(x: object, at: object) -> object:
    """x[at]: a field, a place from either end, a slice."""
    if isinstance(x, (Rows, DataFrame)) and isinstance(at, (int, slice)):
        return rows(x).slice(at, at + 1 or None) if isinstance(at, int) else rows(x).slice(at.start or 0, at.stop)
    if isinstance(x, Column) and not isinstance(at, Column):
        text = isinstance(_type(x), T.StringType)
        if isinstance(at, int):
            return F.substring(x, at + 1 if at >= 0 else at, 1) if text else F.try_element_at(x, F.lit(at + 1 if at >= 0 else at))
        if isinstance(at, slice):
            if (at.start or 0) < 0 or at.stop is None or at.stop < 0:
                raise ValueError("a field's slice goes from a place to a place, from the start")
            start, n = at.start or 0, max(0, at.stop - (at.start or 0))
            return F.substring(x, start + 1, n) if text else F.slice(x, start + 1, n)
    return x[at]


def length(x: object) -> object:
    """Of a table its number of rows, which is counted; of a field the length, 0 where it is absent."""
    if isinstance(x, (Rows, DataFrame)):
        return rows(x).df.count()
    if not isinstance(x, Column):
        return len(x)
    n = F.size(x) if isinstance(_type(x), (T.ArrayType, T.MapType)) else F.length(x)
    return F.when(x.isNull(), 0).otherwise(n)


def _most(name: str):
    plain, of = getattr(__import__("builtins"), name), {"max": F.greatest, "min": F.least}[name]
    return lambda *xs: of(*map(_column, xs)) if any(isinstance(x, Column) for x in xs) else plain(*xs)


def _cast(to: str, plain):
    return lambda x: x.cast(to) if isinstance(x, Column) else plain(x)


#: Functions of values that do for fields too.
FUNCTIONS = {
    "len": length, "max": _most("max"), "min": _most("min"), "str": _cast("string", str), "int": _cast("bigint", int), "float": _cast("double", float), "desc": Desc,
    "abs": lambda x: F.abs(x) if isinstance(x, Column) else abs(x), "round": lambda x, n=0: F.bround(x, n) if isinstance(x, Column) else round(x, n),
}

#: Methods of texts and arrays.
METHODS = {
    "lower": F.lower, "upper": F.upper, "strip": F.trim, "startswith": lambda x, y: F.startswith(x, _column(y)), "endswith": lambda x, y: F.endswith(x, _column(y)), "split": lambda x, y: F.split(x, F.concat(F.lit("\\Q"), F.lit(y), F.lit("\\E"))),
    "replace": lambda x, a, b: F.replace(x, _column(a), _column(b)), "includes": lambda x, y: _holds(x, y), "find": lambda x, y: F.locate(y, x) - 1, "matches": lambda x, p: F.coalesce(F.rlike(x, F.lit(p)), F.lit(False)), "join": lambda x, sep: F.array_join(x, sep),
}


def method(x: object, name: str, *args: object, **kw: object) -> object:
    """x.name(...): an operation of tables, of fields, or the value's own."""
    if isinstance(x, (Rows, DataFrame)):
        if name in OPERATIONS:
            return getattr(rows(x), name)(*args, **kw)
        x = plain(x)
    if isinstance(x, Column):
        if name not in METHODS:
            raise ValueError(f"{name} isn't there for fields")
        return METHODS[name](x, *args, **kw)
    if isinstance(x, str) and name == "join" and len(args) == 1 and isinstance(args[0], Column):
        return F.array_join(args[0], x)
    return getattr(x, name)(*map(plain, args), **{k: plain(v) for k, v in kw.items()})


def called(f, *args: object, **kw: object) -> object:
    """f(...): primitives get tables, what expressions define gets what it is given."""
    if getattr(f, "__name__", "") == "<lambda>" or f in FUNCTIONS.values():
        return f(*args, **kw)
    return f(*map(plain, args), **{k: plain(v) for k, v in kw.items()})


# Tables ------------------------------------------------------------------------


def rows(x: object) -> Rows:
    """A table as a list of rows: in the order of `ord` where it has that, else as it stands."""
    return x if isinstance(x, Rows) else Rows(x, list(x.columns), [])


def in_order(df: DataFrame) -> Rows:
    """A stored table, in the order of `ord`."""
    key = _hidden()
    return Rows(df.withColumn(key, F.col("ord")), list(df.columns), [(key, True)]) if "ord" in df.columns else rows(df)


def plain(x: object) -> object:
    return x.table() if isinstance(x, Rows) else x


def _hidden() -> str:
    return f"_key_{uuid.uuid4().hex}"


class Rows:
    """Rows in an order that is kept in hidden columns: keys are (column, ascending)."""

    def __init__(self, df: DataFrame, names: list[str], keys: list[tuple[str, bool]]):
        self.df, self.names, self.keys = df, names, keys

    def __getattr__(self, name: str) -> object:
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.table(), name)

    def _order(self, reverse: bool = False) -> list[Column]:
        return [F.col(k).asc_nulls_first() if up is not reverse else F.col(k).desc_nulls_last() for k, up in self.keys]

    def _told(self, f) -> object:
        with _over(self.df):
            return f(Row(self.names))

    def _with(self, df: DataFrame) -> Rows:
        return Rows(df, self.names, self.keys)

    def table(self) -> DataFrame:
        df = self.df.orderBy(*self._order()) if self.keys else self.df
        return df.select(*map(_field, self.names))

    def filter(self, f) -> Rows:
        """f: a lambda over a row; a column or a condition as text does too."""
        if isinstance(f, (str, Column)):
            return self._with(self.df.filter(f))
        with _over(self.df):
            return self._with(self.df.filter(_column(truth(f(Row(self.names))))))

    def map(self, f) -> Rows:
        """f gives a row, a dict of fields, or one value, which is then called value."""
        out = self._told(f)
        out = {k: out[k] for k in out.keys()} if isinstance(out, (dict, Row)) else {"value": out}
        return Rows(self.df.select(*(_column(v).alias(k) for k, v in out.items()), *(F.col(k) for k, _ in self.keys)), list(out), self.keys)

    def flat_map(self, f) -> Rows:
        """f gives an array; each element is a row, value, in the order of its array."""
        at, got = _hidden(), _column(self._told(f))
        return Rows(self.df.select(*(F.col(k) for k, _ in self.keys), F.posexplode(got).alias(at, "value")), ["value"], [*self.keys, (at, True)])

    def sort(self, f, reverse: bool = False) -> Rows:
        """f gives a key, or several; desc(key) turns one round. Equal rows stay in their order."""
        got = self._told(f)
        got = list(got) if isinstance(got, (list, tuple)) else [got]
        keys, added = [], {}
        for x in got:
            name, down = _hidden(), isinstance(x, Desc)
            added[name] = _column(x.value if down else x)
            keys.append((name, down is reverse))
        return Rows(self.df.withColumns(added), self.names, [*keys, *self.keys])

    def slice(self, start: int = 0, stop: int | None = None) -> Rows:
        """Rows from a place to another; a negative start alone is that many from the end. Each task keeps the first `stop` rows."""
        if start < 0 and stop is None:
            if not self.keys:
                raise ValueError("rows without an order have no last ones: sort them first")
            return self._with(self.df.orderBy(*self._order(reverse=True)).limit(-start))
        if start < 0 or (stop is not None and stop < 0):
            raise ValueError("places count from the start, or are a number of last rows")
        df = self.df.orderBy(*self._order()) if self.keys else self.df
        df = df if stop is None else df.limit(stop)
        return self._with(df.offset(start) if start else df)

    def find(self, f) -> Rows:
        return self.filter(f).slice(0, 1)

    def concat(self, *others: object) -> Rows:
        """The rows of this table, then those of the others; fields that one of them lacks are absent there."""
        which, out, names, keys = _hidden(), None, [], []
        for k, x in enumerate(rows(o) for o in (self, *others)):
            # A table may come twice: each keeps keys of its own.
            own = [(_hidden(), up) for _, up in x.keys]
            part = x.df.select(*map(_field, x.names), *(F.col(a).alias(b) for (a, _), (b, _) in zip(x.keys, own, strict=True)), F.lit(k).alias(which))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
            names += [n for n in x.names if n not in names]
            keys += own
        return Rows(out, names, [(which, True), *keys])

    def unique(self, f) -> Rows:
        """The first row of each key."""
        key, n = _hidden(), _hidden()
        df = self.df.withColumn(key, _column(self._told(f)))
        # Of each key one row leaves a task, whatever the key's share.
        w = Window.partitionBy(key).orderBy(*(self._order() or [F.lit(0)]))
        return self._with(df.withColumn(n, F.row_number().over(w)).filter(F.col(n) == 1).drop(n))

    def count_by(self, f) -> Rows:
        """(key, count): how many rows have each key; most first, then by key."""
        df = self.df.select(_column(self._told(f)).alias("key")).groupBy("key").agg(F.count("*").alias("count"))
        return Rows(df, ["key", "count"], []).sort(lambda r: (Desc(r["count"]), r["key"]))

    def some(self, f) -> bool:
        return not self.filter(f).df.isEmpty()

    def every(self, f) -> bool:
        with _over(self.df):
            return self.df.filter(~_column(truth(f(Row(self.names))))).isEmpty()

    def fold(self, plan: dict[str, tuple[str, object, object]], start: object) -> object:
        """What a reduce of recognised form gives: for each result (operation, value, condition), one aggregation of the whole table."""
        with _over(self.df):
            r, made = Row(self.names), []
            for name, (op, value, when) in plan.items():
                v = _column(truth(value(r)) if op in ("every", "some") else value(r))
                made.append(_FOLDS[op](v if when is None else F.when(_column(truth(when(r))), v)).alias(name))
        got = self.df.agg(*made).first().asDict()
        out = {k: _FINISH[plan[k][0]](start[k] if isinstance(start, dict) else start, v) for k, v in got.items()}
        return out if isinstance(start, dict) else out["value"]


OPERATIONS = {"filter", "map", "flat_map", "sort", "slice", "find", "concat", "unique", "count_by", "some", "every", "fold"}
_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min, "every": F.bool_and, "some": F.bool_or}
_FINISH = {
    "sum": lambda a, v: a if v is None else a + v, "max": lambda a, v: a if v is None else max(a, v), "min": lambda a, v: a if v is None else min(a, v),
    "every": lambda a, v: bool(a) and v is not False, "some": lambda a, v: bool(a) or v is True,
}


def folded(x: object, f, start: object, plan: dict | None) -> object:
    """x.reduce(f, start): of a table by its plan, of a list step by step."""
    if not isinstance(x, (Rows, DataFrame)):
        return functools.reduce(f, x, start)
    if plan is None:
        raise ValueError("of a table, reduce adds, or takes the highest or lowest, or joins conditions: lambda a, r: a + r.n, max(a, r.n), a and r.ok, a + 1 if r.ok else a, or a dict of such")
    return rows(x).fold(plan, start)
