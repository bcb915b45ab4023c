"""A session: SQL text in, DataFrames out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import PandasUDFType

from millrace.dialect.lexer import DialectError
from millrace.dialect.parser import parse, parse_expr
from millrace.dialect.tree import Column, Select, Statement, Table
from millrace.functions.spec import SPARK_TYPES, Spec, parse_sets, parse_spec
from millrace.operators import casts
from millrace.plans.lower import Lower
from millrace.sources import catalog
from millrace.sources.connector import Connector
from millrace.sources.store import ROW_ID, CommitError, Database, Index, Key, Layer, Transaction, Version

__all__ = ["CommitError", "DialectError", "Session", "UpdatableView"]


class Session:
    """folder: a directory of <table>.parquet, whose tables are readable by name.
    connector: another store of tables, which is asked where neither the database nor the folder has one.
    nulls: "reference" (NULL is the lowest value, comparisons are two-valued) or "ansi"."""

    def __init__(self, spark: SparkSession, folder: str | None = None, nulls: str = "reference", schema: str = "APP", database: Database | None = None, connector: Connector | None = None) -> None:
        if nulls not in ("reference", "ansi"):
            raise ValueError(nulls)
        self.spark, self.folder, self.nulls, self.schema = spark, folder, nulls, schema
        self.db, self.connector = database or Database(spark), connector
        self.transaction = Transaction(self.db)
        #: (name, number of arguments) to the registered name of each type that the result can have, and the tagged arguments
        self.functions: dict[tuple[str, int], tuple[dict[str, str], tuple[int, ...]]] = {}
        self.aggregates: set[str] = set()
        self.variables: dict[str, object] = {"autocommit": True}
        self._views: dict[int, tuple[object, str]] = {}
        self._files: dict[str, str] = {}
        self._named: set[str] = set()

    # --- tables
    def key(self, path: Sequence[str]) -> Key:
        return (path[-2] if len(path) > 1 else self.schema, path[-1])

    def register(self, name: str, df: DataFrame, schema: str | None = None) -> None:
        """Make a DataFrame readable as a table."""
        self.db.schemas.add(schema or self.schema)
        v = Version(self.db.clock, (Layer(df),), mutable=False, kind="VIEW")
        self.db.tables[(schema or self.schema, name)] = v
        self.transaction.tables[(schema or self.schema, name)] = v
        self.transaction.start[(schema or self.schema, name)] = v

    def view(self, path: Sequence[str]) -> str:
        """The Spark view that stands for a table as this transaction sees it."""
        key = self.key(path)
        v = self.transaction.tables.get(key)
        if v is not None:
            return self._view(v.rows, v)
        if key[0].upper() == "SYSTEM":
            df = catalog.system_table(self.spark, key[1], self.transaction.tables, self.db.schemas)
            if df is not None:
                return self._view(df, None)
        if self.connector and len(path) == 1:
            df = self.connector.read(key[1])
            if df is not None:
                return self._view(df, None)
        if self.folder and (len(path) == 1 or key[0] == "APP"):
            if key[1] not in self._files:
                try:
                    self._files[key[1]] = self._view(self.spark.read.parquet(f"{self.folder}/{key[1]}.parquet"), None)
                except AnalysisException as e:
                    raise DialectError(f"no table {'.'.join(path)}") from e
            return self._files[key[1]]
        raise DialectError(f"no table {'.'.join(path)}")

    def _view(self, df: DataFrame, owner) -> str:
        if owner is not None and id(owner) in self._views:
            return self._views[id(owner)][1]
        name = f"millrace_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        self._named.add(name)
        if owner is not None:
            self._views[id(owner)] = (owner, name)
        return name

    def close(self) -> None:
        """Forget the transaction and drop the session's views from Spark's catalog; frames made before stay valid."""
        self.rollback()
        for name in self._named:
            self.spark.catalog.dropTempView(name)
        self._named.clear()
        self._views.clear()
        self._files.clear()

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # --- functions
    def add_function(self, spec: str | Spec, function, aggregate: bool = False, vectorised: bool = False) -> None:
        """Register a function under its definition. A scalar takes its arguments' values, or pandas Series and
        returns one if `vectorised`; an aggregate takes Series and returns one value. Overloads go by
        number of arguments. A result of type T has the widest type of the arguments tagged so."""
        s = parse_spec(spec) if isinstance(spec, str) else spec
        most = s.least + 8 if s.most == float("inf") else int(s.most)
        for n in range(s.least, most + 1):
            tagged = tuple(i for i in range(n) if s.parameters[min(i, len(s.parameters) - 1)].same) if s.returns == "T" else ()
            kinds = [s.returns] if s.returns != "T" else ["BOOLEAN", "NUMERIC", "DATE", "STRING"]
            names = {}
            for kind in kinds:
                names[kind] = f"millrace_{s.name}_{n}_{kind.lower()}_{uuid.uuid4().hex[:8]}"
                self._register(names[kind], function, SPARK_TYPES[kind], s.deterministic, aggregate, vectorised)
                if aggregate:
                    self.aggregates.add(names[kind])
            self.functions[(s.name, n)] = (names, tagged)

    def add_functions(self, text: str, functions: Mapping) -> None:
        """Register sets of definitions,  FUNCTION|AGGREGATE name { definition; ... } ..., whose functions are
        looked up by name."""
        for aggregate, _, specs in parse_sets(text):
            for s in specs:
                self.add_function(s, functions[s.name], aggregate)

    def _register(self, name: str, function, kind: str, deterministic: bool, aggregate: bool, vectorised: bool) -> None:
        if aggregate:

            def run(*columns):
                return function(*columns)

            u = F.pandas_udf(run, kind, functionType=PandasUDFType.GROUPED_AGG)
        elif vectorised:
            u = F.pandas_udf(function, kind, functionType=PandasUDFType.SCALAR)
        else:
            u = F.udf(function, kind, useArrow=True)
        self.spark.udf.register(name, u if deterministic or aggregate else u.asNondeterministic())

    # --- statements
    def sql(self, text: str, params: Sequence | Mapping | None = None) -> DataFrame:
        """Run one or more statements; the result is the last one's."""
        values = {str(i): v for i, v in enumerate(params)} if isinstance(params, (list, tuple)) else dict(params or {})
        out = None
        for s in parse(text):
            out = getattr(self, f"_{s.kind}")(s, values)
        if out is None:
            raise DialectError("no statement")
        return out

    def lowered(self, text: str, params: Mapping | None = None) -> str:
        """The Spark SQL of a query."""
        (s,) = parse(text)
        return Lower(self, dict(params or {})).query(s.data["query"])

    def explain(self, text: str, params: Sequence | Mapping | None = None, mode: str = "formatted") -> str:
        df = self.sql(text, params)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def parameters(self, params: Sequence | Mapping) -> DataFrame:
        """The parameters of a statement as a table of one row: a column for each, by name or place."""
        values = {f"p{i}": v for i, v in enumerate(params)} if isinstance(params, (list, tuple)) else dict(params)
        if not values:
            return self.spark.sql("SELECT 1 AS one").select()
        return self.spark.sql("SELECT " + ", ".join(f":p_{i} AS `{k}`" for i, k in enumerate(values)), args={f"p_{i}": v for i, v in enumerate(values.values())})

    def analysed(self, text: str, values: Mapping) -> DataFrame:
        used = {f"p_{k}": v for k, v in values.items() if f":p_{k}" in text}
        return self.spark.sql(text, args=used) if used else self.spark.sql(text)

    def scalar(self, text: str, params: Sequence | Mapping | None = None):
        row = self.sql(text, params).first()
        return None if row is None else row[0]

    def rows(self, text: str, params: Sequence | Mapping | None = None, most: int = 0) -> Iterator[Row]:
        """Reads a result row by row; most > 0 bounds it."""
        df = self.sql(text, params)
        return (df.limit(most) if most else df).toLocalIterator()

    def _count(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "result int")

    def _done(self) -> None:
        if self.variables["autocommit"]:
            self.commit()

    def commit(self) -> None:
        try:
            self.transaction.commit()
        finally:
            self.transaction = Transaction(self.db)

    def rollback(self) -> None:
        self.transaction = Transaction(self.db)

    def _select(self, s: Statement, values: dict) -> DataFrame:
        return self.analysed(Lower(self, values).query(s.data["query"]), values)

    def _explain(self, s: Statement, values: dict) -> DataFrame:
        df = self._select(s, values)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return self.spark.createDataFrame([(x,) for x in plan.splitlines()], "plan string")

    def _commit(self, s: Statement, values: dict) -> DataFrame:
        self.commit()
        return self._count(0)

    def _rollback(self, s: Statement, values: dict) -> DataFrame:
        self.rollback()
        return self._count(0)

    def _set_schema(self, s: Statement, values: dict) -> DataFrame:
        self.schema = s.data["name"]
        return self._count(1)

    def _create_schema(self, s: Statement, values: dict) -> DataFrame:
        self.db.schemas.add(s.data["name"])
        return self._count(1)

    def _set_isolation(self, s: Statement, values: dict) -> DataFrame:
        if s.data["level"] != "SERIALIZABLE":
            raise DialectError("SERIALIZABLE is the only isolation level")
        return self._count(1)

    def _set_variable(self, s: Statement, values: dict) -> DataFrame:
        self.variables[s.data["name"].lower()] = self.analysed(f"SELECT {Lower(self, values).expr(s.data['value'])}", values).first()[0]
        return self._count(1)

    def _create_table(self, s: Statement, values: dict) -> DataFrame:
        d = s.data
        key = self.key(d["table"])
        if key in self.transaction.tables:
            if d["maybe"]:
                return self._count(0)
            raise DialectError(f"{'.'.join(key)} exists already")
        for k in d["constraints"]:
            if k.kind == "foreign":
                self._no_cycle(key, self.key(k.target))
        self.transaction.create(key, T.StructType([self._field(c) for c in d["columns"]]), d["columns"], d["constraints"])
        self._done()
        return self._count(1)

    def _field(self, c) -> T.StructField:
        return T.StructField(c.name, T._parse_datatype_string(casts.spark_type(c.type, () if c.type == "string" else c.size)))

    def _alter(self, s: Statement, values: dict) -> DataFrame:
        d = s.data
        key = self.key(d["table"])
        v = self.transaction.version(key)
        have = {c.name for c in v.columns}
        if "add_column" in d:
            c = d["add_column"]
            if c.name in have:
                raise DialectError(f"column {c.name} exists already")
            value = F.lit(None) if c.default is None else F.expr(Lower(self, {}).expr(c.default))
            if c.not_null and c.default is None and not v.df.isEmpty():
                raise ValueError(f"{c.name} must not be NULL")
            value = value.cast(self._field(c).dataType)
            grown = lambda df: df.select(*[x for x in df.columns if x != ROW_ID], value.alias(c.name), ROW_ID)
            v = replace(v, columns=(*v.columns, c), layers=tuple(replace(x, rows=x.rows if x.rows is None else grown(x.rows)) for x in v.layers))
        elif "drop_column" in d:
            name = d["drop_column"]
            if name not in have:
                raise DialectError(f"no column {name}")
            if any(name in k.columns for k in (*v.constraints, *v.indexes)):
                raise DialectError(f"{name} is part of a constraint or an index")
            v = replace(v, columns=tuple(c for c in v.columns if c.name != name), layers=tuple(replace(x, rows=x.rows if x.rows is None else x.rows.drop(name)) for x in v.layers))
        elif "add_constraint" in d:
            if d["add_constraint"].kind == "foreign":
                self._no_cycle(key, self.key(d["add_constraint"].target))
            v = replace(v, constraints=(*v.constraints, d["add_constraint"]))
        else:
            left = tuple(k for k in v.constraints if k.name != d["drop_constraint"])
            if len(left) == len(v.constraints):
                raise DialectError(f"no constraint {d['drop_constraint']}")
            v = replace(v, constraints=left)
        self.transaction.alter(key, v)
        self._done()
        return self._count(1)

    def _create_index(self, s: Statement, values: dict) -> DataFrame:
        d = s.data
        key = self.key(d["table"])
        v = self.transaction.version(key)
        if any(x.name == d["name"] for x in v.indexes):
            raise DialectError(f"index {d['name']} exists already")
        missing = [c for c in d["columns"] if c not in v.rows.columns]
        if missing:
            raise DialectError(f"no column {missing[0]}")
        self.transaction.alter(key, replace(v, indexes=(*v.indexes, Index(d["name"], d["columns"], d["unique"]))))
        self._done()
        return self._count(1)

    def _drop_index(self, s: Statement, values: dict) -> DataFrame:
        d = s.data
        found = [k for k, v in self.transaction.tables.items() if any(x.name == d["name"] for x in v.indexes) and (d["table"] is None or k == self.key(d["table"]))]
        if len(found) != 1:
            raise DialectError(f"{len(found)} indexes are named {d['name']}")
        v = self.transaction.version(found[0])
        self.transaction.alter(found[0], replace(v, indexes=tuple(x for x in v.indexes if x.name != d["name"])))
        self._done()
        return self._count(1)

    def _no_cycle(self, table: Key, target: Key) -> None:
        seen, todo = set(), [target]
        while todo:
            t = todo.pop()
            if t == table and t != target or t == table and table in seen:
                raise DialectError(f"circular foreign keys through {'.'.join(table)}")
            if t not in seen and t in self.transaction.tables:
                seen.add(t)
                todo += [self.key(k.target) for k in self.transaction.tables[t].constraints if k.kind == "foreign"]

    def _create_view(self, s: Statement, values: dict) -> DataFrame:
        """The query's plan under a name; as its tables stand now, like every frame here."""
        key = self.key(s.data["table"])
        if key in self.transaction.tables:
            raise DialectError(f"{'.'.join(key)} exists already")
        self.transaction.add_view(key, self._select(s, values))
        self._done()
        return self._count(1)

    def _show_tables(self, s: Statement, values: dict) -> DataFrame:
        rows = [(k[0], k[1], v.kind) for k, v in sorted(self.transaction.tables.items())]
        return self.spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")

    def _describe(self, s: Statement, values: dict) -> DataFrame:
        df = self.spark.table(self.view(s.data["table"])).drop(ROW_ID)
        return self.spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)], "seq_no int, column_name string, column_type string")

    def _drop(self, s: Statement, values: dict) -> DataFrame:
        key = self.key(s.data["table"])
        if key not in self.transaction.tables:
            if s.data["maybe"]:
                return self._count(0)
            raise DialectError(f"no table {'.'.join(key)}")
        self.transaction.drop(key)
        self._done()
        return self._count(1)

    def _shaped(self, v: Version, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        """rows, whose columns stand for `columns` in order, as rows of the table; the others take
        their defaults."""
        names = list(columns) or v.rows.columns
        if len(names) != len(rows.columns):
            raise DialectError(f"{len(names)} columns, {len(rows.columns)} values")
        given = rows.toDF(*[f"__{i}" for i in range(len(names))])
        defaults = {c.name: c.default for c in v.columns if c.default is not None}
        out = []
        for f in v.rows.schema.fields:
            if f.name in names:
                x = F.col(f"__{names.index(f.name)}")
            elif f.name in defaults:
                x = F.expr(Lower(self, {}).expr(defaults[f.name]))
            else:
                x = F.lit(None)
            out.append(self._sized(v, f.name, x.cast(f.dataType)).alias(f.name))
        return given.select(*out)

    def _sized(self, v: Version, column: str, value):
        """The value of a column; one too long for the column's size stops the statement."""
        size = next((c.size for c in v.columns if c.name == column and c.type == "string" and c.size), None)
        if not size:
            return value
        return F.when(F.char_length(value) > size[0], F.raise_error(F.lit(f"{column} takes {size[0]} characters"))).otherwise(value)

    def _insert(self, s: Statement, values: dict) -> DataFrame:
        key = self.key(s.data["table"])
        v = self.transaction.version(key)
        low = Lower(self, values)
        if "rows" in s.data:
            text = " UNION ALL ".join("SELECT " + ", ".join(f"{low.expr(e)} AS c{i}" for i, e in enumerate(r)) for r in s.data["rows"])
        else:
            text = low.query(s.data["query"])
        rows = self._shaped(v, self.analysed(text, values), s.data["columns"])
        n = self.transaction.insert(key, rows)
        self._done()
        return self._count(n)

    def _where(self, key: Key, where, values: dict) -> DataFrame:
        """The table's rows with their ids that a condition picks."""
        v = self.transaction.version(key)
        if not v.mutable:
            raise PermissionError(f"{'.'.join(key)} is read-only")
        view = self._view(v.df, None)
        low = Lower(self, values)
        low.scope.append(f"`{view}` AS `{key[1]}`")
        return self.analysed(f"SELECT * FROM `{view}` AS `{key[1]}`" + (f" WHERE {low.predicate(where)}" if where is not None else ""), values)

    def _update(self, s: Statement, values: dict) -> DataFrame:
        key = self.key(s.data["table"])
        rows = self._where(key, s.data["where"], values)
        low = Lower(self, values)
        view = self._view(rows, None)
        low.scope.append(f"`{view}`")
        sets = dict(s.data["sets"])
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        unknown = set(sets) - set(kinds)
        if unknown:
            raise DialectError(f"no column {unknown.pop()}")
        new = self.analysed("SELECT " + ", ".join(f"CAST({low.expr(sets[c])} AS {k}) AS `{c}`" if c in sets else f"`{c}`" for c, k in kinds.items()) + f" FROM `{view}`", values)
        v = self.transaction.version(key)
        n = self.transaction.update(key, new.select(*[self._sized(v, c, F.col(c)).alias(c) for c in new.columns]))
        self._done()
        return self._count(n)

    def _delete(self, s: Statement, values: dict) -> DataFrame:
        key = self.key(s.data["table"])
        rows = self._where(key, s.data["where"], values)
        n = self.transaction.delete(key, rows)
        self._done()
        return self._count(n)

    def updatable(self, text: str, params: Sequence | Mapping | None = None) -> UpdatableView:
        """A result whose rows can be changed: plain columns of one table."""
        (s,) = parse(text)
        q = s.data.get("query")
        b = q.body if q else None
        if s.kind != "select" or not isinstance(b, Select) or len(b.tables) != 1 or not isinstance(b.tables[0], Table) or b.group or b.distinct or not all(isinstance(o.expr, Column) and o.alias in (None, o.expr.path[-1]) or o.source == "*" for o in b.outputs):
            raise DialectError("not updatable: it must be plain columns of one table")
        values = {str(i): v for i, v in enumerate(params)} if isinstance(params, (list, tuple)) else dict(params or {})
        return UpdatableView(self, self.key(b.tables[0].path), b.where, values)

    def check(self, table: str) -> dict[str, int]:
        """Rows that break each constraint of a table; constraints are recorded, not enforced."""
        key = self.key(table.split("."))
        v = self.transaction.version(key)
        out: dict[str, int] = {}
        df = v.rows
        unique = [(c.name,) for c in v.columns if c.unique or c.primary] + [k.columns for k in (*(k for k in v.constraints if k.kind in ("primary", "unique")), *(x for x in v.indexes if x.unique))]
        for columns in unique:
            extra = df.groupBy(*columns).count().filter("count > 1").agg(F.sum(F.col("count") - 1)).first()[0]
            out[f"unique({','.join(columns)})"] = extra or 0
        for k in v.constraints:
            if k.kind == "check":
                ok = Lower(self, {}).predicate(k.check)
                out[f"check({k.check_source})"] = df.filter(f"NOT coalesce({ok}, false)").count()
            if k.kind == "foreign":
                target = self.transaction.version(self.key(k.target)).rows.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(k.target_columns or k.columns)])
                on = [F.col(c) == F.col(f"_t{i}") for i, c in enumerate(k.columns)]
                out[f"foreign({','.join(k.columns)})"] = df.dropna(subset=list(k.columns)).join(target, on, "left_anti").count()
        return out


class UpdatableView:
    """Rows of one table; changes are gathered and written by finish()."""

    def __init__(self, session: Session, key: Key, where, values: dict) -> None:
        self.session, self.key, self.where, self.values = session, key, where, values
        self._new: list[dict] = []
        self._set: dict[str, dict] = {}
        self._gone: list[str] = []

    def rows(self) -> Iterator[Row]:
        """The rows, each with its row id."""
        return self.session._where(self.key, self.where, self.values).toLocalIterator()

    def insert(self, **values) -> None:
        self._new.append(values)

    def update(self, row: Row | str, **values) -> None:
        self._set.setdefault(row if isinstance(row, str) else row[ROW_ID], {}).update(values)

    def delete(self, row: Row | str) -> None:
        self._gone.append(row if isinstance(row, str) else row[ROW_ID])

    def finish(self) -> None:
        """Writes what was gathered: one layer for all new rows, one for all changed and one for all deleted ones."""
        s, spark = self.session, self.session.spark
        v = s.transaction.version(self.key)
        schema = v.rows.schema
        by: dict[tuple, list] = {}
        for values in self._new:
            by.setdefault(tuple(values), []).append(tuple(values.values()))
        new = [s._shaped(v, spark.createDataFrame(rows, T.StructType([schema[c] for c in names])), names) for names, rows in by.items()]
        if new:
            s.transaction.insert(self.key, reduce(DataFrame.unionByName, new))
        if self._set:
            names = sorted({c for values in self._set.values() for c in values})
            fields = [T.StructField("__id", T.StringType())]
            for i, c in enumerate(names):
                fields += [T.StructField(f"__set{i}", T.BooleanType()), T.StructField(f"__{i}", schema[c].dataType)]
            rows = [(row_id, *[x for c in names for x in (c in values, values.get(c))]) for row_id, values in self._set.items()]
            changes = spark.createDataFrame(rows, T.StructType(fields))
            joined = s.transaction.tables[self.key].df.join(changes, F.col(ROW_ID) == F.col("__id"))
            pick = lambda c: F.when(F.col(f"__set{names.index(c)}"), F.col(f"__{names.index(c)}")).otherwise(F.col(c)) if c in names else F.col(c)
            s.transaction.update(self.key, joined.select(*[s._sized(v, c, pick(c)).alias(c) for c in [*v.rows.columns, ROW_ID]]))
        if self._gone:
            s.transaction.delete(self.key, spark.createDataFrame([(g,) for g in self._gone], f"{ROW_ID} string"))
        self._new, self._set, self._gone = [], {}, []
        s._done()


def expression(session: Session, text: str):
    """A dialect expression as a Column over a DataFrame's own columns."""
    return F.expr(Lower(session, {}).expr(parse_expr(text)))
