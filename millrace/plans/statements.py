"""Registered queries that take more than one SELECT: statements, transactions, sources and sinks, errors, streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.dialect.lexer import DialectError
from millrace.functions.spec import parse_sets, parse_spec
from millrace.functions.values import Value
from millrace.operators.asof import asof_join, interval_join
from millrace.session import CommitError, Session, expression
from millrace.sources import files, wire
from millrace.sources.connector import FolderConnector
from millrace.streaming.windows import windowed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str]] = {}


def registered(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def facts(spark: SparkSession, rows: list[tuple[str, object]]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "fact string, answer string")


def told(rows: list[tuple[str, object]]) -> str:
    quote = lambda x: "'" + str(x).replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quote(k)}, {quote(v)})" for k, v in rows) + ") t(fact, answer)"


def outcome(f: Callable) -> str:
    """What a statement does: fine, or the kind of error that stops it."""
    try:
        f()
    except Exception as e:
        return type(e).__name__
    return "fine"


# --- sources and sinks
_DDL = """
CREATE TABLE author (id BIGINT PRIMARY KEY, name VARCHAR(20) NOT NULL UNIQUE);
CREATE TABLE book (id BIGINT NOT NULL, author_id BIGINT, title VARCHAR(30) DEFAULT 'untitled', pages INTEGER,
  CONSTRAINT book_key PRIMARY KEY (id), CONSTRAINT long_enough CHECK (pages > 0),
  CONSTRAINT written_by FOREIGN KEY (author_id) REFERENCES author (id) ON DELETE CASCADE ON UPDATE SET NULL NOT DEFERRABLE);
CREATE UNIQUE INDEX by_title ON book (title, id)
"""


@registered(
    "SELECT * FROM (VALUES ('check', 'book', 'long_enough pages > 0'), ('column', 'author', 'id bigint true'), ('column', 'author', 'name string true'), "
    "('column', 'book', 'author_id bigint false'), ('column', 'book', 'id bigint true'), ('column', 'book', 'pages int false'), ('column', 'book', 'title string false'), "
    "('default', 'book', 'title ''untitled'''), ('foreign', 'book', 'written_by author_id author id SET NULL CASCADE NOT DEFERRABLE'), ('index', 'book', 'by_title title,id true'), "
    "('schema', 'APP', ''), ('schema', 'SYSTEM', ''), ('table', 'author', 'TABLE'), ('table', 'book', 'TABLE'), ('unique', 'author', 'id true'), ('unique', 'author', 'name false'), ('unique', 'book', 'id true'), ('one', '1', ''), ('none', '0', '')) t(kind, name, detail)"
)
def sc8_system_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All system tables, after some definitions."""
    s = Session(spark, sf_dir)
    s.sql(_DDL)
    sets = "(SELECT id, group_concat(column_name ORDER BY seq_no) AS names FROM SYSTEM.ColumnSet GROUP BY id)"
    out = s.sql(f"""
      SELECT 'table' AS kind, table_name AS name, table_type AS detail FROM SYSTEM.Tables
      UNION ALL SELECT 'schema' AS kind, schema_name AS name, '' AS detail FROM SYSTEM.Schema
      UNION ALL SELECT 'column' AS kind, table_name AS name, concat(column_name, ' ', column_type, ' ', not_null) AS detail FROM SYSTEM.TableColumns
      UNION ALL SELECT 'default' AS kind, table_name AS name, concat(column_name, ' ', default_source) AS detail FROM SYSTEM.DefaultColumnExpressions
      UNION ALL SELECT 'check' AS kind, table_name AS name, concat(name, ' ', check_source) AS detail FROM SYSTEM.ConstraintsCheck
      UNION ALL SELECT 'unique' AS kind, u.table_name AS name, concat(c.names, ' ', u.primary_key) AS detail FROM SYSTEM.ConstraintsUnique u, {sets} c WHERE c.id = u.column_set_id
      UNION ALL SELECT 'foreign' AS kind, f.table_name AS name, concat(f.name, ' ', c.names, ' ', f.ref_table, ' ', r.names, ' ', f.update_action, ' ', f.delete_action, ' ', f.deferred) AS detail
        FROM SYSTEM.ConstraintsForeign f, {sets} c, {sets} r WHERE c.id = f.column_set_id AND r.id = f.ref_column_set_id
      UNION ALL SELECT 'index' AS kind, i.table_name AS name, concat(i.index_name, ' ', c.names, ' ', i.unique) AS detail FROM SYSTEM.Index i, {sets} c WHERE c.id = i.column_set_id
      UNION ALL SELECT 'one' AS kind, CAST(count(*) AS VARCHAR(5)) AS name, '' AS detail FROM SYSTEM.OneRowTable
      UNION ALL SELECT 'none' AS kind, CAST(count(*) AS VARCHAR(5)) AS name, '' AS detail FROM SYSTEM.EmptyRowTable""")
    return out.withColumn("detail", F.regexp_replace(F.regexp_replace("detail", ", ", ","), "(?i)(true|false)$", F.lower(F.regexp_extract("detail", "(?i)(true|false)$", 0))))


@registered("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 7")
def sc10_connector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of a table that a connector stores with one of the folder."""
    store = FolderConnector(spark, f"{files.shared_dir(spark)}/connector-{uuid.uuid4().hex}", "orc")
    store.create("places", files.parquet_table(spark, sf_dir, "nation"))
    store.create("unused", files.parquet_table(spark, sf_dir, "region"))
    store.drop("unused")
    assert store.tables() == ["places"]
    return Session(spark, sf_dir, connector=store).sql("SELECT n_name, r_name FROM places JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 7")


@registered("SELECT n_name AS n_name FROM nation WHERE n_nationkey > 3 AND n_name <> 'NATION_7'")
def sc11_parameter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters as a table of one row, joined like any other."""
    s = Session(spark, sf_dir)
    s.register("given", s.parameters({"least": 3, "other": "NATION_7"}))
    return s.sql("SELECT n.n_name AS n_name FROM nation n, given g WHERE n.n_nationkey > g.least AND n.n_name <> g.other")


@registered("SELECT n_nationkey AS k, CASE WHEN n_nationkey = 3 THEN 'three' WHEN n_nationkey = 4 THEN NULL ELSE n_name END AS name, n_regionkey AS r FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT 100 AS k, 'hundred' AS name, NULL AS r UNION ALL SELECT 101 AS k, NULL AS name, 1 AS r")
def sc14_updatable_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a result inserted, changed and deleted by hand."""
    s = Session(spark, sf_dir)
    s.sql("CREATE TABLE place (k INTEGER, name VARCHAR(20), r INTEGER); INSERT INTO place SELECT n_nationkey, n_name, n_regionkey FROM nation")
    view = s.updatable("SELECT k, name FROM place WHERE k > 2 AND k < 6")
    for row in view.rows():
        if row.k == 3:
            view.update(row, name="three")
        elif row.k == 4:
            view.update(row, name=None)
        else:
            view.delete(row)
    view.insert(k=100, name="hundred")
    view.insert(k=101, r=1)
    view.finish()
    return s.sql("SELECT k, name, r FROM place")


@registered("SELECT row_number() OVER (ORDER BY n_name DESC) AS place, n_name, n_nationkey FROM nation ORDER BY n_name DESC LIMIT 7")
def sc15_so7_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result read row by row, in order, up to the client's maximum."""
    reader = Session(spark, sf_dir).rows("SELECT n_name, n_nationkey FROM nation ORDER BY n_name DESC", most=7)
    return spark.createDataFrame([(i + 1, r.n_name, r.n_nationkey) for i, r in enumerate(reader)], "place bigint, n_name string, n_nationkey int")


@registered("SELECT count(*) AS n FROM orders")
def sc16_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(Session(spark, sf_dir).scalar("SELECT count(*), 'more' FROM orders"),)], "n bigint")


@registered("SELECT kind, n_nationkey, n_name FROM nation, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) t(kind)")
def sc18_file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written in each format and read back with its schema."""
    rows, out = files.parquet_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), None
    for kind in ("csv", "json", "orc", "parquet"):
        path = f"{files.shared_dir(spark)}/format-{kind}-{uuid.uuid4().hex}"
        files.write(rows, path, kind)
        read = spark.read.schema(rows.schema).format(kind).load(path).select(F.lit(kind).alias("kind"), "*")
        out = read if out is None else out.unionByName(read)
    return out


@registered("SELECT b, octet_length(encode(b)) AS n, encode(b) = encode('NATION_1') AS same FROM (SELECT n_name AS b FROM nation)")
def sc19_f13_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary values: cast, length, comparison, and a round through a table."""
    s = Session(spark, sf_dir)
    s.sql("CREATE TABLE lob (data BLOB); INSERT INTO lob SELECT CAST(n_name AS BINARY) FROM nation")
    return s.sql("SELECT CAST(data AS VARCHAR(30)) AS b, length(data) AS n, data = CAST('NATION_1' AS BINARY) AS same FROM lob").withColumn("n", F.col("n").cast("long"))


@registered('SELECT n_nationkey + 1 AS "#1#n_nationkey + 1", upper(n_name) AS "#2#upper(n_name)", n_regionkey FROM nation')
def pr5_auto_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(spark, sf_dir).sql("SELECT n_nationkey + 1, upper(n_name), n_regionkey FROM nation")


@registered("SELECT true AS d, true AS t, true AS s")
def ex17_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(spark).sql("SELECT CURRENT_DATE <= CURRENT_TIMESTAMP AS d, CURRENT_TIME LIKE '__:__:__' AS t, CURRENT_TIMESTAMP > CAST('2020-01-01' AS TIMESTAMP) AS s")


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000.5 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderpriority <> '5-LOW'")
def sc17_wire_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement and its parameters sent as bytes."""
    sent = wire.packed("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > :least AND o_orderdate >= :day AND o_orderpriority <> :low", {"least": Decimal("250000.5"), "day": datetime(1996, 1, 1), "low": "5-LOW"})
    return Session(spark, sf_dir).sql(*wire.unpacked(sent))


@registered("SELECT n_nationkey AS k, n_name AS a, n_regionkey + 1 AS b FROM nation")
def ex19_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(spark, sf_dir).sql("SELECT n_nationkey AS k, composite_fetch(composite(n_name, n_regionkey + 1), 0) AS a, composite_fetch(composite(n_name, n_regionkey + 1), 1) AS b FROM nation")


# --- joins that the dialect has no words for
@registered("SELECT e.event_id, e.user_id, max(p.event_id) AS before_id FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'click' AND p.ts < e.ts AND p.ts >= e.ts - INTERVAL 2 HOUR AND NOT EXISTS (SELECT 1 FROM events q WHERE q.user_id = p.user_id AND q.event_type = 'click' AND q.ts < e.ts AND q.ts > p.ts) WHERE e.event_type = 'purchase' GROUP BY e.event_id, e.user_id")
def jo15_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click of the same user within two hours before each purchase."""
    events = files.parquet_table(spark, sf_dir, "events")
    clicks = events.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("before_id"))
    buys = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(buys, clicks, "ts", ["user_id"], within="INTERVAL 2 HOURS").select("event_id", "user_id", "before_id")


@registered("SELECT a.event_id AS x, b.event_id AS y FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 30 MINUTE WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def jo15_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of the same user within half an hour after a click."""
    events = files.parquet_table(spark, sf_dir, "events")
    clicks = events.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("x"))
    buys = events.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("y"))
    return interval_join(clicks, buys, "ts", "at", seconds=1800, keys=["user_id"]).select("x", "y")


# --- errors
_REJECTED = {
    "DISTINCT on a scalar function": "SELECT abs(DISTINCT n_nationkey) FROM nation",
    "* on a scalar function": "SELECT upper(*) FROM nation",
    "sum(*)": "SELECT sum(*) FROM nation",
    "aggregate in WHERE": "SELECT n_name FROM nation WHERE max(n_nationkey) > 3",
    "aggregate of an aggregate": "SELECT max(count(n_nationkey)) FROM nation",
    "HAVING without GROUP BY": "SELECT n_name FROM nation HAVING n_name > 'a'",
    "wrong number of arguments": "SELECT mod(1) FROM nation",
    "unknown table": "SELECT a FROM nowhere",
    "no value for a parameter": "SELECT n_name FROM nation WHERE n_nationkey = :missing",
    "no expression": "SELECT FROM nation",
    "open string": "SELECT 'abc FROM nation",
    "unbalanced": "SELECT (1 + 2 FROM nation",
    "not a statement": "GRANT ALL ON nation",
}


@registered(told([(k, "DialectError") for k in _REJECTED]))
def ag14_ag16_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark, sf_dir)
    return facts(spark, [(k, outcome(lambda: s.sql(text))) for k, text in _REJECTED.items()])


# --- functions
@registered(told([("parameters", "<NUMERIC|STRING>T, BOOLEAN?, ANY*"), ("takes", "False True True True"), ("volatile", "False"), ("sets", "FUNCTION math half twice; AGGREGATE stats width"), ("bad type", "ValueError"), ("bad set", "ValueError"), ("half", "1.5"), ("width", "24.0")]))
def u1_u6_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of definitions, and sets of them."""
    p = parse_spec("VOLATILE T pick(<NUMERIC|STRING> T, BOOLEAN?, ANY*)")
    text = "FUNCTION math { DETERMINISTIC NUMERIC half(NUMERIC); VOLATILE NUMERIC twice(NUMERIC); } AGGREGATE stats { DETERMINISTIC NUMERIC width(NUMERIC); }"
    sets = parse_sets(text)
    s = Session(spark, sf_dir)
    s.add_functions(text, {"half": lambda x: x / 2, "twice": lambda x: x * 2, "width": lambda x: float(x.max() - x.min())})
    shown = ", ".join(("<" + "|".join(q.kinds) + ">" if len(q.kinds) > 1 else q.kinds[0]) + "T" * q.same + q.often for q in p.parameters)
    return facts(
        spark,
        [
            ("parameters", shown),
            ("takes", " ".join(str(p.takes(n)) for n in (0, 1, 2, 9))),
            ("volatile", p.deterministic),
            ("sets", "; ".join(f"{'AGGREGATE' if a else 'FUNCTION'} {name} {' '.join(x.name for x in specs)}" for a, name, specs in sets)),
            ("bad type", outcome(lambda: parse_spec("DETERMINISTIC NUMERIC f(WORDS)"))),
            ("bad set", outcome(lambda: parse_sets("FUNCTION a { NUMERIC f(NUMERIC) } nonsense"))),
            ("half", s.scalar("SELECT half(3)")),
            ("width", s.scalar("SELECT width(n_nationkey) FROM nation")),
        ],
    )


@registered("SELECT n_nationkey AS k, CASE WHEN n_nationkey > 5 THEN n_name ELSE '-' END AS s, CAST(CASE WHEN n_nationkey > 5 THEN n_nationkey ELSE 0 END AS DOUBLE) AS n, CASE WHEN n_nationkey > 5 THEN n_nationkey > 9 ELSE false END AS b, 1 + CAST(CASE WHEN n_nationkey > 5 THEN n_nationkey ELSE 0 END AS DOUBLE) AS m FROM nation")
def u4_inferred_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result of type T follows the arguments tagged T; a column at a time."""
    s = Session(spark, sf_dir)
    s.add_function("DETERMINISTIC T either(BOOLEAN, ANY T, ANY T)", lambda c, a, b: a.where(c, b), vectorised=True)
    return s.sql("SELECT n_nationkey AS k, either(n_nationkey > 5, n_name, '-') AS s, either(n_nationkey > 5, n_nationkey, 0) AS n, either(n_nationkey > 5, n_nationkey > 9, FALSE) AS b, 1 + either(n_nationkey > 5, n_nationkey, 0) AS m FROM nation")


@registered(told([("deterministic", "True"), ("volatile", "False")]))
def u5_determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flag reaches the optimizer: only a deterministic call may be merged with its like or moved."""
    s = Session(spark, sf_dir)
    s.add_function("DETERMINISTIC NUMERIC steady(NUMERIC)", lambda x: x)
    s.add_function("VOLATILE NUMERIC shaky(NUMERIC)", lambda x: x)
    flag = lambda name: s.sql(f"SELECT {name}(n_nationkey) AS x FROM nation")._jdf.queryExecution().analyzed().projectList().head().deterministic()
    return facts(spark, [("deterministic", flag("steady")), ("volatile", flag("shaky"))])


@registered("SELECT n_nationkey AS k, upper(n_name) || '!' AS a, trim(n_name, 'N') AS b, round(sqrt(n_nationkey), 3) AS c, n_nationkey % 4 * 2 - 1 AS d, (n_nationkey > 3 AND NOT n_regionkey <= 1) OR n_nationkey = 0 AS e, substring(n_name, 2, 3) AS f FROM nation")
def f25_host_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions built in the host language, and from text."""
    s = Session(spark, sf_dir)
    key, region, name = (Value.column(c) for c in ("n_nationkey", "n_regionkey", "n_name"))
    return files.parquet_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("k"),
        name.upper().concat("!").on(s).alias("a"),
        name.trim("N").on(s).alias("b"),
        key.sqrt().round(3).on(s).alias("c"),
        (key % 4 * Value.of(2) - 1).on(s).alias("d"),
        (((key > 3) & ~(region <= 1)) | key.equals(0)).on(s).alias("e"),
        expression(s, "substring(n_name, 2, 3)").alias("f"),
    )


# --- definitions and transactions
@registered(told([("unique", "1"), ("check", "2"), ("foreign", "1"), ("cycle", "DialectError"), ("self reference", "fine"), ("NULL into NOT NULL", "ValueError"), ("NULL by UPDATE", "ValueError"), ("rows", "5")]))
def d2_d4_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints are recorded and can be checked; NOT NULL and cycles stop a statement."""
    s = Session(spark, sf_dir)
    s.sql(_DDL)
    s.sql("INSERT INTO author (id, name) VALUES (1, 'A'), (2, 'B'), (2, 'C'); INSERT INTO book (id, author_id, pages) VALUES (1, 1, 10), (2, 7, 0), (3, NULL, NULL), (4, 2, 5), (5, 1, 7)")
    found = s.check("book")
    loop = "CREATE TABLE a1 (x INTEGER, FOREIGN KEY (x) REFERENCES b1 (y)); CREATE TABLE b1 (y INTEGER, FOREIGN KEY (y) REFERENCES a1 (x))"
    return facts(
        spark,
        [
            ("unique", s.check("author")["unique(id)"]),
            ("check", found["check(pages > 0)"]),
            ("foreign", found["foreign(author_id)"]),
            ("cycle", outcome(lambda: s.sql(loop))),
            ("self reference", outcome(lambda: s.sql("CREATE TABLE tree (id INTEGER, up INTEGER, FOREIGN KEY (up) REFERENCES tree (id))"))),
            ("NULL into NOT NULL", outcome(lambda: s.sql("INSERT INTO author (id) VALUES (9)"))),
            ("NULL by UPDATE", outcome(lambda: s.sql("UPDATE author SET name = NULL WHERE id = 1"))),
            ("rows", s.scalar("SELECT count(*) FROM book")),
        ],
    )


@registered("SELECT n_nationkey AS k, 'new' AS note, CASE WHEN n_nationkey > 20 THEN 7 ELSE 3 END AS size FROM nation")
def d5_alter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns added with a default and dropped, constraints and indexes made and dropped."""
    s = Session(spark, sf_dir)
    s.sql("CREATE TABLE t (k INTEGER, name VARCHAR(20)); INSERT INTO t SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <= 20")
    s.sql("ALTER TABLE t ADD COLUMN note VARCHAR(10) DEFAULT 'new'; ALTER TABLE t ADD size INTEGER DEFAULT 3; ALTER TABLE t ADD CONSTRAINT pos CHECK (size > 0); CREATE INDEX by_k ON t (k)")
    s.sql("ALTER TABLE t DROP COLUMN name; INSERT INTO t (k, size) SELECT n_nationkey, 7 FROM nation WHERE n_nationkey > 20; ALTER TABLE t DROP CONSTRAINT pos; DROP INDEX by_k")
    assert s.check("t") == {} and s.scalar("SELECT count(*) FROM SYSTEM.Index") == 0
    return s.sql("SELECT k, note, size FROM t")


@registered(told([("listed", "by_k k,name true"), ("broken", "1"), ("mended", "0"), ("listed then", "by_k k,name true")]))
def d8_index_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index stays with its table through changes of rows, and a unique one can be checked."""
    s = Session(spark, sf_dir)
    s.sql("CREATE TABLE t (k INTEGER, name VARCHAR(20)); CREATE UNIQUE INDEX by_k ON t (k, name); INSERT INTO t SELECT n_nationkey, n_name FROM nation")
    shown = lambda: s.scalar("SELECT concat(i.index_name, ' ', c.names, ' ', lower(i.unique)) FROM SYSTEM.Index i, (SELECT id, replace(group_concat(column_name ORDER BY seq_no), ', ', ',') AS names FROM SYSTEM.ColumnSet GROUP BY id) c WHERE c.id = i.column_set_id")
    out: list[tuple[str, object]] = [("listed", shown())]
    s.sql("INSERT INTO t VALUES (3, 'NATION_3')")
    out.append(("broken", s.check("t")["unique(k,name)"]))
    s.sql("UPDATE t SET name = 'all' WHERE k > 20; DELETE FROM t WHERE k = 3")
    return facts(spark, [*out, ("mended", s.check("t")["unique(k,name)"]), ("listed then", shown())])


@registered("SELECT n_name AS name, 'APP large VIEW' AS shown, 'name string, k int' AS shape FROM nation WHERE n_nationkey > 12")
def d18_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE VIEW, SHOW TABLES, DESCRIBE, DROP VIEW: extensions."""
    s = Session(spark, sf_dir)
    s.sql("CREATE VIEW large AS SELECT n_name AS name, n_nationkey AS k FROM nation WHERE n_nationkey > 10; CREATE VIEW gone AS SELECT 1 AS one; DROP VIEW gone")
    shown = "; ".join(" ".join(r) for r in s.sql("SHOW TABLES").collect())
    shape = ", ".join(f"{r.column_name} {r.column_type}" for r in s.sql("DESCRIBE large").collect())
    assert outcome(lambda: s.sql("INSERT INTO large VALUES ('x', 1)")) == "PermissionError"
    return s.sql(f"SELECT name, '{shown}' AS shown, '{shape}' AS shape FROM large WHERE k > 12")


@registered(told([("drop", "fine"), ("drop again", "DialectError"), ("drop if exists", "fine"), ("select", "DialectError"), ("create twice", "DialectError"), ("create if not exists", "0"), ("index of no column", "DialectError"), ("size", "raised")]))
def d5_drop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark, sf_dir)
    s.sql("CREATE TABLE gone (a INTEGER); CREATE TABLE here (a VARCHAR(3))")
    told_size = outcome(lambda: s.sql("INSERT INTO here VALUES ('abcdef')"))
    return facts(
        spark,
        [
            ("drop", outcome(lambda: s.sql("DROP TABLE gone"))),
            ("drop again", outcome(lambda: s.sql("DROP TABLE gone"))),
            ("drop if exists", outcome(lambda: s.sql("DROP TABLE IF EXISTS gone"))),
            ("select", outcome(lambda: s.sql("SELECT a FROM gone"))),
            ("create twice", outcome(lambda: s.sql("CREATE TABLE here (a INTEGER)"))),
            ("create if not exists", s.sql("CREATE TABLE IF NOT EXISTS here (a INTEGER)").first()[0]),
            ("index of no column", outcome(lambda: s.sql("CREATE INDEX i ON here (b)"))),
            ("size", "raised" if told_size != "fine" and s.scalar("SELECT count(*) FROM here") == 0 else told_size),
        ],
    )


@registered(told([("filter pushed", "True"), ("columns pruned", "True"), ("broadcast", "True")]))
def d9_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = "\n".join(r[0] for r in Session(spark, sf_dir).sql("EXPLAIN SELECT n.n_name AS n_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND n.n_nationkey > 5").collect())
    return facts(spark, [("filter pushed", "GreaterThan(n_nationkey,5)" in plan), ("columns pruned", "r_name" not in plan), ("broadcast", "BroadcastHashJoin" in plan)])


@registered(told([("variable", "5"), ("isolation", "fine"), ("other isolation", "DialectError"), ("unsaved", "25"), ("other session", "DialectError"), ("after rollback", "DialectError"), ("after commit", "25"), ("rolled back rows", "25")]))
def d11_d12_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET, COMMIT WORK and ROLLBACK WORK; what another session sees meanwhile."""
    s = Session(spark, sf_dir)
    other = Session(spark, sf_dir, database=s.db)
    fill = "CREATE TABLE n (k INTEGER); INSERT INTO n SELECT n_nationkey FROM nation"
    count = lambda x: x.scalar("SELECT count(*) FROM n")
    out: list[tuple[str, object]] = []
    s.sql("SET limit_of = 2 + 3")
    out.append(("variable", s.variables["limit_of"]))
    out.append(("isolation", outcome(lambda: s.sql("SET TRANSACTION ISOLATION LEVEL SERIALIZABLE"))))
    out.append(("other isolation", outcome(lambda: s.sql("SET TRANSACTION ISOLATION LEVEL SNAPSHOT"))))
    s.sql("SET AUTO COMMIT OFF")
    s.sql(fill)
    out += [("unsaved", count(s)), ("other session", outcome(lambda: count(other)))]
    s.sql("ROLLBACK WORK")
    out.append(("after rollback", outcome(lambda: count(s))))
    s.sql(fill + "; COMMIT WORK")
    other.rollback()
    out.append(("after commit", count(other)))
    s.sql("DELETE FROM n; INSERT INTO n VALUES (1); ROLLBACK")
    out.append(("rolled back rows", count(s)))
    return facts(spark, out)


@registered(told([("both insert", "fine"), ("rows", "27"), ("same row deleted", "CommitError"), ("rows then", "26"), ("created twice", "CommitError"), ("dropped meanwhile", "CommitError"), ("altered meanwhile", "CommitError"), ("snapshot", "26"), ("journal", "insert update delete alter")]))
def d13_d15_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots, replay of the journal, and the clashes that stop a commit."""
    a = Session(spark, sf_dir)
    a.sql("CREATE TABLE n (k INTEGER); INSERT INTO n SELECT n_nationkey FROM nation")
    b = Session(spark, sf_dir, database=a.db)
    for s in (a, b):
        s.sql("SET AUTO COMMIT OFF")
    count = lambda s: s.scalar("SELECT count(*) FROM n")
    out: list[tuple[str, object]] = []

    def both(first: str, second: str) -> str:
        a.rollback(), b.rollback()
        a.sql(first), b.sql(second)
        a.commit()
        return outcome(b.commit)

    out.append(("both insert", both("INSERT INTO n VALUES (100)", "INSERT INTO n VALUES (101)")))
    out.append(("rows", count(b)))
    out.append(("same row deleted", both("DELETE FROM n WHERE k = 100", "UPDATE n SET k = 7 WHERE k = 100")))
    out.append(("rows then", count(b)))
    out.append(("created twice", both("CREATE TABLE m (x INTEGER)", "CREATE TABLE m (y INTEGER)")))
    out.append(("dropped meanwhile", both("DROP TABLE m", "INSERT INTO m VALUES (1)")))
    out.append(("altered meanwhile", both("ALTER TABLE n ADD note VARCHAR(3)", "INSERT INTO n VALUES (5)")))
    a.rollback(), b.rollback()
    a.sql("DELETE FROM n WHERE k < 10; COMMIT")
    out.append(("snapshot", count(b)))
    b.rollback()
    b.sql("INSERT INTO n (k) VALUES (1); UPDATE n SET note = 'x' WHERE k = 1; DELETE FROM n WHERE k = 1; ALTER TABLE n DROP note")
    out.append(("journal", " ".join(e.code for e in b.transaction.journal)))
    return facts(spark, out)


@registered("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey IN (3, 4)")
def d19_client_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection, command, parameters, reader: one after the other."""
    with Session(spark, sf_dir) as s:
        rows = list(s.rows("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey = ? OR n_name = ?", [3, "NATION_4"]))
    return spark.createDataFrame([(r["k"], r[1]) for r in rows], "k int, name string")


# --- streams
@registered("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def str_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event windows of a stream: read as files arrive, a watermark bounding the state, written with a checkpoint."""
    base = f"{files.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = files.parquet_table(spark, sf_dir, "events")
    events.orderBy("ts").write.parquet(f"{base}/in")
    # a last event far ahead lets the watermark close every window; its own stays open
    events.limit(1).withColumn("ts", F.expr("ts + INTERVAL 9999 DAYS")).write.mode("append").parquet(f"{base}/in")
    stream = windowed(spark.readStream.schema(events.schema).parquet(f"{base}/in"), late="2 days")
    done = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items()}
