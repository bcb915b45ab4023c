"""System tables as DataFrames over the catalog of a transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LAYOUTS = {
    "Tables": "table_schema string, table_name string, table_type string, version bigint",
    "Schema": "schema_name string",
    "TableColumns": "table_schema string, table_name string, column_name string, column_type string, not_null boolean, seq_no int",
    "ColumnSet": "id bigint, seq_no int, column_name string",
    "ConstraintsUnique": "table_schema string, table_name string, name string, column_set_id bigint, deferred string, primary_key boolean",
    "ConstraintsForeign": "table_schema string, table_name string, name string, column_set_id bigint, ref_table string, ref_column_set_id bigint, update_action string, delete_action string, deferred string",
    "ConstraintsCheck": "table_schema string, table_name string, name string, check_source string, deferred string",
    "DefaultColumnExpressions": "table_schema string, table_name string, column_name string, default_source string",
    "Index": "table_schema string, table_name string, index_name string, column_set_id bigint, unique boolean",
    "EmptyRowTable": "nothing int",
    "OneRowTable": "one int",
}


def system_table(spark: SparkSession, name: str, tables: dict, schemas: set[str]) -> DataFrame | None:
    """SYSTEM.<name>, or None if there is no such table. The catalog is metadata: it is small."""
    found = next((k for k in _LAYOUTS if k.lower() == name.lower()), None)
    if found is None:
        return None
    rows: list[tuple] = []
    sets: list[tuple] = []

    def column_set(columns) -> int:
        sets.extend((len({s[0] for s in sets}) if i == 0 else sets[-1][0], i, c) for i, c in enumerate(columns))
        return sets[-1][0] if columns else -1

    out: dict[str, list[tuple]] = {k: [] for k in _LAYOUTS}
    out["OneRowTable"] = [(1,)]
    out["Schema"] = [(s,) for s in sorted(schemas)]
    for (schema, table), v in sorted(tables.items()):
        out["Tables"].append((schema, table, v.kind, v.number))
        not_null = {c.name: c.not_null for c in v.columns}
        for i, f in enumerate(v.rows.schema.fields):
            out["TableColumns"].append((schema, table, f.name, f.dataType.simpleString(), bool(not_null.get(f.name, False)), i))
        for c in v.columns:
            if c.default is not None:
                out["DefaultColumnExpressions"].append((schema, table, c.name, c.default_source))
            if c.unique or c.primary:
                out["ConstraintsUnique"].append((schema, table, None, column_set((c.name,)), "", c.primary))
        for x in v.indexes:
            out["Index"].append((schema, table, x.name, column_set(x.columns), x.unique))
        for k in v.constraints:
            if k.kind in ("primary", "unique"):
                out["ConstraintsUnique"].append((schema, table, k.name, column_set(k.columns), k.deferrable, k.kind == "primary"))
            elif k.kind == "check":
                out["ConstraintsCheck"].append((schema, table, k.name, k.check_source, k.deferrable))
            else:
                out["ConstraintsForeign"].append((schema, table, k.name, column_set(k.columns), ".".join(k.target), column_set(k.target_columns), k.on_update, k.on_delete, k.deferrable))
    out["ColumnSet"] = sets
    rows = out[found]
    return spark.createDataFrame(rows, _LAYOUTS[found])
