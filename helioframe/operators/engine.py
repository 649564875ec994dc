"""Tables with row changes, on versioned Parquet directories in the session catalog.

A database is a prefix of namespaces (`db__schema`). A change writes a new directory and swaps the table's location;
the old version stays until vacuum. One writer at a time: there is no concurrency control.
"""

from __future__ import annotations

import json
import logging
import re
import uuid
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from helioframe.operators import relational
from helioframe.plans.dialect import from_postgres
from helioframe.plans.text import ColumnSpec, bind_marks, column_spec, pretty_size

_log = logging.getLogger("helioframe")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Engine:
    """Typed tables, queries, changes and catalog listings of one database on a Spark session.

    host, port, user and password are accepted, so that a loaded configuration can be passed whole; the session needs none.
    """

    def __init__(self, spark: SparkSession | None = None, host: str = "localhost", port: int = 5432, database: str | None = None, user: str | None = None, password: str | None = None, log_queries: bool = False, logger: logging.Logger | None = None) -> None:
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.database, self.logger = database or "main", logger or _log
        if logger is None:
            _log.setLevel(logging.INFO if log_queries else logging.WARNING)
        self._views: set[str] = set()
        self.create_schema("public")

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def close(self, stop: bool = False) -> None:
        """Drops the temporary views that this engine made; the session is shared, so it only stops when asked."""
        for name in sorted(self._views):
            self.spark.catalog.dropTempView(name)
        self._views.clear()
        if stop:
            self.spark.stop()

    def view(self, name: str, df: DataFrame) -> None:
        """Makes a frame known to queries by a name, until the engine is closed."""
        df.createOrReplaceTempView(name)
        self._views.add(name)

    # Queries

    def _space(self, schema: str | None, database: str | None = None) -> str:
        return f"{database or self.database}__{schema or 'public'}"

    def _name(self, table: str, schema: str | None) -> str:
        if schema is None and "." in table:
            schema, table = table.split(".", 1)
        return f"{_q(self._space(schema))}.{_q(table.lower())}"

    def table(self, table_name: str, schema: str | None = None) -> DataFrame:
        return self.spark.table(self._name(table_name, schema))

    def sql(self, query: str, params: Any = None) -> DataFrame:
        """A query with %s or %(name)s marks as a lazy frame. Values are bound, and not written to the log.

        Names without a schema are those of `public`; the session's own schema stays what it was. PostgreSQL's ~,
        DISTINCT ON, generate_series and information_schema are understood, see plans/dialect.py.
        """
        text, args = bind_marks(query, params)
        text = self._information(from_postgres(text))
        self._say("query: %s (%d parameters)", query, len(args) if args else 0)
        before, views = self.spark.catalog.currentDatabase(), None
        if re.match(r"(?is)\s*CREATE\b.*?\bTEMP", text):
            views = {t.name for t in self.spark.catalog.listTables() if t.isTemporary}
        try:
            self.spark.sql(f"USE {_q(self._space(None))}")
            out = self.spark.sql(text, args=args) if args is not None else self.spark.sql(text)
            if views is not None:
                self._views |= {t.name for t in self.spark.catalog.listTables() if t.isTemporary} - views
            return out
        except Exception:
            self.logger.error("query failed: %s", query)
            raise
        finally:
            self.spark.sql(f"USE {_q(before)}")

    def _say(self, text: str, *args: object) -> None:
        self.logger.info(text, *args)

    def _information(self, text: str) -> str:
        """The text with information_schema's tables as views over the catalog, which are made when they are asked for."""
        for name in {m.lower() for m in re.findall(r"(?i)\binformation_schema\.(tables|columns|schemata)\b", text)}:
            view = f"information_schema_{name}"
            self.view(view, getattr(self, f"_{name}_known")())
            text = re.sub(rf"(?i)\binformation_schema\.{name}\b", view, text)
        return text

    def _schemata_known(self) -> DataFrame:
        return self.spark.createDataFrame([(self.database, x) for x in self.list_schemas()], "catalog_name string, schema_name string")

    def _tables_known(self) -> DataFrame:
        rows = []
        for schema in self.list_schemas():
            space = self._space(schema)
            rows += [(self.database, schema, t, "BASE TABLE") for t in self._tables(space)]
            rows += [(self.database, schema, r["viewName"], "VIEW") for r in self.spark.sql(f"SHOW VIEWS IN {_q(space)}").collect() if not r["isTemporary"]]
        return self.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string")

    def _columns_known(self) -> DataFrame:
        rows = []
        for schema in self.list_schemas():
            for t in self._tables(self._space(schema)):
                rows += [(self.database, schema, t, c["column_name"], i, c["data_type"], c["max_length"], c["is_nullable"], c["default_value"]) for i, c in enumerate(self.describe_table(t, schema), 1)]
        return self.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, data_type string, character_maximum_length int, is_nullable string, column_default string")

    def execute(self, query: str, params: Any = None, fetch: bool = False, dict_cursor: bool = True, stream: bool = False) -> list | Iterator | None:
        """Runs a query; with fetch, its rows as dicts or tuples. With stream they come one by one, and the driver holds
        those of one partition at a time; else all of them, as a list."""
        out = self.sql(query, params)
        if not fetch:
            return None
        shape = Row.asDict if dict_cursor else tuple
        if stream:
            return map(shape, out.toLocalIterator())
        rows = [shape(r) for r in out.collect()]
        self._say("%d rows", len(rows))
        return rows

    def select(self, table_name: str, columns: Sequence[str] | None = None, where: Mapping[str, Any] | None = None, schema: str | None = None, order_by: str | None = None, limit: int | None = None) -> DataFrame:
        return relational.select(self.table(table_name, schema), columns, where, order_by, limit)

    def select_date_range(self, table_name: str, date_column: str, start_date: Any, end_date: Any, columns: Sequence[str] | None = None, where: Mapping[str, Any] | None = None, schema: str | None = None, order_by: str | None = None, limit: int | None = None, inclusive_end: bool = False) -> DataFrame:
        return relational.select_date_range(self.table(table_name, schema), date_column, start_date, end_date, columns, where, order_by, limit, inclusive_end)

    def count(self, table_name: str, where: Mapping[str, Any] | None = None, schema: str | None = None) -> int:
        return relational.count(self.table(table_name, schema), where).first()["n"]

    # Changes

    def insert(self, table_name: str, data: Mapping[str, Any] | Sequence[Mapping[str, Any]] | DataFrame, schema: str | None = None, return_id: bool = False) -> int | None:
        """Appends a row, rows or a frame in one job. Missing columns take their defaults, serial ones the next numbers.

        All rows must have the same keys. return_id gives the `id` of a single row. Duplicates in unique columns and
        nulls in required ones are refused before anything is written.
        """
        name, specs = self._name(table_name, schema), self._specs(table_name, schema)
        single = isinstance(data, Mapping)
        if isinstance(data, DataFrame):
            df = data
        else:
            rows = [data] if single else list(data)
            if not rows:
                self.logger.warning("nothing to insert into %s", table_name)
                return None
            keys = list(rows[0])
            for r in rows:
                if set(r) != set(keys):
                    raise ValueError(f"rows must have the same columns; differing: {sorted(set(r) ^ set(keys))}")
            if not keys:
                raise ValueError("a row without columns")
            kinds = {s.name: s.type for s in specs}
            if unknown := [k for k in keys if k not in kinds]:
                raise ValueError(f"no such columns: {unknown}")
            text = [[json.dumps(v) if kinds[k] == "VARIANT" and v is not None and not isinstance(v, str) else v for k, v in r.items()] for r in ({k: r[k] for k in keys} for r in rows)]
            plain = ", ".join(f"{_q(k)} {'STRING' if kinds[k] == 'VARIANT' or all(isinstance(r[i], str) or r[i] is None for r in text) else kinds[k].split('(')[0].replace('VARCHAR', 'STRING').replace('CHAR', 'STRING') if not kinds[k].startswith('DECIMAL') else kinds[k]}" for i, k in enumerate(keys))
            df = self.spark.createDataFrame([tuple(float(v) if kinds[k] == "DOUBLE" and isinstance(v, int) else v for k, v in zip(keys, r)) for r in text], plain)
        first: dict[str, int] = {}
        made, state, staged, counts = [], self._state(table_name, schema), None, None
        if isinstance(data, DataFrame):  # written once: what is checked is what is inserted, and each row has a number
            staged = f"{self._root(table_name, schema)}/staged-{uuid.uuid4().hex[:12]}"
            df.withColumn("__row", F.monotonically_increasing_id()).write.parquet(staged)
            df = self.spark.read.parquet(staged)
            counts = df.groupBy(F.shiftright("__row", 33).alias("part")).count().orderBy("part").collect()  # one for each task that wrote
            before, places = 0, []
            for r in counts:
                places.append((r["part"], before))
                before += r["count"]
            start = self.spark.createDataFrame(places, "__part long, __before long")
            df = df.join(F.broadcast(start), F.shiftright("__row", 33) == F.col("__part"))
            number = F.col("__before") + F.col("__row").bitwiseAND((1 << 33) - 1)
        else:
            df, number = df.coalesce(1), F.monotonically_increasing_id()
        for s in specs:
            if s.name in df.columns:
                c = F.parse_json(F.col(s.name).cast("string")) if s.type == "VARIANT" and dict(df.dtypes)[s.name] != "variant" else F.col(s.name).cast(s.type.replace("VARCHAR", "STRING").split("(")[0] if "CHAR" in s.type else s.type)
            elif s.serial:
                first[s.name] = state.get(s.name, 1)
                c = (number + first[s.name]).cast(s.type)
            else:
                c = F.expr(s.default).cast(s.type) if s.default else F.lit(None).cast(s.type)
            made.append(c.alias(s.name))
        new = df.select(*made)
        try:
            self._check(table_name, schema, new, specs)
            n = sum(r["count"] for r in counts) if counts is not None else len(rows)
            new.write.insertInto(name)
        finally:
            if staged:
                fs, at = self._fs(staged)
                fs.delete(at, True)
        for c, at in first.items():
            state[c] = at + n
        if first:
            self._state(table_name, schema, state)
        self._say("insert into %s: %d rows", table_name, n)
        return first.get("id") if return_id and single else None

    def _check(self, table: str, schema: str | None, new: DataFrame, specs: list[ColumnSpec], against: bool = True) -> None:
        for s in specs:
            if s.not_null and not s.serial and not new.where(F.col(s.name).isNull()).isEmpty():
                raise ValueError(f"null in column {s.name!r}")
            if s.unique and not s.serial:
                value = new.where(F.col(s.name).isNotNull()).select(s.name)
                if not value.groupBy(s.name).count().where("count > 1").isEmpty() or (against and not self.table(table, schema).join(value, s.name, "left_semi").isEmpty()):
                    raise ValueError(f"duplicate value in column {s.name!r}")

    def update(self, table_name: str, data: Mapping[str, Any], where: Mapping[str, Any], schema: str | None = None) -> int:
        """Sets columns to values where all of `where` holds; the number of rows that matched."""
        if not data or not where:
            raise ValueError("update needs data and a where")
        return self.update_expr(table_name, {k: F.lit(v) for k, v in data.items()}, relational.equalities(where), schema)

    def update_expr(self, table_name: str, changes: Mapping[str, Column | str], condition: Column | str, schema: str | None = None) -> int:
        """Sets columns to expressions over the old row where a condition holds."""
        old = self.table(table_name, schema)
        cond = F.expr(condition) if isinstance(condition, str) else condition
        if unknown := [c for c in changes if c not in old.columns]:
            raise ValueError(f"no such columns: {unknown}")
        hit = old.where(cond).count()
        if hit:
            specs = self._specs(table_name, schema)
            new = relational.updated(old, {k: F.expr(v) if isinstance(v, str) else v for k, v in changes.items()}, cond)
            self._check(table_name, schema, new, [s for s in specs if s.name in changes], against=False)
            self._swap(table_name, schema, new)
        self._say("update %s: %d rows", table_name, hit)
        return hit

    def delete(self, table_name: str, where: Mapping[str, Any], schema: str | None = None) -> int:
        """Removes rows where all of `where` holds; their number."""
        if not where:
            raise ValueError("delete needs a where")
        old, cond = self.table(table_name, schema), relational.equalities(where)
        hit = old.where(cond).count()
        if hit:
            self._swap(table_name, schema, relational.deleted(old, cond))
        self._say("delete from %s: %d rows", table_name, hit)
        return hit

    def truncate(self, table_name: str, schema: str | None = None, cascade: bool = False) -> None:
        """Removes all rows. A table that others refer to (REFERENCES) is refused; with cascade, those lose theirs too."""
        todo, done = [(schema or "public", table_name.lower())], []
        while todo:
            at = todo.pop()
            done.append(at)
            others = [x for x in self._referring(*at) if x not in done and x not in todo]
            if others and not cascade:
                raise ValueError(f"{table_name!r} is referred to by {others}")
            todo += others
        for space, name in done:
            self._swap(name, space, self.table(name, space).where("false"))
            self._say("truncate %s.%s", space, name)

    def _referring(self, schema: str, table: str) -> list[tuple[str, str]]:
        found = []
        for other in self.list_schemas():
            for t in self._tables(self._space(other)):
                names = {s.references if "." in s.references else f"{other}.{s.references}" for s in self._specs(t, other) if s.references}
                if f"{schema}.{table}" in names and (other, t) != (schema, table):
                    found.append((other, t))
        return found

    def write_csv(self, df: DataFrame, path: str, header: bool = True) -> str:
        """Writes a frame as CSV files into a folder, one for each of its partitions; nulls are empty, empty strings quoted."""
        df.write.option("header", header).option("emptyValue", '""').option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").mode("overwrite").csv(path)
        self._say("wrote CSV to %s", path)
        return path

    # Versions

    def _props(self, table: str, schema: str | None) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self._name(table, schema)}").collect()}

    def _specs(self, table: str, schema: str | None) -> list[ColumnSpec]:
        found = self._props(table, schema).get("helioframe.columns")
        if found is None:
            return [ColumnSpec(f.name, f.dataType.simpleString()) for f in self.table(table, schema).schema]
        return [ColumnSpec(**x) for x in json.loads(found)]

    def _state(self, table: str, schema: str | None, new: dict[str, int] | None = None) -> dict[str, int]:
        if new is not None:
            self.spark.sql(f"ALTER TABLE {self._name(table, schema)} SET TBLPROPERTIES ('helioframe.serial' = '{json.dumps(new)}')")
            return new
        return json.loads(self._props(table, schema).get("helioframe.serial", "{}"))

    def _root(self, table: str, schema: str | None) -> str:
        base = self.spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        return f"{base}/helioframe/{self._name(table, schema).replace('`', '').replace('.', '/')}"

    def _swap(self, table: str, schema: str | None, new: DataFrame) -> None:
        name, path = self._name(table, schema), f"{self._root(table, schema)}/v-{uuid.uuid4().hex[:12]}"
        new.write.parquet(path)
        self.spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
        self.spark.catalog.refreshTable(name)

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _location(self, table: str, schema: str | None) -> str:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self._name(table, schema)}").collect()
        return next(r["data_type"] for r in rows if r["col_name"] == "Location")

    def _bytes(self, path: str) -> int:
        fs, at = self._fs(path)
        return fs.getContentSummary(at).getLength() if fs.exists(at) else 0

    # Databases, schemas, tables

    def _spaces(self, database: str | None = None) -> list[str]:
        names = sorted(d.name for d in self.spark.catalog.listDatabases() if "__" in d.name)
        return [n for n in names if database is None or n.split("__", 1)[0] == database]

    def create_database(self, db_name: str) -> None:
        if self._spaces(db_name):
            raise ValueError(f"database {db_name!r} exists")
        self.spark.sql(f"CREATE SCHEMA {_q(self._space('public', db_name))}")

    def drop_database(self, db_name: str, force: bool = False) -> None:
        """Drops all schemas of a database; with force, also what the session has cached."""
        found = self._spaces(db_name)
        if not found:
            raise ValueError(f"no database {db_name!r}")
        if force:
            self.spark.catalog.clearCache()
        for s in found:
            self.spark.sql(f"DROP SCHEMA {_q(s)} CASCADE")
            self._forget(s)
        self._say("drop database %s", db_name)

    def _forget(self, space: str) -> None:
        """Deletes the files of a schema's tables, which lie outside the catalog's own folders."""
        fs, at = self._fs(f"{self.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/helioframe/{space}")
        fs.delete(at, True)

    def list_databases(self) -> list[dict[str, str]]:
        sizes: dict[str, int] = {}
        for s in self._spaces():
            db, schema = s.split("__", 1)
            sizes[db] = sizes.get(db, 0) + sum(self._bytes(self._location(t, schema)) for t in self._tables(s)) if db == self.database else sizes.get(db, 0) + self._bytes(f"{self.spark.conf.get('spark.sql.warehouse.dir')}/helioframe/{s}")
        return [{"name": k, "size": pretty_size(v)} for k, v in sorted(sizes.items())]

    def create_schema(self, schema_name: str) -> None:
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {_q(self._space(schema_name))}")

    def drop_schema(self, schema_name: str, cascade: bool = False) -> None:
        self.spark.sql(f"DROP SCHEMA {_q(self._space(schema_name))} {'CASCADE' if cascade else ''}")
        self._forget(self._space(schema_name))
        self._say("drop schema %s", schema_name)

    def list_schemas(self) -> list[str]:
        return [s.split("__", 1)[1] for s in self._spaces(self.database)]

    def create_table(self, table_name: str, columns: Mapping[str, str], schema: str | None = None) -> None:
        """A table of columns and their definitions, types with constraints; nothing happens if it exists."""
        if self.table_exists(table_name, schema):
            return
        specs = [column_spec(k.lower(), v) for k, v in columns.items()]
        defs = ", ".join(f"{_q(s.name)} {s.type}" + (f" DEFAULT {s.default}" if s.default else "") for s in specs)
        kept = json.dumps([s.__dict__ for s in specs]).replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {self._name(table_name, schema)} ({defs}) USING parquet LOCATION '{self._root(table_name, schema)}/v-{uuid.uuid4().hex[:12]}' TBLPROPERTIES ('helioframe.columns' = '{kept}')")

    def drop_table(self, table_name: str, schema: str | None = None, cascade: bool = False) -> None:
        """Drops a table and its versions; with cascade, also views of its schema that read it."""
        name = self._name(table_name, schema)
        if not self.table_exists(table_name, schema):
            return
        if cascade:
            at = name.replace("`", "")
            for space in self._spaces(self.database):
                for v in self.spark.sql(f"SHOW VIEWS IN {_q(space)}").collect():
                    if not v["isTemporary"] and at in self._read_by(f"{_q(space)}.{_q(v['viewName'])}"):
                        self.spark.sql(f"DROP VIEW IF EXISTS {_q(space)}.{_q(v['viewName'])}")
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        fs, at = self._fs(self._root(table_name, schema))
        fs.delete(at, True)
        self._say("drop table %s", table_name)

    def _read_by(self, view: str) -> set[str]:
        """The tables and views that a view reads, also in subqueries, as its resolved plan names them."""
        plan = self.spark.table(view)._jdf.queryExecution().analyzed().toString()
        return set(re.findall(r"SubqueryAlias spark_catalog\.(\S+)\s*$", plan, re.M))

    def _tables(self, space: str) -> list[str]:
        views = {r["viewName"] for r in self.spark.sql(f"SHOW VIEWS IN {_q(space)}").collect()}
        return sorted(r["tableName"] for r in self.spark.sql(f"SHOW TABLES IN {_q(space)}").collect() if r["tableName"] not in views)

    def list_tables(self, schema: str = "public", names_only: bool = False) -> list:
        names = self._tables(self._space(schema)) if self._space(schema) in self._spaces(self.database) else []
        return names if names_only else [{"name": n, "size": pretty_size(self._bytes(self._location(n, schema)))} for n in names]

    def describe_table(self, table_name: str, schema: str = "public") -> list[dict[str, Any]]:
        """Name, type, greatest length, nullability and default of each column, in order; nothing for an unknown table."""
        if not self.table_exists(table_name, schema):
            return []
        out = []
        for s in self._specs(table_name, schema):
            size = s.type.partition("(")[2].rstrip(")") if "CHAR" in s.type else ""
            out.append({"column_name": s.name, "data_type": s.type.lower(), "max_length": int(size) if size else None, "is_nullable": "NO" if s.not_null else "YES", "default_value": s.default})
        return out

    def table_exists(self, table_name: str, schema: str | None = "public") -> bool:
        return self.spark.catalog.tableExists(self._name(table_name, schema))

    def vacuum(self, table_name: str | None = None, full: bool = False, analyze: bool = True, schema: str | None = None) -> None:
        """Removes old versions (with full, after writing the rows anew in few files) and gathers statistics."""
        for t in [table_name] if table_name else self.list_tables(schema or "public", names_only=True):
            if full:
                self._swap(t, schema, self.table(t, schema).coalesce(max(1, self._bytes(self._location(t, schema)) >> 27)))
            live = self._location(t, schema).rsplit("/", 1)[-1]
            fs, at = self._fs(self._root(t, schema))
            for f in fs.listStatus(at) if fs.exists(at) else []:
                if f.getPath().getName() != live:
                    fs.delete(f.getPath(), True)
            if analyze:
                self.spark.sql(f"ANALYZE TABLE {self._name(t, schema)} COMPUTE STATISTICS")
