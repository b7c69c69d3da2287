"""A data source for SQLite tables of (id, data): read split by row id, or by the ids asked for; written by insert-or-replace."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

#: Ids of one statement; seconds that a writer waits for others.
BATCH, WAIT = 500, 600


class _Part(InputPartition):
    def __init__(self, low: int, high: int, ids: list[str] | None = None):
        self.low, self.high, self.ids = low, high, ids


def _table(options: dict) -> str:
    table = options.get("table", "entities")
    if not table.isidentifier():
        raise ValueError(f"not a table name: {table!r}")
    return table


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.parts, self.ids = options["path"], _table(options), int(options.get("partitions", 8)), None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Conditions on iri become lookups by the table's key; Spark checks them again."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("iri",):
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.ids = values if self.ids is None else [x for x in self.ids if x in set(values)]
            yield f

    def partitions(self):
        import sqlite3

        if self.ids is not None:
            return [_Part(0, -1, self.ids[k : k + BATCH]) for k in range(0, len(self.ids), BATCH)] or [_Part(0, -1)]
        with sqlite3.connect(self.path) as con:
            low, high = con.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {self.table}").fetchone()  # noqa: S608
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Part(a, min(a + step - 1, high)) for a in range(low, high + 1, step)] or [_Part(0, -1)]

    def read(self, partition):
        import sqlite3

        with sqlite3.connect(self.path) as con:
            if partition.ids is not None:
                marks = ",".join("?" * len(partition.ids))
                yield from con.execute(f"SELECT id, json(data) FROM {self.table} WHERE id IN ({marks})", partition.ids)  # noqa: S608
            else:
                yield from con.execute(f"SELECT id, json(data) FROM {self.table} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))  # noqa: S608


class _Writer(DataSourceWriter):
    """Replacing by id, a task that runs again writes the same rows."""

    def __init__(self, options: dict):
        import sqlite3

        self.path, self.table = options["path"], _table(options)
        with sqlite3.connect(self.path, timeout=WAIT) as con:
            con.execute(f"CREATE TABLE IF NOT EXISTS {self.table} (id TEXT PRIMARY KEY, data TEXT)")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import sqlite3
        from itertools import batched

        for some in batched(rows, BATCH):
            with sqlite3.connect(self.path, timeout=WAIT) as con:
                con.executemany(f"INSERT OR REPLACE INTO {self.table} (id, data) VALUES (?, ?)", [(r.iri, r.doc) for r in some])  # noqa: S608
        return WriterCommitMessage()


class SqliteSource(DataSource):
    @classmethod
    def name(cls):
        return "lodestar-sqlite"

    def schema(self):
        return "iri string, doc string"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)
