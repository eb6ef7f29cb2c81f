"""A PEP 249 interface: connect(), cursors, qmark parameters. Rows are fetched in pieces, never all at once unless asked."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import SparkSession

from pathloom.lang.errors import GraphError
from pathloom.session import Session

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"
Error = DatabaseError = ProgrammingError = GraphError


class Cursor:
    arraysize = 1

    def __init__(self, connection: Connection):
        self.connection, self.description, self.rowcount = connection, None, -1
        self._rows: Iterator = iter(())

    def execute(self, operation: str, parameters: Sequence[Any] = ()) -> Cursor:
        df = self.connection.session.execute(operation, list(parameters))
        rows = operation.lstrip().split(None, 1)[:1]
        if rows and rows[0].upper() in ("SELECT", "SHOW", "EXPLAIN", "PATH"):
            self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in df.schema]
            self._rows = (tuple(r) for r in df.toLocalIterator())
        else:
            self.description, self._rows = None, iter(())
        return self

    def executemany(self, operation: str, seq: Sequence[Sequence[Any]]) -> None:
        for p in seq:
            self.execute(operation, p)

    def fetchone(self) -> tuple | None:
        return next(self._rows, None)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        return [r for _, r in zip(range(size or self.arraysize), self._rows)]

    def fetchall(self) -> list[tuple]:
        return list(self._rows)

    def __iter__(self) -> Iterator[tuple]:
        return self._rows

    def setinputsizes(self, sizes: Any) -> None:
        pass

    def setoutputsize(self, size: int, column: int | None = None) -> None:
        pass

    def close(self) -> None:
        self._rows = iter(())


class Connection:
    def __init__(self, session: Session):
        self.session = session

    def cursor(self) -> Cursor:
        return Cursor(self)

    def commit(self) -> None:
        if self.session.staged is not None:
            self.session.execute("COMMIT")

    def rollback(self) -> None:
        if self.session.staged is not None:
            self.session.execute("ROLLBACK")

    def close(self) -> None:
        self.rollback()


def connect(directory: str, spark: SparkSession | None = None) -> Connection:
    """A connection to the graphs stored in a folder."""
    return Connection(Session(spark or SparkSession.builder.getOrCreate(), directory))
