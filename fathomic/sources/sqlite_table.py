"""One table of a local SQLite file, in and out."""

from __future__ import annotations

import re
import sqlite3

from pyspark.sql import DataFrame, SparkSession

from fathomic.errors import Blocked
from fathomic.sources.files import local_path

#: Rows of an export that go to the file at once.
_STEP = 10_000
#: SQLite files are read by the driver, so only small ones are admitted.
MAX_ROWS = 1_000_000


def _name(table: str) -> str:
    if not re.fullmatch(r"[A-Za-z_]\w*", table):
        raise Blocked("FX-ARGUMENT", f"{table} is no table name")
    return table


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    with sqlite3.connect(f"file:{local_path(path)}?mode=ro", uri=True) as db:
        info = db.execute(f"PRAGMA table_info({_name(table)})").fetchall()
        if not info:
            raise Blocked("FX-SQL-BINDING", f"{path} has no table {table}")
        if db.execute(f"SELECT count(*) FROM {table}").fetchone()[0] > MAX_ROWS:
            raise Blocked("FX-UNBOUNDED", f"{table} has over {MAX_ROWS} rows")
        fields = []
        for _, name, declared, *_ in info:
            kind = (declared or "").upper()
            t = "bigint" if "INT" in kind else "double" if any(x in kind for x in ("REAL", "FLOA", "DOUB")) else "binary" if "BLOB" in kind else "string"
            fields.append(f"`{name}` {t}")
        casts = {"bigint": int, "double": float, "binary": bytes, "string": str}
        kinds = [casts[f.rsplit(" ", 1)[1]] for f in fields]
        rows = [tuple(None if v is None else k(v) for k, v in zip(kinds, r, strict=True)) for r in db.execute(f"SELECT * FROM {table}")]
    return spark.createDataFrame(rows, ", ".join(fields))


def write(df: DataFrame, path: str, table: str, overwrite: bool = False) -> int:
    """Stream rows into a table; the number of rows written."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "string": "TEXT", "binary": "BLOB"}
    bad = [c for c, t in df.dtypes if t not in kinds]
    if bad:
        raise Blocked("FX-SINK-TYPE", f"SQLite has no type for {', '.join(bad)}")
    with sqlite3.connect(local_path(path)) as db:
        there = db.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (_name(table),)).fetchone()
        if there and not overwrite:
            raise Blocked("FX-SINK-EXISTS", f"{table} is in {path} already")
        db.execute(f"DROP TABLE IF EXISTS {table}")
        db.execute(f"CREATE TABLE {table} ({', '.join(f'"{c}" {kinds[t]}' for c, t in df.dtypes)})")
        put = f"INSERT INTO {table} VALUES ({', '.join('?' * len(df.columns))})"
        count, held = 0, []
        for r in df.toLocalIterator():
            held.append(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r))
            if len(held) == _STEP:
                db.executemany(put, held)
                count, held = count + len(held), []
        db.executemany(put, held)
        return count + len(held)
