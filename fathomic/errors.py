"""Coded diagnostics: what is outside the admitted scope fails before any data is read."""

from __future__ import annotations

#: Codes and what each says.
CODES = {
    "FX-SOURCE-FORMAT": "the format of a source or sink is not admitted",
    "FX-SOURCE-REMOTE": "remote stores, HTTP and JDBC are not admitted",
    "FX-SOURCE-DUPLICATE": "a part is listed twice",
    "FX-SOURCE-SCHEMA": "parts or tables disagree in schema",
    "FX-SINK-EXISTS": "the target exists and overwriting was not asked for",
    "FX-SINK-TYPE": "the sink cannot hold a column's type",
    "FX-SQL-FEATURE": "the statement uses a form that is not admitted",
    "FX-SQL-BINDING": "a name in the statement is bound to nothing",
    "FX-TYPE": "operand types do not go together",
    "FX-COLUMN": "a column does not exist",
    "FX-ARGUMENT": "an argument is out of range",
    "FX-UNBOUNDED": "rows were asked for without a limit",
    "FX-CONFLICT": "two rows claim one cell or one key",
    "FX-UDF": "Python functions are not admitted by default",
    "FX-COMMIT": "a commit met a newer version",
}


class Blocked(ValueError):
    """A request outside the scope, with a code from ``CODES``."""

    def __init__(self, code: str, message: str) -> None:
        assert code in CODES, code
        super().__init__(f"{code}: {message}")
        self.code = code
        self.message = message
