"""What is admitted: features with their state and the Spark primitive behind them."""

from __future__ import annotations

CAPABILITIES: dict[str, dict[str, str]] = {
    "sources": {
        "csv": "runs", "json": "runs", "jsonl": "runs", "parquet": "runs", "orc": "runs", "arrow_ipc": "runs", "avro": "blocked: needs spark-avro",
        "parts": "runs", "partitioned": "runs", "sqlite": "runs, bounded rows", "delta_log": "runs over JSON logs", "iceberg": "runs over JSON manifests",
        "hudi_timeline": "lists instants", "rows": "runs", "range": "runs", "calendar": "runs", "series": "runs", "http": "blocked", "jdbc": "blocked",
    },
    "sinks": {"csv": "runs", "jsonl": "runs", "parquet": "runs", "orc": "runs, flat types", "arrow_ipc": "runs", "avro": "blocked", "native": "runs, verified", "fanout": "runs, staged"},
    "joins": {"inner": "runs", "left": "runs", "right": "runs", "full": "runs", "semi": "runs", "anti": "runs", "cross": "runs", "condition": "runs", "nested_keys": "blocked"},
    "subqueries": {"in": "runs", "not_in": "runs, null aware", "row_in": "runs", "exists": "runs", "quantified": "runs, rewritten", "correlated": "runs", "nested": "runs", "having": "runs"},
    "aggregates": {"count": "runs", "sum": "runs", "avg": "runs", "min": "runs", "max": "runs", "count_distinct": "runs", "approx_count_distinct": "runs", "grouping_sets": "blocked"},
    "windows": {"row_number": "runs", "rank": "runs", "dense_rank": "runs", "lag": "runs", "lead": "runs", "ntile": "runs", "percent_rank": "runs", "cume_dist": "runs", "rolling": "runs", "frames": "blocked in SQL"},
    "sets": {"union": "runs", "union_all": "runs", "intersect": "runs", "except": "runs"},
    "reshape": {"melt": "runs", "explode": "runs", "pivot": "runs", "pivot_table": "runs", "margins": "runs"},
    "streams": {"state": "runs", "late": "runs", "replay": "runs", "hybrid": "runs", "structured_streaming": "runs"},
    "functions": {"python_udf": "blocked", "ilike": "blocked", "collate": "blocked", "json": "blocked in SQL", "accessors": "blocked in SQL"},
}
