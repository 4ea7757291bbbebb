"""Result envelopes: rows with what is known about how they came to be."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Result:
    """Rows, their schema and digests of plan and values."""

    rows: list[dict]
    schema: dict[str, str]
    evidence: dict[str, object] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self):
        return iter(self.rows)

    @classmethod
    def of(cls, df: DataFrame, source: str | None = None) -> Result:
        began = time.monotonic()
        rows = [r.asDict(recursive=True) for r in df.collect()]
        plan = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
        values = json.dumps(rows, default=str, sort_keys=True)
        return cls(
            rows,
            dict(df.dtypes),
            {
                "source": source,
                "row_count": len(rows),
                "plan_digest": hashlib.sha256(plan.encode()).hexdigest()[:16],
                "value_digest": hashlib.sha256(values.encode()).hexdigest()[:16],
                "seconds": round(time.monotonic() - began, 6),
                "engine": "spark",
                "fallback": False,
            },
        )
