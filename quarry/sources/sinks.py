"""Results as text for callers: bounded, since they leave the cluster."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

MOST = 1000


def json_rows(df: DataFrame, most: int = MOST) -> list[str]:
    """Up to `most` rows as JSON objects; nulls are left out, as by Spark."""
    return [r.value for r in df.limit(most).selectExpr("to_json(struct(*)) AS value").collect()]


def json_document(df: DataFrame, most: int = MOST) -> str:
    return "[" + ",".join(json_rows(df, most)) + "]"


def write_json(df: DataFrame, path: str) -> None:
    """Any number of rows, written by the executors."""
    df.write.mode("overwrite").json(path)


def events(parts: Iterable[str], done: str = "[DONE]") -> Iterator[str]:
    """Server-sent events: a data line for each line of each part, and an end mark."""
    for part in parts:
        yield "".join(f"data: {line}\n" for line in part.split("\n")) + "\n"
    yield f"data: {done}\n\n"


def table_text(df: DataFrame, most: int = MOST) -> str:
    """Up to `most` rows in aligned columns under upper-case names; nulls are empty."""
    rows = [[c.upper() for c in df.columns], *[["" if v is None else str(v) for v in r] for r in df.limit(most).collect()]]
    widths = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in rows) + "\n"
