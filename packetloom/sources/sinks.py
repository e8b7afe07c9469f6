"""Writers: training sets, report tables and one plain page over them."""

from __future__ import annotations

import html
from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F, types as T

# Rows of a table that may reach the page; the table itself is written whole.
PAGE_ROWS = 1_000


def iso_times(df: DataFrame) -> DataFrame:
    """Timestamps as ISO 8601 text with microseconds and offset, as exports want them; other columns stay."""
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx") for c in times})


def write_training_set(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = (iso_times(df) if fmt == "csv" else df).write.mode("overwrite").format(fmt)
    (writer.option("header", "true") if fmt == "csv" else writer).save(path)


def write_report(tables: Mapping[str, DataFrame], path: str) -> None:
    """Each report table as parquet below ``path``."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def report_page(tables: Mapping[str, DataFrame], title: str = "Traffic report") -> str:
    """A plain HTML page. Of a table with more than PAGE_ROWS rows it shows that many and says of how many."""
    parts = [f"<html><head><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, table in tables.items():
        rows = table.limit(PAGE_ROWS + 1).collect()
        note = f"<p>The first {PAGE_ROWS} of {table.count()} rows.</p>" if len(rows) > PAGE_ROWS else ""
        rows = rows[:PAGE_ROWS]
        parts.append(f"<h2>{html.escape(name.replace('_', ' '))}</h2>")
        if not rows:
            parts.append("<p>Nothing to report.</p>")
            continue
        cells = lambda values, tag: "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values)
        body = "".join(f"<tr>{cells(r, 'td')}</tr>" for r in rows)
        parts.append(f"{note}<table><tr>{cells(table.columns, 'th')}</tr>{body}</table>")
    return "".join(parts) + "</body></html>"
