"""Result tables as parquet and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame

from paneltide.session import counted

#: Up to this many rows a CSV table is one file; a longer one stays in its partitions' files.
ONE_FILE_ROWS = 1_000_000


def save_tables(tables: dict[str, DataFrame], root: str, csv: tuple[str, ...] = ()) -> list[str]:
    """Write each table under its name; those in ``csv`` as CSV with a header.

    CSV is for summaries of a few rows; everything else stays parquet.
    """
    paths = []
    for name, table in tables.items():
        path = f"{root.rstrip('/')}/{name}"
        if name in csv:
            kept, rows = counted(table, name)
            kept = kept.coalesce(1) if rows <= ONE_FILE_ROWS else kept
            kept.write.mode("overwrite").csv(path, header=True)
        else:
            table.write.mode("overwrite").parquet(path)
        paths.append(path)
    return paths
