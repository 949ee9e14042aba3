"""Folders of test tables without rows, and of tables whose rows hold nulls, empty and very long texts, repeats and extra columns."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from tests.oracle import DATA


def empty(folder: Path) -> str:
    for p in Path(DATA).glob("*.parquet"):
        pq.write_table(pq.read_schema(p).empty_table(), folder / p.name)
    return str(folder)


def odd(folder: Path) -> str:
    """The first rows of each table twice, rows of nulls, rows with empty and with very long texts; and columns that clash with names used inside."""
    for p in Path(DATA).glob("*.parquet"):
        table = pq.read_table(p)
        few = table.slice(0, 40)
        nulls = pa.table({f.name: pa.nulls(3, f.type) for f in table.schema}, schema=table.schema)
        parts = [few, few, nulls]
        for text in ("", " \t\n", "word " * 20_000 + "."):
            changed = table.slice(0, 2)
            for i, f in enumerate(table.schema):
                if f.type == pa.string() and not f.name.endswith(("_id", "login", "role")):
                    changed = changed.set_column(i, f, pa.array([text] * changed.num_rows, pa.string()))
            parts.append(changed)
        whole = pa.concat_tables([t.cast(table.schema) for t in parts])
        for extra in ("_n", "_k", "n", "h", "ts", "place", "change", "spans", "steps"):
            if extra not in whole.column_names:
                whole = whole.append_column(extra, pa.array([f"x{i}" for i in range(whole.num_rows)]))
        pq.write_table(whole, folder / p.name)
    return str(folder)
