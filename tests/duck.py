"""The oracle's side: DuckDB over the same tables."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(sql: str, sf: str) -> tuple[list[str], list[tuple]]:
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    q = c.execute(sql)
    names = [d[0] for d in q.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(map(repr, [plain([r[i] for i in order]) for r in q.fetchall()]))


def plain(values) -> tuple:
    return tuple(round(v, 8) + 0.0 if isinstance(v, float) else v for v in values)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(map(repr, [plain([r[n] for n in names]) for r in df.collect()]))
