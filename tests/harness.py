"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return str(v)


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty text when both sides agree on some rows, else what is wrong."""
    df = query(spark, sf_dir)
    left_cols = sorted(df.columns)
    left = Counter(tuple(cell(r[c]) for c in left_cols) for r in df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != left_cols:
        return f"columns {left_cols} against {sorted(names)}"
    at = [names.index(c) for c in left_cols]
    right = Counter(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
    if left == right:
        return "" if left else "no rows on either side"
    more, less = list((left - right).items())[:2], list((right - left).items())[:2]
    return f"{sum(left.values())} rows against {sum(right.values())}; only Spark {more!r:.1500}; only SQL {less!r:.1500}"


def session(cpus: int = 8):
    from tomeline.session import local_session

    return local_session(cpus)


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/{argv[0]}"
    wanted = argv[1:]
    spark, con, bad = session(), connect(sf_dir), []
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                said = compare(spark, con, sf_dir, query, sqls[name])
            else:
                n = query(spark, sf_dir).count()
                said = "" if n else "no rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:1800]}"
        flag = "ok " if not said else "BAD"
        print(f"{flag} {name} {time.time() - start:.1f}s {'' if name in sqls else '(rows only)'} {said}", flush=True)
        if said:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    raise SystemExit(main(sys.argv[1:]))
