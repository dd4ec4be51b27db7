"""Run registered queries next to their check texts and compare the results.

python tests/oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from seqtally.plans.views import BASE  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in BASE:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def canon(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0 if v != 0 else 0.0
    if hasattr(v, "as_tuple"):  # decimal
        return float(v)
    return v


def rows_of(records, columns, order):
    idx = [columns.index(c) for c in order]
    out = [tuple(canon(r[i]) for i in idx) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x).__name__ == "str"), x if x is not None else 0) for x in r))


def close(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b


def compare(spark_df, con, sql: str) -> tuple[str, str]:
    cols = spark_df.columns
    got = [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(cols) != sorted(want_cols):
        return "COLUMNS", f"{sorted(cols)} vs {sorted(want_cols)}"
    if len(got) != len(want):
        return "ROWS", f"{len(got)} vs {len(want)}"
    order = sorted(cols)
    a, b = rows_of(got, cols, order), rows_of(want, want_cols, order)
    if a == b:
        kinds = []
        for i, c in enumerate(order):
            x = {type(r[i]).__name__ for r in a if r[i] is not None}
            y = {type(r[i]).__name__ for r in b if r[i] is not None}
            if x != y:
                kinds.append(f"{c}:{x}/{y}")
        return ("OK" if not kinds else "TYPES"), f"{len(a)} rows {kinds or ''}"
    first = next((c, p, q) for x, y in zip(a, b) for c, p, q in zip(order, x, y) if p != q)
    for x, y in zip(a, b):
        if not all(close(p, q) for p, q in zip(x, y)):
            return "VALUES", f"{order}\n   {x}\n   {y}"
    return "APPROX", f"{len(a)} rows {first}"


def main(argv):
    from seqtally.plans.registry import check_texts, spark_queries
    from seqtally.session import build_session

    folder = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        folder, argv = argv[1], argv[2:]
    spark = build_session(
        "oracle", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    texts = check_texts()
    bad = 0
    for name, fn in spark_queries().items():
        if argv and not any(a in name for a in argv):
            continue
        t0 = time.time()
        try:
            if name in texts:
                verdict, detail = compare(fn(spark, folder), con, texts[name])
            else:
                verdict, detail = "RAN", f"{fn(spark, folder).count()} rows"
        except Exception as e:
            verdict, detail = "ERROR", str(e).split("JVM stacktrace")[0][:700]
        bad += verdict not in ("OK", "RAN")
        print(f"{verdict:8s} {name:34s} {time.time() - t0:6.1f}s  {detail}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
