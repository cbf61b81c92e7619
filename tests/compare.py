"""Side-by-side comparison of queries with their SQL in DuckDB."""

import math
import os


def connect(d):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(d):
        p = f"{d}/{t}" if os.path.isfile(f"{d}/{t}") else f"{d}/{t}/*.parquet"
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{p}'")
    return con


def canonical(df):
    def v(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, bool):
            return x
        if isinstance(x, (int, float)):
            return round(float(x), 6)
        return None if str(x) in ("NaT", "<NA>") else str(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(v(x) for x in r) for r in df.itertuples(index=False)), key=repr)
