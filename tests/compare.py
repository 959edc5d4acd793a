"""Run registered queries next to their SQL: python tests/compare.py [folder] [name,name...]"""

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from panelspark.plans.catalog import QUERIES
from panelspark.plans.oracles import ORACLES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if pd.api.types.is_datetime64_any_dtype(frame[c]):
            frame[c] = frame[c].astype("datetime64[ns]")
        elif frame[c].dtype == object:
            sample = frame[c].dropna()
            if len(sample) and hasattr(sample.iloc[0], "year"):
                frame[c] = pd.to_datetime(frame[c]).astype("datetime64[ns]")
    keys = [c for c in frame.columns if not pd.api.types.is_float_dtype(frame[c])]
    rest = [c for c in frame.columns if c not in keys]
    return frame.sort_values(keys + rest, kind="stable").reset_index(drop=True)


def differences(ours, theirs):
    """Reasons why two results differ; an empty list when they are equal."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return [f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"]
    if len(ours) != len(theirs):
        return [f"rows {len(ours)} / {len(theirs)}"]
    a, b, out = plain(ours), plain(theirs), []
    for c in a.columns:
        x, y = a[c], b[c]
        if pd.api.types.is_bool_dtype(x) != pd.api.types.is_bool_dtype(y):
            out.append(f"{c}: {x.dtype} / {y.dtype}")
            continue
        if pd.api.types.is_numeric_dtype(x) and pd.api.types.is_numeric_dtype(y):
            if pd.api.types.is_float_dtype(x) != pd.api.types.is_float_dtype(y) and not (x.isna().any() or y.isna().any()):
                out.append(f"{c}: {x.dtype} / {y.dtype}")
            p, q = x.to_numpy(dtype=float, na_value=np.nan), y.to_numpy(dtype=float, na_value=np.nan)
            same = (p == q) | (np.isnan(p) & np.isnan(q))
        else:
            same = ((x == y) | (x.isna() & y.isna())).to_numpy(dtype=bool)
        if not same.all():
            i = int(np.argmin(same))
            out.append(f"{c}: {int((~same).sum())} of {len(same)} differ, first {x[i]!r} / {y[i]!r}")
    return out


def check(spark, con, sf_dir, name):
    t = time.time()
    ours = QUERIES[name](spark, sf_dir).toPandas()
    t1 = time.time()
    if name not in ORACLES:
        return ours, None, round(t1 - t, 1), 0.0
    theirs = con.execute(ORACLES[name]).df()
    return ours, differences(ours, theirs), round(t1 - t, 1), round(time.time() - t1, 1)


if __name__ == "__main__":
    from panelspark.storage import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2].split(",") if len(sys.argv) > 2 else list(QUERIES)
    session, con = local_session(8), connect(folder)
    for name in names:
        try:
            ours, bad, spark_s, sql_s = check(session, con, folder, name)
            print("@@", name, len(ours), "no SQL" if bad is None else bad or "same", spark_s, sql_s, flush=True)
        except Exception as e:
            print("@@ FAIL", name, str(e)[:600].replace("\n", " "), flush=True)
