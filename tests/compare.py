"""Compare a DataFrame with an oracle's rows, whatever their order."""

import datetime

import numpy as np


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9))
    if isinstance(v, (list, tuple, np.ndarray)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    return None if v is None else str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(str([plain(r[c]) for c in cols]) for r in df.select(*cols).collect())


def oracle_rows(con, sql):
    rel = con.sql(sql)
    cols = rel.columns
    at = [cols.index(c) for c in sorted(cols)]
    return sorted(cols), sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())
