"""Plain-Python readings of small results."""


def pairs(df):
    return sorted((r["row_id"], r["col_id"]) for r in df.collect())


def cells(df):
    return {(r["row_id"], r["col_id"]): r["val"] for r in df.collect()}


def values(df):
    return {r["idx"]: r["val"] for r in df.collect()}


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
