"""Rows of a query and of its SQL twin, in any order, with numbers to six digits."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if v is None or str(v) in ("<NA>", "nan", "NaT", "None"):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        return round(float(v), 6) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(map(plain, r)) for r in pdf.itertuples(index=False)), key=str)
