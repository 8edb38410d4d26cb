"""Small builders shared by the tests."""

from pyspark.sql import functions as F

from factloom.operators import catalog

DECL = "repo string, path string, line int, name string, kind string, fields array<string>, relations array<string>, table_name string"
HIT = "repo string, name string, path string, kind string"


def decls(spark, *rows):
    """Rows (name, kind[, table[, path[, fields[, relations]]]])."""
    out = []
    for i, r in enumerate(rows):
        name, kind, table, path, fields, rel = (list(r) + [None] * 6)[:6]
        out.append(("r", path or f"src/f{i}", 1, name, kind, fields or [], rel or [], table))
    return spark.createDataFrame(out, DECL)


def hits(spark, *rows):
    return spark.createDataFrame([("r", n, p, k) for n, p, k in rows], HIT)


def concepts(spark, d, h=None):
    return catalog.build_catalog(d, h if h is not None else hits(spark))


def terms(spark, *words):
    return spark.createDataFrame([("r", w) for w in words], "repo string, term string")


def files(spark, **texts):
    return spark.createDataFrame([("r", k, v) for k, v in texts.items()], "repo string, path string, content string")


def source(spark, rows):
    return spark.createDataFrame([("r", p, c) for p, c in rows], "repo string, path string, content string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*[F.col(c) for c in cols]).collect())
