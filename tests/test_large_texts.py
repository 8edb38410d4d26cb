"""Whole texts of any shape: very long literals, many escapes, manifests without names."""

from pyspark.sql import functions as F

from factloom.extract import facts
from factloom.functions.text import sql_fingerprint
from helpers import pairs, source


def test_long_literals_do_not_overflow(spark):
    long = "x" * 200_000
    escaped = '\\"' * 50_000
    f = source(spark, [("a.py", f'def go(a):\n    return "{long}" + "{escaped}"\n'), ("b.ts", f'const s = "{escaped}"; useThing(s)\n')])
    got = facts.extract_body_literals(f).select(F.length("literal").alias("n"))
    assert sorted(r.n for r in got.collect()) == [100_000, 200_000]
    assert ("useThing",) in pairs(facts.used_identifiers(f), "ident")
    q = spark.createDataFrame([("select '" + "y" * 100_000 + "\\'" * 1000 + "' from t1",)], "q string")
    assert q.select(sql_fingerprint(F.col("q"))).first()[0] == "select ? from t?"


def test_long_manifests_do_not_overflow(spark):
    filler = "  data: x\n" * 60_000
    f = source(spark, [("k.yaml", "kind: Config\n" + filler + "---\nkind: Service\nmetadata:\n  name: web\n"), ("o.yaml", "paths:\n  /a:\n" + "      x: 1\n" * 60_000 + "    get:\n    post:\n")])
    assert pairs(facts.extract_symbols(f), "path", "name", "line") == [("k.yaml", "web", 60_003)]
    assert pairs(facts.extract_routes(f), "method", "route") == [("GET", "/a"), ("POST", "/a")]


def test_long_handlers_and_bodies_do_not_overflow(spark):
    """Bodies of a megabyte, with many brackets beside each other and some inside each other."""
    body = "  call(a, [b, { c: 'd)' }]); // it's (\n" * 30_000
    f = source(spark, [("a.ts", "app.get('/x', auth, async (req, res) => {\n" + body + "});\nfunction go() {\n" + body + "}\n"), ("m.prisma", "model A {\n" + '  f Json @default("{}")\n' * 30_000 + "}\n")])
    assert pairs(facts.extract_routes(f), "method", "route", "handler") == [("GET", "/x", "get")]
    assert facts.function_units(f).where("unit = 'go'").select(F.length("body").alias("n")).first().n > len(body)
    assert facts.extract_declarations(f).select(F.size("fields").alias("n")).first().n == 30_000
