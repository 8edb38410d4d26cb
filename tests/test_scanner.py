"""Calls, decorators and bodies with brackets, strings and comments inside, and the time that many matches take."""

import time

from pyspark.sql import functions as F

from factloom.extract import facts
from factloom.extract.brackets import balanced, items, records
from helpers import pairs, source


def found(spark, *texts):
    return pairs(facts.extract_routes(source(spark, list(texts))), "method", "route", "handler")


def test_balanced_text_ends_at_the_bracket_that_was_not_opened(spark):
    texts = ["a, b) rest", "f(g([1, {x: ')'}]), \")\") ) rest", "`}${x}` } // )\n) rest", "/[)(]/, 'it\\'s' ) rest", "don't ) rest", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in df.select("i", F.regexp_extract("t", f"^{balanced('js')}", 0)).orderBy("i").collect()]
    assert got == ["a, b", "f(g([1, {x: ')'}]), \")\") ", "`}${x}` ", "/[)(]/, 'it\\'s' ", "don't ", ""]
    deep = "(" * 12 + "x" + ")" * 12 + ") rest"
    assert spark.createDataFrame([(deep,)], "t string").select(F.regexp_extract("t", f"^{balanced('py')}", 0)).first()[0] == deep[:-6]


def test_items_are_cut_at_their_own_commas(spark):
    text = "'a,b', [1, 2], f(x, (y)),\n  // one, two\n  { k: 'v, w' }, /* , */ last,\n"
    got = spark.createDataFrame([(text,)], "t string").select(items(F.col("t"), "js")).first()[0]
    assert got == ["'a,b'", "[1, 2]", "f(x, (y))", "{ k: 'v, w' }", "last"]
    assert spark.createDataFrame([("a=1 b=2",)], "t string").select(records(F.col("t"), r"(\w)=(\d)", 2)).first()[0] == [["a", "1"], ["b", "2"]]


def test_express_shapes(spark):
    got = found(
        spark,
        ("a.ts", "app.get('/x', (req, res) => {\n  res.send(`}${req.id})`);\n});\nrouter.get('/m', auth, async function named(req, res) {});\nusersRouter.get('u', list)\n"),
        ("b.js", "const P = '/p';\nserver.put(P + `/${ID}/y`, wrap(ctrl.save))\napp.route('/r').get(a)\napp.use('/no', x)\nthings.all('*', fallback)\nfetchClient.get('/out', opts)\nlist.get(1, x)\nm.get('/d', { a: 1 })\n"),
        ("c.ts", "app.post<Body>('/typed', async ({ a }: Body) => a)\nregister((app) => {\n  app.head('/in', deep)\n})\napp.delete(UNKNOWN + '/x', h)\napp.options('/broken', h\n"),
    )
    assert got == [
        ("ALL", "*", "fallback"), ("GET", "/m", "named"), ("GET", "/x", "get"), ("GET", "u", "list"), ("HEAD", "/in", "deep"), ("POST", "/typed", "post"), ("PUT", "/p/${ID}/y", "save"),
    ]


def test_python_and_nest_decorators(spark):
    got = found(
        spark,
        ("a.py", "V = '/v'\n@app.get(\n    f'/a/{x}',\n    tags=['(', \"'\"],  # )\n)\n@cached(ttl=f(1))\n\nasync def one(): ...\n@r.api_route(path=V + '/b', methods={'PUT', 'patch'})\ndef two(): ...\nclass C:\n    @r.post('')\n    def three(self): ...\n@r.get(V)\nx = 1\n"),
        ("b.ts", "class A {\n  @Get()\n  @Roles('a)', [(1)])\n  private static async root() {}\n  @All(['x', BASE + '/y'])\n  both() {}\n  @Post('z') one<T>() {}\n}\nconst BASE = '/b'\n"),
    )
    assert got == [
        ("ANY", "/b/y", "both"), ("ANY", "x", "both"), ("GET", "/", "root"), ("GET", "/a/{x}", "one"), ("PATCH", "/v/b", "two"), ("POST", "/", "three"), ("POST", "z", "one"), ("PUT", "/v/b", "two"),
    ]


def test_angular_objects_in_either_order(spark):
    text = "[{ path: 'a', data: { component: X, roles: ['}'] }, component: A }, { component: B, canActivate: [() => f({ path: 'no' })], path: 'b' }, { path: 'c', children: [{ path: 'd', component: D }] }]"
    assert found(spark, ("r.ts", text)) == [("ANY", "a", "A"), ("ANY", "b", "B"), ("ANY", "d", "D")]


def test_prisma_bodies_with_braces_in_strings(spark):
    text = "model User {\n  id Int @id\n  meta Json @default(\"{}\")\n  // a } in a note, it's fine\n  posts Post[]\n  @@map(\"users\")\n}\nenum Kind {\n  A\n}\nmodel Post {\n  id Int\n}\n"
    got = facts.extract_declarations(source(spark, [("s.prisma", text)])).orderBy("line").collect()
    assert [(r.line, r.name, r.fields, r.relations, r.table_name) for r in got] == [(1, "User", ["id", "meta", "posts"], ["Post"], "users"), (8, "Kind", [], [], None), (11, "Post", ["id"], [], "Post")]


def test_lines_of_many_matches_take_linear_time(spark):
    """Four times the matches take four times as long, not sixteen."""
    took = {}
    for n in (200, 8_000, 32_000):
        text = "".join(f"import a{k}\n\nclass C{k}:\n    pass\n" for k in range(n))
        start = time.time()
        got = facts.extract_symbols(source(spark, [("big.py", text)])).agg(F.count("*"), F.min("line"), F.max("line"), F.sum("line")).first()
        took[n] = time.time() - start
        assert tuple(got) == (n, 3, 4 * n - 1, sum(4 * k + 3 for k in range(n)))
    assert took[32_000] < 8 * max(took[8_000], 0.5)
