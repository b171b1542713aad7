"""Statement extents, callees and arguments of the code rules: hand-made cases, and random code against a plain scanner."""

import random
import re

from vigil.operators import code, spans

FIRES = {  # one statement each: rule and line
    "call closed on line 40": ("db.query(" + "\n" * 38 + "`SELECT ${req.body.id}`\n);", [("sql-injection-template-literal", 1)]),
    "call on a call's result": ("getDb().query(`x ${req.query.q}`);", [("sql-injection-template-literal", 1)]),
    "computed member": ("exec(req['body']);", [("command-injection", 1)]),
    "callee on the next line": ("const u = await User\n  .find(req.body);", [("nosql-injection", 1)]),
    "chain over lines": ("\nreturn pool\n  .connect(a, [b])\n  // note ' here\n  .query(`x ${ctx.id}`);", [("sql-injection-template-literal", 2)]),
    "name before a comment": ("\ndb // first\n  .query(`x ${ctx.id}`);", [("sql-injection-template-literal", 2)]),
    "index in a chain": ("dbs[0].query(`x ${input}`)", [("sql-injection-template-literal", 1)]),
    "type arguments": ("repo.findOne<User>(req.params);", [("nosql-injection", 1), ("idor", 1)]),
    "comment among arguments": ("eval(/* , ) */ code);", [("unsafe-eval", 1)]),
    "argument after a nested call": ("Object.assign(merge(a, b), req.body);", [("prototype-pollution", 1)]),
    "joined path": ("fs.readFile(path.join(root(1, 2), '/x', req.params.f), cb);", [("path-traversal", 1)]),
    "string built over lines": ("cp.exec('ls ' +\n\n\n\n\n\n\n\n  dir);", [("command-injection", 1)]),
    "route without middleware": ("app.get('/admin',\n  (req, res) => { res.send(a(b, c)); });", [("missing-auth-middleware", 1)]),
    "middleware that is no auth": ("app.post('/user', limiter({max: 5}), h);", [("missing-auth-middleware", 1)]),
    "html over lines": ("<div dangerouslySetInnerHTML={{\n  __html: marked(\n    text, {a: 1})\n}} />", [("xss-dangerous-inner-html", 1)]),
    "pattern with a quote before": ("s.replace(/\"/g, ''); eval(code);", [("unsafe-eval", 1)]),
}
STAYS = {
    "inside a string": "log('do not eval(x) here');",
    "inside a block comment": "/* first\n eval(x)\n */ ok();",
    "inside a template": "const t = `\nexec(req.body)\n`;",
    "after a line comment": "a(); // eval(x)",
    "auth behind a call": "app.get('/admin', limiter({max: 5}), authenticate, h);",
    "auth as a member": "router.put('/account', mw.requireAuth, h);",
    "declared method": "class A { exec(input) { return 1; } }",
    "declared function": "function exec(input) { return 1; }",
    "optional call": "db?.query(`x ${req.body.a}`);",
    "string argument": "eval(\n  '1 + 1'\n);",
    "input in a later argument": "Users.find({ a: 1 }, req.body);",
    "logical argument": "cp.exec(a + b || c);",
    "constant html": "<div dangerouslySetInnerHTML={{ __html: '<b>' }} />",
    "unclosed call": "eval(code",
}


def test_statements(make_files):
    names = [*FIRES, *STAYS]
    texts = {k: v[0] for k, v in FIRES.items()} | STAYS
    found = code.code_findings(make_files([("p", f"/src/f{i}.tsx", texts[n]) for i, n in enumerate(names)]))
    got: dict = {}
    for r in found.select("path", "rule", "line").collect():
        got.setdefault(names[int(re.search(r"\d+", r.path)[0])], []).append((r.rule, r.line))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, (_, v) in FIRES.items()}


def test_credentials_over_lines(make_files):
    files = make_files([("p", "/a.js", "const password =\n  'hunter2hunter2';\nlet apiKey = \"k9k9k9k9k9\";\ncfg.secret = 'q1w2e3r4' + y;\nf(token = 'abcdefgh');\n"
                         "session.authToken = 'abcdefgh';\nconst dbSecret: string = 'z1z2z3z4z5';")])
    rules = [r for r in code.CODE_RULES if r.key.startswith("sast_hardcoded")]
    got = {(r.line, r.column) for r in code.code_hits(files, include_ref_dead=True, rules=rules).collect()}
    assert got == {(1, 6), (3, 4), (6, 0), (7, 6)}


def expression(rng, depth, calls):
    """Random code, and the watched calls in it as (callee, arguments)."""
    kind = rng.randrange(9 if depth else 4)
    if kind == 0:
        return rng.choice(["a", "b.c", "7", "x0"])
    if kind == 1:
        return rng.choice(["'(,'", '"]) \\" ,"', "`${a(b)},\n(`", "'it\\'s'", "''"])
    if kind in (2, 3):
        return rng.choice(["req.body", "d", "e.f.g"])
    if kind == 4:
        return "[" + ", ".join(expression(rng, depth - 1, calls) for _ in range(rng.randrange(4))) + "]"
    if kind == 5:
        return "{k: " + expression(rng, depth - 1, calls) + ", m: 2}"
    name = rng.choice(["obj.find", "query", "plain", "q.w.find"])
    args = [expression(rng, depth - 1, calls) for _ in range(rng.randrange(4))]
    gap = rng.choice(["", " ", "\n", " /* ,( */ "])
    if name.endswith(("find", "query")):
        calls.append((name, [a.strip() for a in args]))
    return f"{name}({gap}" + f",{gap}".join(args) + ")"


def test_random_code(spark):
    rng = random.Random(12)
    texts, want = [], []
    for _ in range(150):
        calls: list = []
        texts.append(rng.choice(["", "it is ) odd, ", "say \"x\" and `y\n"[:8]]) + "\n" + "; ".join(expression(rng, 4, calls) for _ in range(4)))
        want.append(sorted((n, [re.sub(r"\s", "", re.sub(r"/\*.*?\*/", "", a)) for a in args]) for n, args in calls))
    df = spark.createDataFrame(list(enumerate(texts)), "i long, content string").repartition(4)
    for r in spans.with_calls(spans.with_units(df), r"(?:find|query)\s*$").collect():
        got = sorted((c.callee, [re.sub(r"\s", "", re.sub(r"/\*.*?\*/", "", a)) for a in c["args"]]) for c in r["#calls"])
        assert got == want[r.i], texts[r.i]


def test_long_files_stay_whole(spark):
    """Tens of thousands of marks, deep nesting and strings past any stack."""
    deep = "f(" * 3000 + "x" + ")" * 3000
    many = "".join(f"a{i}.find(req.body, [1, 2]);\n" for i in range(8000))
    long = "m.find('" + "\\'x" * 60_000 + "', `" + "y\n" * 60_000 + "`)"
    df = spark.createDataFrame([(0, many), (1, long), (2, deep + "; z.find(q)")], "i long, content string")
    found = {r.i: r["#calls"] for r in spans.with_calls(spans.with_units(df), r"\.\s*find\s*$").collect()}
    assert len(found[0]) == 8000 and {c.line for c in found[0]} == set(range(1, 8001))
    assert [len(c["args"]) for c in found[1]] == [2]
    assert found[2][0]["args"] == ["q"] and found[2][0].line == 1


def test_no_shuffle(make_files):
    plan = code.code_findings(make_files([("p", "/a.js", "eval(x)")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
