"""Text references and block states against a plain reading of the lines."""

from __future__ import annotations

import random

from loamgraph.operators import references as V

CODE = '''import x
/* sink.matched(a)
   matched(b) */
def first():
    sink.matched(1)
    matched(2)
"""doc
matched(3)
"""
def second():
    # matched(4)
    x = "matched"
    org.matched.Element
    y = matched
    \'\'\' one line \'\'\'
def matched():
    other.matched(5)
def third(): return a.matched(6) + "matched"
/* open
   still */ matched(7)
matched(8)'''


def plain_inside(texts):
    out, closing = [], None
    for t in texts:
        s = t.lstrip(" ")
        out.append(closing is not None)
        if closing:
            closing = None if closing in s else closing
            continue
        for mark, end in V.BLOCKS:
            if s.startswith(mark):
                closing = end if end not in s[len(mark) :] else None
                break
    return out


def test_block_states_of_long_and_short_files(spark):
    r = random.Random(1)
    marks = ["/*", " /* x", "*/", 'a """', '"""', "'''", " ''' y '''", "code", "", "x */ y", '""" z """', "'''*/"]
    files = {f"f{k}": [r.choice(marks) if r.random() < 0.3 else "code" for _ in range(n)] for k, n in enumerate((1, 7, 8, 9, 64, 65, 700))}
    rows = [(f, i, t) for f, texts in files.items() for i, t in enumerate(texts, 1)]
    df = spark.createDataFrame(rows, "file string, line long, text string")
    want = {(f, i) for f, texts in files.items() for i, x in enumerate(plain_inside(texts), 1) if x}
    for chunk in (4, 8, 1000):  # several levels, some, one
        assert {(x["file"], x["line"]) for x in V.block_lines(df, chunk).collect()} == want
    assert V.block_lines(df.limit(0)).count() == 0


def test_references(spark):
    rows = [(f, i, t) for f in ("src/a.py", "tests/b.py", "vendor/c.py", "d.md") for i, t in enumerate(CODE.split("\n"), 1)] + [("src/a.py", 40, None)]
    lines = spark.createDataFrame(rows, "file string, line long, text string")
    names = [("first", 4, 6), ("second", 10, 15), ("matched", 16, 17), ("third", 18, 18)]
    symbols = spark.createDataFrame([(f, n, a, b) for f in ("src/a.py", "tests/b.py") for n, a, b in names], "file string, name string, line long, end_line long")
    none = spark.createDataFrame([], "file string, line long, owner string")
    defined = spark.createDataFrame([("src/a.py", 16), ("tests/b.py", 16)], "file string, line long")
    got = V.text_references(lines, symbols, ["matched"], defined, none).orderBy("place").collect()
    tell = [(r["owner"], r["file"], r["line"], r["kind"]) for r in got]
    # the last symbol has ended before line 21, so the nearest above it stands in, which is where line 18 is too
    assert tell == [("first", "src/a.py", 5, 0), ("third", "src/a.py", 18, 0), ("second", "src/a.py", 14, 2), ("first", "tests/b.py", 5, 0), ("third", "tests/b.py", 18, 0), ("second", "tests/b.py", 14, 2)]
    known = spark.createDataFrame([("src/a.py", 5, "first"), ("tests/b.py", 18, None)], "file string, line long, owner string")
    got = V.text_references(lines, symbols, ["matched"], defined, known).orderBy("place").collect()
    assert [(r["owner"], r["file"], r["line"]) for r in got] == [("third", "src/a.py", 18), ("second", "src/a.py", 14), ("first", "tests/b.py", 5), ("third", "tests/b.py", 21), ("second", "tests/b.py", 14)]
    assert V.text_references(lines, symbols, ["a.b", "("], defined, none).count() == 0
