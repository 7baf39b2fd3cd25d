import sqlite3

from strataline.sources import coverage, workspace

CODE = '''"""Docs."""
import os


@staticmethod
def f(x):
    """More."""
    global y
    if x:
        return (1,
                2)
    else:
        pass
    try:
        z()
    except ValueError:  # pragma: no cover
        z()
        z()


def g():  # pragma: no cover
    return 1


if os:  # pragma: no cover
    f(1)
else:
    f(2)
'''


def numbits(lines):
    out = bytearray(max(lines, default=0) // 8 + 1)
    for n in lines:
        out[n // 8] |= 1 << n % 8
    return bytes(out)


def data_file(folder, files, arcs=()):
    """files: (path, [lines of each context])"""
    folder.mkdir(parents=True, exist_ok=True)
    db = sqlite3.connect(folder / ".coverage")
    db.executescript("CREATE TABLE file (id INTEGER PRIMARY KEY, path TEXT); CREATE TABLE line_bits (file_id INTEGER, context_id INTEGER, numbits BLOB); CREATE TABLE arc (file_id INTEGER, context_id INTEGER, fromno INTEGER, tono INTEGER);")
    for k, (path, contexts) in enumerate(files):
        db.execute("INSERT INTO file VALUES (?, ?)", (k, str(path)))
        for c, lines in enumerate(contexts):
            db.execute("INSERT INTO line_bits VALUES (?, ?, ?)", (k, c, numbits(lines)))
    for path, a, b in arcs:
        db.execute("INSERT INTO arc SELECT id, 0, ?, ? FROM file WHERE path = ?", (a, b, str(path)))
    db.commit()
    db.close()


def test_statement_lines():
    assert coverage.statement_lines(CODE) == [2, 5, 6, 9, 10, 13, 14, 15, 28]
    assert coverage.statement_lines("") == [] and coverage.statement_lines("def") is None and coverage.statement_lines(None) is None
    for lines in ([], [1], [7, 8, 9], [1, 63, 64, 65, 4000]):
        assert coverage.lines_of(numbits(lines)) == set(lines)


def test_nearest_data_file(spark, tmp_path):
    root = tmp_path / "repo"
    sources = {
        "top.py": "a = 1\nb = 2\n", "pkg/a.py": "a = 1\nb = 2\nc = 3\n", "pkg/deep/er/b.py": "a = 1\nb = 2\nc = 3\nd = 4\n", "pkg/deep/none.py": "a = 1\n", "pkg/empty.py": '"""Docs."""\n', "pkgs/c.py": "a = 1\n", "bad/x.py": "a = 1\n",
        "branch/y.py": "a = 1\nb = 2\nc = 3\n", "broken.py": "def",
    }
    for path, text in sources.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    data_file(root, [(root / "top.py", [[1], [2]]), (root / "pkg/a.py", [[1, 2, 3]]), ("/elsewhere/top.py", [[1]])])
    data_file(root / "pkg", [(root / "pkg/a.py", [[1], []]), ("deep/er/b.py", [[1, 2], [2, 3]]), ("../../outside.py", [[1]])])
    data_file(root / "branch", [(root / "branch/y.py", [])], [(root / "branch/y.py", -1, 1), (root / "branch/y.py", 1, 3), (root / "branch/y.py", 3, -1)])
    (root / "bad").mkdir(exist_ok=True)
    (root / "bad/.coverage").write_bytes(b"no database" * 100)
    data = coverage.read_coverage(spark, [str(root)]).cache()
    assert [r["folder"] for r in data.where("error is not null").collect()] == ["bad"] and data.rdd.getNumPartitions() == 4
    read = workspace.read_sources(spark, str(root))
    got = {r["path"]: (r["n_statements"], r["n_missing"]) for r in coverage.coverage_of_sources(read, data).collect()}
    assert got == {"top.py": (2, 0), "pkg/a.py": (3, 2), "pkg/deep/er/b.py": (4, 1), "pkg/deep/none.py": (1, 1), "pkg/empty.py": (0, 0), "pkgs/c.py": (1, 1), "branch/y.py": (3, 1)}

    from strataline.operators import syntax

    rows = {r["path"]: r["testing_coverage"] for r in syntax.static_metrics(read, coverage.coverage_of_sources(read, data)).collect()}
    assert rows == {"top.py": 100.0, "pkg/a.py": 33.333, "pkg/deep/er/b.py": 75.0, "pkg/deep/none.py": 0.0, "pkg/empty.py": 100.0, "pkgs/c.py": 0.0, "branch/y.py": 66.667, "bad/x.py": 0.0, "broken.py": None}


def test_no_data_file(spark, tmp_path):
    data = coverage.read_coverage(spark, [str(tmp_path)])
    assert data.isEmpty()
    assert coverage.coverage_of_sources(spark.createDataFrame([("a.py", "a = 1")], "path string, source string"), data).isEmpty()
