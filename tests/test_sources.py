"""Loaders: what they take, and what they refuse."""

import pytest
from pyspark.errors import PySparkException

from fathomlog.session import Session
from fathomlog.sources.loaders import mermaid_edges


def load(spark, tmp_path, name, text, program):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return {tuple(r) for r in Session(spark, str(tmp_path)).run(program)["default"].collect()}


def test_csv(spark, tmp_path):
    text = '﻿name,age,extra,ok\n"Ada, A.",36,x,yes\n\n Bob ,,y,0\n'
    program = "input predicate p(name: string, age: integer?, ok: boolean). ?- p(N, A, O)."
    assert load(spark, tmp_path, "p.csv", text, program) == {("Ada, A.", 36, True), (" Bob ", None, False)}


def test_csv_in_splits_and_folded(spark, tmp_path):
    """Records with line breaks inside quotes, and files without any; files that begin with data."""
    program = "input predicate p(a: string, b: integer). ?- p(X, Y)."
    assert load(spark, tmp_path, "p.csv", 'a,b\n"one\ntwo",1\n"say ""x""",2\n', program) == {("one\ntwo", 1), ('say "x"', 2)}
    assert load(spark, tmp_path, "p.csv", 'a,b\n"x,y",1\nz,2\n', program) == {("x,y", 1), ("z", 2)}
    (tmp_path / "p.csv").write_text("x,1\ny,2\n")
    assert {tuple(r) for r in Session(spark, str(tmp_path), csv_header=False).run(program)["default"].collect()} == {("x", 1), ("y", 2)}


def test_csv_keeps_zero_characters(spark, tmp_path):
    program = "input predicate p(a: string, b: integer). ?- p(X, Y)."
    assert load(spark, tmp_path, "p.csv", 'a,b\n"x\0,",1\n"\0""\0",2\n\0y\0,3\n', program) == {("x\0,", 1), ('\0"\0', 2), ("\0y\0", 3)}
    assert load(spark, tmp_path, "p.csv", 'a,b\n"x\0\ny",1\n"""\0\n",2\n', program) == {("x\0\ny", 1), ('"\0\n', 2)}


def test_pages_of_further_formats(spark, tmp_path):
    """JSON lines, Parquet and diagrams over HTTP."""
    import threading
    from functools import partial
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

    spark.sql("SELECT 1L AS a, 'x' AS b").coalesce(1).write.parquet(str(tmp_path / "t"))
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "t.parquet")
    (tmp_path / "t.jsonl").write_text('{"a": 1, "b": "x"}\n')
    (tmp_path / "t.mmd").write_text("graph TD\n p --> q\n")
    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(SimpleHTTPRequestHandler, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/t"
        for kind in ("parquet", "jsonl"):
            assert {tuple(r) for r in Session(spark).bind("p", f"{url}.{kind}").run("input predicate p(a: integer, b: string). ?- p(X, Y).")["default"].collect()} == {(1, "x")}
        assert {tuple(r) for r in Session(spark).bind("p", f"{url}.mmd").run("input predicate p(a: string, b: string). ?- p(X, Y).")["default"].collect()} == {("p", "q")}
    finally:
        server.shutdown()


@pytest.mark.parametrize("cell", ["007", "1.5", "x", "9007199254740992", ""])
def test_csv_refuses(spark, tmp_path, cell):
    with pytest.raises(PySparkException):
        load(spark, tmp_path, "p.csv", f"a,b\n{cell},1\n", "input predicate p(a: integer, b: integer). ?- p(X, Y).")


def test_jsonl(spark, tmp_path):
    text = '{"a": 1, "b": "x"}\n\n[2, null]\n'
    assert load(spark, tmp_path, "p.jsonl", text, "input predicate p(a: integer, b: string?). ?- p(X, Y).") == {(1, "x"), (2, None)}
    assert load(spark, tmp_path, "v.jsonl", '{"a":1.0}\n[1]\n', "input predicate v(x: value). ?- v(X).") == {('{"a":1}',), ("[1]",)}


@pytest.mark.parametrize("line", ['{"a": "1"}', "{}", "[1, 2]", '{"a": 1.5}', "{a}"])
def test_jsonl_refuses(spark, tmp_path, line):
    with pytest.raises(PySparkException):
        load(spark, tmp_path, "p.jsonl", line + "\n", "input predicate p(a: integer). ?- p(X).")


def test_structural_contract(spark, tmp_path):
    program = "input predicate p(x: {name: string, age?: integer}). ?- p(X), N = X[\"name\"] + \"!\"."
    assert load(spark, tmp_path, "p.jsonl", '{"name": "Ada"}\n', program) == {('{"name":"Ada"}', "Ada!")}
    with pytest.raises(PySparkException):
        load(spark, tmp_path, "p.jsonl", '{"name": "Ada", "other": 1}\n', program)


def test_json_document(spark, tmp_path):
    assert load(spark, tmp_path, "c.json", '{"b": [1],\n "a": 2}', "input predicate c(x: value). ?- c(X), A = X[\"a\"].") == {('{"a":2,"b":[1]}', "2")}


def test_parquet(spark, tmp_path):
    spark.sql("SELECT 1 AS a, 'x' AS b, timestamp_ntz'2020-01-02 03:04:05' AS t, array(1, 2) AS v").write.parquet(str(tmp_path / "p.parquet"))
    program = "input predicate p(a: integer, t: string, v: value). ?- p(A, T, V)."
    assert {tuple(r) for r in Session(spark, str(tmp_path)).run(program)["default"].collect()} == {(1, "2020-01-02T03:04:05.000Z", "[1,2]")}


def test_mermaid(spark, tmp_path):
    assert mermaid_edges("graph TD\n a --> b --> c\n b -->|x| d\n c -- y --> a\n a & b --> c\n") == [("a", "b", ""), ("b", "c", ""), ("b", "d", "x"), ("c", "a", "y")]
    assert load(spark, tmp_path, "e.mmd", "flowchart LR\n a --> b\n", "input predicate e(x, y). ?- e(X, Y).") == {("a", "b")}


def test_http(spark, monkeypatch):
    import io

    from fathomlog.sources import loaders
    from fathomlog.syntax import ProgramError, parse

    seen = []

    def urlopen(url, timeout):
        seen.append(url)
        return io.BytesIO(b'{"a": 1}' if url.endswith(".json") else b"n,x\n1,a\n2,b\n")

    monkeypatch.setattr(loaders.urllib.request, "urlopen", urlopen)
    decl = parse("input predicate p(x: string, n: integer).").statements[0]
    rows = loaders.load(spark, "https://docs.google.com/spreadsheets/d/KEY/edit#gid=7", decl).collect()
    assert {tuple(r) for r in rows} == {("a", 1), ("b", 2)} and seen == ["https://docs.google.com/spreadsheets/d/KEY/export?format=csv&gid=7"]
    doc = parse("input predicate d(v: value).").statements[0]
    assert loaders.load(spark, "gh:owner/repo/dir/file.json", doc).first()[0] == '{"a":1}'
    assert seen[-1] == "https://raw.githubusercontent.com/owner/repo/HEAD/dir/file.json"
    with pytest.raises(ProgramError):
        loaders.fetch("ftp://x/y.json")
