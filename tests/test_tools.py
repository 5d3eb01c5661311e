"""Formats, advice, obligations, command line and notebook cells."""

import os

import pytest

from fathomlog import formats
from fathomlog.cli import main
from fathomlog.functions.values import canonical, js_number
from fathomlog.magic import Cells
from fathomlog.plans.obligations import verify
from fathomlog.session import Session
from fathomlog.syntax import ProgramError


def test_numbers_print_as_in_scripts():
    want = {1.0: "1", 1e21: "1e+21", 1e-7: "1e-7", 123456789.0: "123456789", 0.1: "0.1", -0.0: "0", 1.5e300: "1.5e+300", 5e-324: "5e-324", 1e20: "100000000000000000000", 123e-8: "0.00000123", -2.5: "-2.5"}
    assert {x: js_number(x) for x in want} == want


def test_canonical_text():
    assert canonical('{"bb": 1e3, "a": [1.0, null, "é\\n"], "c": {}}') == '{"a":[1,null,"é\\n"],"c":{},"bb":1000}'
    assert canonical("9e999") is canonical("{a") is canonical("NaN") is canonical(None) is None


def test_formats(spark):
    df = spark.createDataFrame([("a", "b", 'x,"y'), ("a", "c", None)], "s string, t string, l string")
    assert formats.csv(df) == 's,t,l\na,b,"x,""y"\na,c,'
    assert formats.mermaid(df).splitlines()[0] == "graph TD" and formats.graph(df) == 'a -> b (x,"y), c (null)'
    assert formats.table(df).splitlines()[0].split() == ["s", "t", "l"]
    assert formats.jsonl(df).count("\n") == 1
    assert formats.proof('{"args":[7,{"args":[],"$proof":"l::Nil"}],"$proof":"l::Cons"}') == "Cons(7, Nil())"


def test_advice(spark):
    s = Session(spark)
    assert s.advice("n(0). n(X + 1) :- n(X). ?- n(X).") == ["n: argument 1 may grow without end"]
    assert s.advice("n(0). n(X + 1) :- n(X), X < 9. ?- n(X).") == []
    assert s.advice("input predicate p(a). q(1). ?- q(X).") == ["input p is not used"]


def test_obligations(spark):
    texts = Session(spark).obligations("q(X) :- X in [1 .. 5]. !- q(X), X > 7. ?- q(X).")
    assert len(texts) == 1 and "(assert (> |X| 7))" in next(iter(texts.values()))


def test_contract_obligations(spark):
    """One text for each refinement of each rule; contracts of what is read are hypotheses; a solver tells."""
    program = "s(1, 0 as P, 1 as C, _: 0 <= P, _: P <= C). s(I + 1, C, P + C as N, _: 0 <= C, _: C <= N) :- s(I, P, C), I < 9. f(X / 2.0 as H, _: H > 0.0) :- s(X, _, _). ?- s(I, _, C), f(_)."
    texts = Session(spark).obligations(program)
    assert sorted(texts) == ["s, rule 1, refinement 1", "s, rule 1, refinement 2", "s, rule 2, refinement 1", "s, rule 2, refinement 2"]
    last = texts["s, rule 2, refinement 2"]
    assert "(assert (or (and (<= 0 |P|) (<= |P| |C|)) (and (<= 0 |P|) (<= |P| |C|))))" in last and "(assert (not (<= |C| (+ |P| |C|))))" in last and "(assert (< |I| 9))" in last
    assert set(verify(texts, "echo unsat").values()) == {"proved"} and set(verify(texts, "echo sat").values()) == {"FAILED"}
    with pytest.raises(ProgramError):
        verify(texts, "no-such-solver")
    halved = Session(spark).obligations("p(-7). q(X / 2 as H, _: H >= -3) :- p(X). ?- q(X).")
    assert "(ite (>= |X| 0) (div |X| 2) (- (div (- |X|) 2)))" in halved["q, rule 1, refinement 1"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "e.csv").write_text("a,b\n1,2\n2,3\n")
    program = tmp_path / "p.dl"
    program.write_text("input predicate e(a: integer, b: integer). t(X, Y) :- e(X, Y). t(X, Z) :- t(X, Y), e(Y, Z). ?- t(1, X).")
    assert main([str(program), "--format", "csv"]) == 0
    assert capsys.readouterr().out == "X\n2\n3\n"
    program.write_text("p(1). !- p(X). ?- p(X).")
    assert main([str(program)]) == 1
    program.write_text("p(1). q(X, _: 0 <= 0) :- p(X). ?- q(X).")
    assert main([str(program), "--strict-contracts"]) == 1
    assert main([str(program), "--verify", "--solver", "echo unsat"]) == 0
    assert main([str(program), "--input", "e=a.csv", "--input", "e=b.csv"]) == 1
    capsys.readouterr()
    program.write_text("p(1). ?- p(1).")
    assert main([str(program)]) == 0 and capsys.readouterr().out == "yes\n"


def test_notebook_cells(spark):
    cells, names = Cells(Session(spark)), {}
    cells.run("", "p(1). p(2).", names)
    assert cells.run("found", "?- p(X), X > 1.", names).split() == ["X", "2"]
    assert names["found"]["X"].tolist() == [2]


def test_streamed_input(spark, tmp_path):
    from fathomlog.streaming.growing import follow

    for k in range(3):
        spark.createDataFrame([(k, k + 1)], "a long, b long").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("a long, b long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    program = "input predicate e(a: integer, b: integer). t(X, Y) :- e(X, Y). t(X, Z) :- t(X, Y), e(Y, Z). ?- t(X, Y)."
    query = follow(Session(spark), program, "e", stream, f"{tmp_path}/state", lambda r, _: seen.append({tuple(x) for x in r["default"].collect()}))
    query.awaitTermination()
    assert seen[-1] == {(0, 1), (1, 2), (2, 3), (0, 2), (1, 3), (0, 3)} and len(seen) >= 1


def test_intermediate_tables(spark):
    """A cluster must name a shared folder; what was written there can be deleted."""
    from types import SimpleNamespace

    from fathomlog import storage

    unset = SimpleNamespace(get=lambda *_: None)
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            storage.shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, getConf=lambda: unset)))
    store = storage.Store(spark)
    kept, rows = store.counted(spark.range(5))
    assert rows == 5 == kept.count() and store.counted(spark.range(0))[1] == 0
    storage.remove(spark, store.root)
    assert not os.path.exists(store.root.removeprefix("file://"))
