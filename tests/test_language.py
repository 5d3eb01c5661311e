"""Small programs and the sets they give, restated from the language's rules."""

import pytest

from fathomlog.session import ConstraintError, Incremental, Session
from fathomlog.syntax import ProgramError, parse


def rows(spark, program, label="default"):
    return {tuple(r) for r in Session(spark).run(program)[label].collect()}


PROGRAMS = {
    "facts are a set": ("p(1). p(1). p(2). ?- p(X).", {(1,), (2,)}),
    "null joins null": ("p(1, null). p(2, 7). p(3, null). q(null). q(7). q(9). ?- p(X, Y), q(Y).", {(1, None), (2, 7), (3, None)}),
    "an ordering has no value at null": ("p(1, null). p(2, 7). ?- p(X, Y), Y > 3.", {(2, 7)}),
    "not holds at null": ("p(1, null). p(2, 7). p(3, 1). ?- p(X, Y), not Y > 3.", {(1, None), (3, 1)}),
    "no value withholds the row": ("s(0). s(1). s(2). ?- s(X), Y = 10 / X.", {(1, 10), (2, 5)}),
    "not holds without a value": ("s(0). s(1). s(2). ?- s(X), not 10 / X = 5.", {(0,), (1,)}),
    "<> needs a value": ("s(0). s(1). s(2). ?- s(X), 10 / X <> 5.", {(1,)}),
    "a partial argument of a negated atom": ("s(0). s(5). t(2). ?- s(X), not t(10 / X).", {(0,)}),
    "defined": ("s(0). s(1). ?- s(X), defined(1 / X).", {(1,)}),
    "connectives absorb": ("s(0). s(1). ?- s(X), (X = 0) || (1 / X = 1).", {(0,), (1,)}),
    "division truncates": ("?- X = -7 / 2, Y = -7 % 3, Z = 7.0 / 2.", {(-3, -1, 3.5)}),
    "integers leave their domain": ("n(9007199254740991). n(1). ?- n(X), Y = X + 1.", {(1, 2)}),
    "bits": ("?- A = 5 & 3, B = 5 | 8, C = 5 ^ 1, D = 1 << 33, E = -1 >>> 28, F = -8 >> 1.", {(1, 13, 4, 2, 15, -4)}),
    "precedence": ("?- X = 2 + 3 * 2 ** 2, Y = 1 - 2 - 3.", {(14.0, -4)}),
    "strings": ('?- S = "héllo", A = S[1], B = S[1:3], C = S[9], D = upper(S), E = length(S), F = S + 1.5.', {("héllo", "é", "él", "", "HéLLO", 5, "héllo1.5")}),
    "conditional": ('?- X in [1 .. 3], S = X > 2 ? "big" : "small".', {(1, "small"), (2, "small"), (3, "big")}),
    "a wide range": ("s(10000). ?- s(N), I in [1 .. N], I % 2500 = 0.", {(10000, 2500), (10000, 5000), (10000, 7500), (10000, 10000)}),
    "views of views": ("a(1). a(2). b(X, Y) :- a(X), a(Y). c(X, Z) :- b(X, Y), b(Y, Z). d(X, Z) :- c(X, Y), c(Y, Z). ?- d(1, X).", {(1,), (2,)}),
    "range of another": ("s(2). s(0). ?- s(N), I in [1 .. N].", {(2, 1), (2, 2)}),
    "round half away": ("?- A = round(2.5), B = round(-0.5), C = round(1.255, 1), D = round(1250, -2).", {(3, -1, 1.3, 1300)}),
    "numbers as text": ("?- A = to_string(1.0), B = to_string(1.0e) .".replace("1.0e", "0.1"), {("1", "0.1")}),
    "union lifts to value": ('v(1). v("a"). v(null). ?- v(X).', {("1",), ('"a"',), ("null",)}),
    "integer and float widen": ("v(1). v(2.5). ?- v(X).", {(1.0,), (2.5,)}),
    "json": ('?- V = parse_json("{\\"bb\\": [1, 2.50], \\"a\\": null}"), A = V["bb"][1], T = type_of(V["a"]).', {('{"a":null,"bb":[1,2.5]}', "2.5", "null")}),
    "a missing key has no value": ('?- V = parse_json("{}"), A = V["x"].', set()),
    "object iteration": ('?- object_entry({"x": 1, "y": "z"}, K, V).', {("x", "1"), ("y", '"z"')}),
    "array iteration": ("?- array_element([7, 8], I, V).", {(0, "7"), (1, "8")}),
    "keys of one object": ('?- X = {"b": 1, "aa": 2, "b": 3}, K = keys(X).', {('{"b":3,"aa":2}', '["aa","b"]')}),
    "closure of a cycle": ("e(1, 2). e(2, 3). e(3, 1). t(X, Y) :- e(X, Y). t(X, Z) :- t(X, Y), e(Y, Z). ?- t(1, X).", {(1,), (2,), (3,)}),
    "non-linear closure": ("e(1, 2). e(2, 3). e(3, 4). t(X, Y) :- e(X, Y). t(X, Z) :- t(X, Y), t(Y, Z). ?- t(1, X).", {(2,), (3,), (4,)}),
    "mutual recursion": ("ev(0). ev(Y) :- od(X), Y = X + 1, Y < 6. od(Y) :- ev(X), Y = X + 1, Y < 6. ?- ev(X).", {(0,), (2,), (4,)}),
    "alternation": ("move(1, 2). move(2, 3). move(4, 4). win(X) :- move(X, Y), not open^(Y). open^(X) :- move(X, Y), not win(Y). ?- win(X).", {(2,)}),
    "the upper side of an alternation": ("move(1, 2). move(2, 3). move(4, 4). win(X) :- move(X, Y), not open^(Y). open^(X) :- move(X, Y), not win(Y). ?- open^(X).", {(2,), (4,)}),
    "division": ('t(1, "a"). t(1, "b"). t(2, "a"). w("a"). w("b"). lacks(X) :- t(X, _), w(W), not t(X, W). ?- t(X, _), not lacks(X).', {(1,)}),
    "proofs": ("num(0). num(1). l(0) :: Nil. l(n + 1) :: Cons :- num(C), n < 2, l(n). h(C, N) :- P : l(N), P = Cons(C, _). ?- h(C, N).", {("0", 1), ("1", 1), ("0", 2), ("1", 2)}),
    "nested patterns": ("l(0) :: Nil. l(n + 1) :: Cons(T) :- n < 2, T : l(n). two(X) :- X : l(N), X = Cons(Cons(_)), N = 2. ?- two(X).", {('{"args":[{"args":[{"args":[],"$proof":"l::Nil"}],"$proof":"l::Cons"}],"$proof":"l::Cons"}',)}),
    "a ground query": ("p(1). ?- p(1).", {(True,)}),
    "a failing ground query": ("p(1). ?- p(2).", set()),
    "an unsupplied input is empty": ("input predicate p(x: integer). ?- p(X).", set()),
    "narrowed by a test anywhere in the body": ("p(1, null). p(2, 3). ?- p(X, Y), Z = Y + 1, Y <> null.", {(2, 3, 4)}),
    "narrowed by a negated equality": ("p(1, null). p(2, 3). q(X, Y + 1) :- p(X, Y), not Y = null. ?- q(X, Y).", {(2, 4)}),
    "a condition that is null": ('b(1, true). b(2, null). b(3, false). ?- b(X, C), S = C ? "yes" : "no".', {(1, True, "yes"), (3, False, "no")}),
    "connectives over nulls": ("b(1, true). b(2, null). b(3, false). ?- b(X, C), C || X = 2.", {(1, True), (2, None)}),
    "strict floats": ('r("1e5"). r("-0"). r("-0.5"). r("2"). r("-3.25"). r("1."). f(S, to_float(S)) :- r(S). ?- f(S, F).', {("-0.5", -0.5), ("2", 2.0), ("-3.25", -3.25)}),
    "refinements of computed positions": ("s(1, 0 as P, 1 as C, _: 0 <= P, _: P <= C). s(I + 1, C, P + C as N, _: 0 <= C, _: C <= N) :- s(I, P, C), I < 5. ?- s(I, _, C).", {(1, 1), (2, 1), (3, 2), (4, 3), (5, 5)}),
    "refinements of swapped positions": ("p(1, 2). q(Y, X, _: X <= Y) :- p(X, Y). ?- q(A, B).", {(2, 1)}),
    "own types inside, published ones outside": ("n(0: value). n(X + 1: value) :- n(X), X < 3. ?- n(X).", {(0,), (1,), (2,), (3,)}),
    "typed fields of a record": ('r({"age": 36}). next(P["age"] + 1) :- r(P). ?- next(X).', {(37,)}),
}


@pytest.mark.parametrize("name", PROGRAMS)
def test_program(spark, name):
    program, expected = PROGRAMS[name]
    assert rows(spark, program) == expected


AGGREGATES = {
    "counts up to each row": ('a("x", 1). a("x", 3). a("y", 2). a("x", 5). output predicate g(K, T, count(*), min(U), max(U)) :- a(K, T), a(K, U), U <= T.', {("x", 1, 1, 1, 1), ("x", 3, 2, 1, 3), ("x", 5, 3, 1, 5), ("y", 2, 1, 2, 2)}),
    "counts of meetings": ('a(1, "x"). a(2, "x"). a(3, "y"). b(7, "x"). b(8, "x"). b(9, "z"). output predicate g(N, count(*)) :- a(_, N), b(_, N).', {("x", 4)}),
    "nulls meet": ("a(1, null). a(2, null). a(3, 5). output predicate g(N, count(*)) :- a(X, N), a(Y, N).", {(None, 4), (5, 1)}),
    "no meetings at all": ('a(1, "x"). b(9, "z"). output predicate g(count(*)) :- a(_, N), b(_, N).', {(0,)}),
    "all meetings": ('a(1, "x", 3). a(2, "x", 4). b(9, "x"). b(8, "x"). output predicate g(count(*), "all") :- a(_, N, _), b(_, N).', {(4, "all")}),
    "counts strictly behind": ('a("x", 1). a("x", 3). a("y", 2). output predicate g(K, T, count(*)) :- a(K, T), a(K, U), T < U.', {("x", 1, 1)}),
    "counts of pairs": ('a("x", 1). a("x", 3). a("y", 3). a("y", 4). output predicate g(K, count(*)) :- a(K, T), a(_, U), U >= T.', {("x", 7), ("y", 4)}),
    "ranks of all": ("a(5). a(3). a(9). a(4). output predicate g(X, count(*), max(Y)) :- a(X), a(Y), Y < X.", {(4, 1, 3), (5, 2, 4), (9, 3, 5)}),
    "orderings over null": ("a(5). a(null). a(3). output predicate g(X, count(*)) :- a(X), a(Y), Y <= X.", {(3, 1), (5, 2)}),
    "orderings of two relations": ('a(1, "p"). a(1, "q"). a(2, "p"). b(1, 0). b(1, 1). b(2, 9). output predicate g(K, "c", count(*)) :- a(K, _), b(K, U), U < K.', {(1, "c", 2)}),
    "groups": ('a("x", 1). a("x", 2). a("y", 5). output predicate g(G, count(*), sum(V), avg(V), min(V), max(V)) :- a(G, V).', {("x", 2, 3, 1.5, 1, 2), ("y", 1, 5, 5.0, 5, 5)}),
    "bindings are a bag": ('a("x", 1). a("y", 1). output predicate g(sum(V), count(*)) :- a(_, V).', {(2, 2)}),
    "lists put nulls first": ("a(2). a(null). a(1). output predicate g(list(X), count(X)) :- a(X).", {("[null,1,2]", 3)}),
    "concat sorts": ('a("b", 1). a("a", 2). a("a", 3). output predicate g(concat(X)) :- a(X, _).', {("a,a,b",)}),
    "empty groups have identities": ("a(1). output predicate g(count(*), sum(X), list(X), concat(X)) :- a(X), X > 1.", {(0, 0, "[]", "")}),
    "empty minimum has none": ("a(1). output predicate g(min(X)) :- a(X), X > 1.", set()),
    "aggregates nest in expressions": ("a(1). a(2). output predicate g(count(*) - 1, sum(X) * 2) :- a(X).", {(1, 6)}),
    "sums are bounded apart": ("a(9007199254740991). a(1). a(-1). output predicate g(sum(X)) :- a(X).", set()),
    "count skips what has no value": ("a(0). a(1). output predicate g(count(1 / X), count(*)) :- a(X).", {(1, 2)}),
    "constants are no group": ('a(1). a(2). output predicate g("all", count(*)) :- a(_).', {("all", 2)}),
}


@pytest.mark.parametrize("name", AGGREGATES)
def test_aggregate(spark, name):
    program, expected = AGGREGATES[name]
    assert rows(spark, program, "g") == expected


BAD = {
    "unsafe head": "p(1). q(X, Y) :- p(X).",
    "unsafe negation": "p(1). ?- not p(X).",
    "two queries": "p(1). ?- p(X). ?- p(Y).",
    "arity": "p(1). ?- p(X, Y).",
    "unknown predicate": "?- nothing(X).",
    "negative recursion": "p(1). a(X) :- p(X), not a(X). ?- a(X).",
    "recursive aggregate": "p(1). a(count(*) - 1) :- p(X). b(count(*)) :- b(X). ?- b(X).",
    "types that do not meet": 'p(1). q("a"). ?- p(X), q(X).',
    "arithmetic on null": "p(1, null). p(2, 3). ?- p(X, Y), Z = Y + 1.",
    "negative subscript": '?- X = "abc"[-1].',
    "mixed names": "p(1) :: A. p(2). ?- p(X).",
    "narrow annotation": 'p(X: integer) :- X = "a". ?- p(X).',
    "head names in a cycle": "q(1). p(A + 1 as B, B + 1 as A) :- q(_). ?- p(X, Y).",
    "a published type hides the own one": "n(1: value). q(X + 1) :- n(X). ?- q(X).",
    "a refinement of no position": "p(1). q(X + 1, _: X > 0) :- p(X). ?- q(Y).",
    "a function in place of an atom": "p(1). ?- p(X), abs(X).",
    "recursive alias": "type A = [A]. p(1). ?- p(X).",
}


@pytest.mark.parametrize("name", BAD)
def test_rejected(spark, name):
    with pytest.raises(ProgramError):
        Session(spark).run(BAD[name])


def test_constraints(spark):
    with pytest.raises(ConstraintError):
        Session(spark).run("p(1). !- p(X), X > 0. ?- p(X).")
    with pytest.raises(ConstraintError):
        Session(spark).run("t(X: integer, _: X > 3) :- X in [1 .. 4]. ?- t(X).")
    with pytest.raises(ConstraintError):
        Session(spark).run("p(1). error predicate bad(X) :- p(X). ?- p(X).")
    assert rows(spark, "p(1). !- p(X), X > 1. ?- p(X).") == {(1,)}


def test_output_names(spark):
    r = Session(spark).run('a("x", 1). output predicate g(G, count(*), count(V), G + "!") :- a(G, V).')
    assert r["g"].columns == ["G", "count", "count_", "col4"]


def test_iteration_limit(spark):
    r = Session(spark, max_iterations=3).run("n(0). n(X + 1) :- n(X). ?- n(X).")
    assert r.capped == ["n"] and {x[0] for x in r["default"].collect()} == {0, 1, 2, 3}


def test_trace(spark):
    events = []
    Session(spark, trace=events.append).run("e(1, 2). e(2, 3). t(X, Y) :- e(X, Y). t(X, Z) :- t(X, Y), e(Y, Z). ?- t(X, Y).")
    assert [(e["stratum"], e["recursive"]) for e in events if e["kind"] == "stratum"] == [(["e"], False), (["t"], True)]
    assert [(e["round"], e["new"]) for e in events if e["kind"] == "round"] == [(0, {"t": 2}), (1, {"t": 1}), (2, {"t": 0})]
    assert [(e["round"], e["predicate"], e["rule"], e["derived"]) for e in events if e["kind"] == "rule"] == [(1, "t", 1, 1), (2, "t", 1, 0)]


def test_modules(spark):
    files = {"reach.dl": "input predicate edge(a: integer, b: integer). tc(X, Y) :- edge(X, Y). tc(X, Z) :- tc(X, Y), edge(Y, Z). ?- tc(X, Y).", "two.dl": "p(1). ?- p(X)."}
    program = 'a(1, 2). a(2, 3). b(7, 8). input predicate t(x: integer, y: integer) := from "reach.dl"(edge = a). input predicate u(x: integer, y: integer) := tc from "reach.dl"(edge = b). ?- t(X, Y), not u(X, Y).'
    got = Session(spark, resolve=files.__getitem__).run(program)["default"].collect()
    assert {tuple(r) for r in got} == {(1, 2), (2, 3), (1, 3)}
    with pytest.raises(ProgramError):
        Session(spark, resolve=files.__getitem__).run('input predicate t(x: integer, y: integer) := from "reach.dl". ?- t(X, Y).')
    with pytest.raises(ProgramError):
        Session(spark, resolve=files.__getitem__).run('input predicate t(x: integer) := nothing from "two.dl". ?- t(X).')


def test_module_boundaries(spark):
    files = {
        "m/top.dl": 'input predicate base(x: integer) := from "parts/one.dl". up(X + 1) :- base(X). ?- up(X).',
        "m/parts/one.dl": "one(1). ?- one(X).",
        "null.dl": "p(1). p(null). ?- p(X).",
        "text.dl": 'p("a"). ?- p(X).',
        "wide.dl": "p(1: value). ?- p(X).",
        "need.dl": "input predicate r(x: integer). ?- r(X).",
    }
    run = lambda text: {tuple(r) for r in Session(spark, resolve=files.__getitem__).run(text)["default"].collect()}
    assert run('input predicate t(x: integer) := from "m/top.dl". ?- t(X).') == {(2,)}
    assert run('a(7). input predicate t(x: integer) := from "m/top.dl"(base = a). ?- t(X).') == {(8,)}
    assert run('input predicate t(x: integer?) := from "null.dl". ?- t(X).') == {(1,), (None,)}
    assert run('input predicate t(x: float) := from "m/top.dl". ?- t(X).') == {(2.0,)}
    for text in ('input predicate t(x: integer) := from "null.dl"', 'input predicate t(x: integer) := from "text.dl"', 'input predicate t(x: integer, y: integer) := from "text.dl"', 'input predicate t(x: integer) := from "wide.dl"', 'a("x"). input predicate t(x: integer) := from "need.dl"(r = a)', 'a(null). input predicate t(x: integer) := from "need.dl"(r = a)'):
        with pytest.raises(ProgramError):
            run(f"{text}. ?- t({'X, Y' if 'y:' in text else 'X'}).")


def test_advice(spark):
    """Each kind of warning, and a program that has none."""

    def codes(text, **options):
        return sorted({line.split(":")[0] for line in Session(spark).advice(text, **options) if "-" in line.split(":")[0]})

    data = "p(1, null). p(2, 3). b(1, null). b(2, true). "
    assert codes(data + "?- b(X, C), C.") == ["nullable-filter"]
    assert codes(data + "a(X) :- p(X, Y), Y < 3. c(X) :- p(X, Y), Y >= 3. ?- a(X), c(X).") == ["nullable-ordering-gap"]
    assert codes(data + "?- p(X, Y), not Y < 3.") == ["nullable-negated-ordering"]
    assert codes(data + "?- p(X, Y), not Y < 3, Y <> null.") == []
    assert codes(data + "?- p(X, _), 10 / X <> 5.") == ["partial-inequality"]
    assert codes(data + "?- p(X, _), defined(X).") == ["constant-defined"]
    assert codes(data + "q(10 / X) :- p(X, _). ?- q(X).") == []
    assert codes(data + "q(10 / X) :- p(X, _). ?- q(X).", warn_undefined=True) == ["undefined-expression"]
    assert codes(data + "q^(X) :- p(X, _). ?- q^(X).") == ["inert-maximal"]
    assert codes(data + "q(X, _: X > 0) :- p(X, _). q(X) :- b(X, _). ?- q(X).") == ["inert-contract"]
    assert codes(data + "q(X, _: 0 <= 0) :- p(X, _). ?- q(X).") == ["constant-refinement"]
    assert codes(data + "q(X) :- p(X, Y), Y > 2. ?- q(X).") == []


def test_incremental(spark):
    s = Incremental(Session(spark))
    s.add("e(1, 2). e(2, 3).")
    s.add("t(X, Y) :- e(X, Y). t(X, Z) :- t(X, Y), e(Y, Z).")
    assert {r[0] for r in s.add("?- t(1, X).")["default"].collect()} == {2, 3}
    with pytest.raises(ProgramError):
        s.add("e(4, 5).")
    assert s.schema()["t"] == ["integer", "integer"]


def test_parse_errors():
    for text in ("p(", "p(1)", "?- p(X), .", "p(1) :- .", "input predicate p()."):
        with pytest.raises(ProgramError):
            parse(text)
