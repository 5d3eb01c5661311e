"""Registered queries over the test tables, one or more for each operator, and their SQL.

Each is a program text; the tables it declares are bound to Parquet. Keys of tables are
stated once, so that aggregates need no distinct over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import Incremental, Session
from .storage import Store
from .syntax import Input, parse

#: Columns that make a table's rows distinct.
KEYS = {
    "region": {"r_regionkey"}, "nation": {"n_nationkey"}, "customer": {"c_custkey"}, "supplier": {"s_suppkey"}, "part": {"p_partkey"},
    "orders": {"o_orderkey"}, "lineitem": {"l_orderkey", "l_linenumber"}, "events": {"event_id"}, "documents": {"doc_id"}, "pages": {"page_id"},
    "benchmark": {"item_id"}, "labels": {"doc_id"}, "conversations": {"conv_id", "turn"},
}


def run(program: str, label: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    session = Session(spark)
    for s in parse(program).statements:
        if isinstance(s, Input) and s.name in KEYS:
            unique = {c.name for c in s.columns} >= KEYS[s.name]
            session.bind(s.name, spark.read.parquet(f"{sf_dir}/{s.name}.parquet"), unique=unique)
    result = session.run(program)
    if result.capped:
        raise RuntimeError(f"recursion was cut off: {', '.join(result.capped)}")
    return result[label]


CUSTOMER = "input predicate customer(c_custkey: integer, c_name: string, c_nationkey: integer, c_acctbal: float, c_mktsegment: string).\n"
ORDERS = "input predicate orders(o_orderkey: integer, o_custkey: integer, o_orderstatus: string, o_totalprice: float, o_orderdate: string, o_orderpriority: string).\n"
NATION = "input predicate nation(n_nationkey: integer, n_name: string, n_regionkey: integer).\n"
REGION = "input predicate region(r_regionkey: integer, r_name: string).\n"
SUPPLIER = "input predicate supplier(s_suppkey: integer, s_name: string, s_nationkey: integer, s_acctbal: float).\n"
PART = "input predicate part(p_partkey: integer, p_name: string, p_brand: string, p_type: string, p_size: integer, p_retailprice: float).\n"
LINE = "input predicate lineitem(l_orderkey: integer, l_partkey: integer, l_suppkey: integer, l_linenumber: integer, l_quantity: float, l_extendedprice: float, l_discount: float, l_returnflag: string, l_linestatus: string, l_shipdate: string).\n"
EVENTS = "input predicate events(event_id: integer, ts: string, user_id: integer, event_type: string, `value`: float, props: string).\n"
TURNS = "input predicate conversations(conv_id: integer, turn: integer, role: string).\n"
DOCS = "input predicate documents(doc_id: integer, lang: string, source: string, n_chars: integer).\n"

NO_P = "p_order(C) :- orders(_, C, \"P\", _, _, _).\n"
TURN_EDGES = "e(C, X, Y) :- conversations(C, X, _), conversations(C, Y, _), Y = X + 1.\n"
TURN_CLOSURE = 'WITH RECURSIVE e AS (SELECT DISTINCT a.conv_id c, a.turn x, b.turn y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), tc AS (SELECT c, x, y FROM e UNION SELECT tc.c, tc.x, e.y FROM tc JOIN e ON tc.c = e.c AND tc.y = e.x) SELECT c AS "C", x AS "X", y AS "Y" FROM tc'
K = "CAST(json_extract(props, '$.k') AS BIGINT)"

#: name -> (program, output label, SQL or None)
PROGRAMS: dict[str, tuple[str, str, str | None]] = {
    "join_filter": (
        CUSTOMER + ORDERS + "big(Name, Total) :- customer(C, Name, _, _, _), orders(_, C, _, Total, _, _), Total > 1000.0.\n?- big(Name, Total).",
        "default",
        'SELECT DISTINCT c_name AS "Name", o_totalprice AS "Total" FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 1000.0',
    ),
    "projection": (ORDERS + "?- orders(_, _, Status, _, _, Priority).", "default", 'SELECT DISTINCT o_orderstatus AS "Status", o_orderpriority AS "Priority" FROM orders'),
    "constant_args": (NATION + REGION + 'in_asia(N) :- region(R, "ASIA"), nation(_, N, R).\n?- in_asia(N).', "default", "SELECT DISTINCT n_name AS \"N\" FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "computed_args": (TURNS + "next(C, X) :- conversations(C, X, _), conversations(C, X + 1, _).\n?- next(C, X).", "default", 'SELECT DISTINCT a.conv_id AS "C", a.turn AS "X" FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1'),
    "repeated_variable": (LINE + "same(O, P) :- lineitem(O, P, P, _, _, _, _, _, _, _).\n?- same(O, P).", "default", 'SELECT DISTINCT l_orderkey AS "O", l_partkey AS "P" FROM lineitem WHERE l_partkey = l_suppkey'),
    "cross_join": (REGION + "?- region(A, _), region(B, _).", "default", 'SELECT CAST(a.r_regionkey AS BIGINT) AS "A", CAST(b.r_regionkey AS BIGINT) AS "B" FROM region a, region b'),
    "theta_join": (NATION + "?- nation(A, _, R), nation(B, _, R), A < B.", "default", 'SELECT CAST(a.n_nationkey AS BIGINT) AS "A", CAST(a.n_regionkey AS BIGINT) AS "R", CAST(b.n_nationkey AS BIGINT) AS "B" FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey'),
    "same_generation": (NATION + "sg(A, B) :- nation(A, _, R), nation(B, _, R).\n?- sg(A, B).", "default", 'SELECT DISTINCT CAST(a.n_nationkey AS BIGINT) AS "A", CAST(b.n_nationkey AS BIGINT) AS "B" FROM nation a JOIN nation b USING (n_regionkey)'),
    "semi_join": (CUSTOMER + ORDERS + 'urgent(C) :- customer(C, _, _, _, _), orders(_, C, _, _, _, "1-URGENT").\n?- urgent(C).', "default", "SELECT c_custkey AS \"C\" FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "anti_join": (CUSTOMER + ORDERS + NO_P + "?- customer(C, _, _, _, _), not p_order(C).", "default", "SELECT c_custkey AS \"C\" FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "outer_join": (
        CUSTOMER + ORDERS + NO_P + 'lj(C, T) :- customer(C, _, _, _, _), orders(_, C, "P", T, _, _).\nlj(C, null) :- customer(C, _, _, _, _), not p_order(C).\n?- lj(C, T).',
        "default",
        "SELECT DISTINCT c_custkey AS \"C\", o_totalprice AS \"T\" FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey",
    ),
    "null_join": (
        CUSTOMER + ORDERS + NO_P + 'lj(C, N) :- customer(C, _, N, _, _), p_order(C).\nlj(C, null) :- customer(C, _, _, _, _), not p_order(C).\nm(N, count(*)) :- lj(A, N), lj(B, N).\n?- m(N, K).',
        "default",
        "WITH lj AS (SELECT c_custkey c, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN CAST(c_nationkey AS BIGINT) END n FROM customer) SELECT n AS \"N\", count(*) * count(*) AS \"K\" FROM lj GROUP BY n",
    ),
    "union": (CUSTOMER + SUPPLIER + "place(N) :- customer(_, _, N, B, _), B < -900.0.\nplace(N) :- supplier(_, _, N, _).\n?- place(N).", "default", 'SELECT CAST(c_nationkey AS BIGINT) AS "N" FROM customer WHERE c_acctbal < -900 UNION SELECT s_nationkey FROM supplier'),
    "intersect": (CUSTOMER + SUPPLIER + "?- customer(_, _, N, _, _), supplier(_, _, N, _).", "default", 'SELECT CAST(c_nationkey AS BIGINT) AS "N" FROM customer INTERSECT SELECT s_nationkey FROM supplier'),
    "except": (NATION + SUPPLIER + "rich(N) :- supplier(_, _, N, B), B > 5000.0.\n?- nation(N, _, _), not rich(N).", "default", 'SELECT CAST(n_nationkey AS BIGINT) AS "N" FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000'),
    "division": (
        ORDERS + "status(S) :- orders(_, _, S, _, _, _).\nhas(C, S) :- orders(_, C, S, _, _, _).\nlacks(C) :- has(C, _), status(S), not has(C, S).\nall_of(C) :- has(C, _), not lacks(C).\n?- all_of(C).",
        "default",
        'SELECT o_custkey AS "C" FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = (SELECT count(DISTINCT o_orderstatus) FROM orders)',
    ),
    "negated_filter": (NATION + "?- nation(N, Name, R), not R < 3, not Name = \"NATION_7\".", "default", "SELECT CAST(n_nationkey AS BIGINT) AS \"N\", n_name AS \"Name\", CAST(n_regionkey AS BIGINT) AS \"R\" FROM nation WHERE n_regionkey >= 3 AND n_name <> 'NATION_7'"),
    "filter_range": (PART + "?- part(P, _, _, _, S, _), S in [10 .. 12].", "default", 'SELECT p_partkey AS "P", CAST(p_size AS BIGINT) AS "S" FROM part WHERE p_size BETWEEN 10 AND 12'),
    "rank_count": (NATION + "rank(A, count(*)) :- nation(A, NA, _), nation(_, NB, _), NB <= NA.\n?- rank(N, R).", "default", 'SELECT CAST(n_nationkey AS BIGINT) AS "N", rank() OVER (ORDER BY n_name) AS "R" FROM nation'),
    "top_one": (CUSTOMER + "best(N, max(B)) :- customer(_, _, N, B, _).\n?- best(N, B), customer(C, _, N, B, _).", "default", 'SELECT CAST(c_nationkey AS BIGINT) AS "N", c_acctbal AS "B", c_custkey AS "C" FROM customer QUALIFY c_acctbal = max(c_acctbal) OVER (PARTITION BY c_nationkey)'),
    "running_total": (TURNS + "upto(C, T, count(*)) :- conversations(C, T, _), conversations(C, U, _), U <= T.\n?- upto(C, T, N).", "default", 'SELECT DISTINCT conv_id AS "C", turn AS "T", CAST(count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS "N" FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)'),
    "asof_by_negation": (
        TURNS + 'user(C, T) :- conversations(C, T, "user").\nreply(C, T) :- conversations(C, T, "assistant").\nlater(C, T, U) :- reply(C, T), user(C, U), user(C, V), U < V, V <= T.\n?- reply(C, T), user(C, U), U <= T, not later(C, T, U).',
        "default",
        "SELECT r.conv_id AS \"C\", r.turn AS \"T\", max(u.turn) AS \"U\" FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant') r JOIN conversations u ON u.conv_id = r.conv_id AND u.role = 'user' AND u.turn <= r.turn GROUP BY 1, 2",
    ),
    "asof_join": (
        TURNS + 'user(C, T) :- conversations(C, T, "user").\nreply(C, T) :- conversations(C, T, "assistant").\nlast(C, T, max(U)) :- reply(C, T), user(C, U), U <= T.\n?- last(C, T, U).',
        "default",
        "SELECT r.conv_id AS \"C\", r.turn AS \"T\", max(u.turn) AS \"U\" FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant') r JOIN conversations u ON u.conv_id = r.conv_id AND u.role = 'user' AND u.turn <= r.turn GROUP BY 1, 2",
    ),
    "rank_of_all": (ORDERS + "rank(O, count(*)) :- orders(O, _, _, T, _, _), orders(_, _, _, U, _, _), U >= T.\n?- rank(O, R).", "default", 'SELECT o_orderkey AS "O", CAST(count(*) OVER (ORDER BY o_totalprice DESC RANGE UNBOUNDED PRECEDING) AS BIGINT) AS "R" FROM orders'),
    "group_count": (CUSTOMER + "output predicate per_nation(N, count(*)) :- customer(_, _, N, _, _).", "per_nation", 'SELECT CAST(c_nationkey AS BIGINT) AS "N", count(*) AS "count" FROM customer GROUP BY 1'),
    "group_sum": (LINE + "output predicate total(F, S, round(sum(Q), 2), round(sum(P * (1.0 - D)), 2)) :- lineitem(_, _, _, _, Q, P, D, F, S, _).", "total", 'SELECT l_returnflag AS "F", l_linestatus AS "S", round(sum(l_quantity), 2) AS "col3", round(sum(l_extendedprice * (1 - l_discount)), 2) AS "col4" FROM lineitem GROUP BY 1, 2'),
    "group_avg": (ORDERS + "output predicate mean(S, round(avg(T), 2)) :- orders(_, _, S, T, _, _).", "mean", 'SELECT o_orderstatus AS "S", round(avg(o_totalprice), 2) AS "col2" FROM orders GROUP BY 1'),
    "group_minmax": (ORDERS + "output predicate ends(S, min(T), max(T), min(D)) :- orders(_, _, S, T, D, _).", "ends", "SELECT o_orderstatus AS \"S\", min(o_totalprice) AS \"min\", max(o_totalprice) AS \"max\", strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S.%gZ') AS \"min_\" FROM orders GROUP BY 1"),
    "int_sum": (PART + "output predicate sizes(B, sum(S), count(*) - 1) :- part(_, _, B, _, S, _).", "sizes", 'SELECT p_brand AS "B", CAST(sum(p_size) AS BIGINT) AS "sum", count(*) - 1 AS "col3" FROM part GROUP BY 1'),
    "empty_group": (NATION + "output predicate none(count(*), sum(N), list(N), concat(M)) :- nation(N, M, _), N < 0.", "none", "SELECT CAST(0 AS BIGINT) AS \"count\", CAST(0 AS BIGINT) AS \"sum\", '[]' AS \"list\", '' AS \"concat\""),
    "empty_min": (NATION + "output predicate none(min(N)) :- nation(N, _, _), N < 0.", "none", 'SELECT CAST(min(n_nationkey) AS BIGINT) AS "min" FROM nation WHERE n_nationkey < 0 HAVING count(*) > 0'),
    "concat_agg": (NATION + "output predicate names(R, concat(N)) :- nation(_, N, R).", "names", "SELECT CAST(n_regionkey AS BIGINT) AS \"R\", string_agg(n_name, ',' ORDER BY n_name) AS \"concat\" FROM nation GROUP BY 1"),
    "list_agg": (NATION + "output predicate keys_of(R, list(K)) :- nation(K, _, R).", "keys_of", "SELECT CAST(n_regionkey AS BIGINT) AS \"R\", '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']' AS \"list\" FROM nation GROUP BY 1"),
    "grouping_sets": (
        CUSTOMER + 'cube("segment", S, count(*)) :- customer(_, _, _, _, S).\ncube("all", "", count(*)) :- customer(_, _, _, _, _).\n?- cube(G, S, N).',
        "default",
        "SELECT 'segment' AS \"G\", c_mktsegment AS \"S\", count(*) AS \"N\" FROM customer GROUP BY 2 UNION ALL SELECT 'all', '', count(*) FROM customer",
    ),
    "having": (CUSTOMER + "n(N, count(*)) :- customer(_, _, N, _, _).\n?- n(N, C), C > 60.", "default", 'SELECT CAST(c_nationkey AS BIGINT) AS "N", count(*) AS "C" FROM customer GROUP BY 1 HAVING count(*) > 60'),
    "tc_linear": (TURNS + TURN_EDGES + "tc(C, X, Y) :- e(C, X, Y).\ntc(C, X, Z) :- tc(C, X, Y), e(C, Y, Z).\n?- tc(C, X, Y).", "default", TURN_CLOSURE),
    "tc_nonlinear": (TURNS + TURN_EDGES + "tc(C, X, Y) :- e(C, X, Y).\ntc(C, X, Z) :- tc(C, X, Y), tc(C, Y, Z).\n?- tc(C, X, Y).", "default", TURN_CLOSURE),
    "mutual": (
        TURNS + TURN_EDGES + "even(C, 0) :- conversations(C, 0, _).\neven(C, Y) :- odd(C, X), e(C, X, Y).\nodd(C, Y) :- even(C, X), e(C, X, Y).\n?- odd(C, T).",
        "default",
        "WITH RECURSIVE r AS (SELECT DISTINCT conv_id c, turn t FROM conversations WHERE turn = 0 UNION SELECT r.c, v.turn FROM r JOIN conversations v ON v.conv_id = r.c AND v.turn = r.t + 1) SELECT c AS \"C\", t AS \"T\" FROM r WHERE t % 2 = 1",
    ),
    "recursive_arithmetic": ("fib(0, 0, 1).\nfib(N + 1, B, A + B) :- fib(N, A, B), N < 20.\n?- fib(N, F, _).", "default", 'WITH RECURSIVE f(n, a, b) AS (SELECT 0::BIGINT, 0::BIGINT, 1::BIGINT UNION SELECT n + 1, b, a + b FROM f WHERE n < 20) SELECT n AS "N", a AS "F" FROM f'),
    "stratified_negation": (
        TURNS + TURN_EDGES + "reach(C, 2) :- conversations(C, 2, _).\nreach(C, Y) :- reach(C, X), e(C, X, Y).\n?- conversations(C, T, _), not reach(C, T).",
        "default",
        'WITH RECURSIVE r AS (SELECT DISTINCT conv_id c, turn t FROM conversations WHERE turn = 2 UNION SELECT r.c, v.turn FROM r JOIN conversations v ON v.conv_id = r.c AND v.turn = r.t + 1) SELECT DISTINCT conv_id AS "C", turn AS "T" FROM conversations v WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.c = v.conv_id AND r.t = v.turn)',
    ),
    "parity": (
        NATION + "move(A, B) :- nation(A, _, R), nation(B, _, R), B < A.\nwin(A) :- move(A, B), not open^(B).\nopen^(A) :- move(A, B), not win(B).\n?- win(A).",
        "default",
        'SELECT CAST(n_nationkey AS BIGINT) AS "A" FROM (SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) k FROM nation) WHERE k > 1',
    ),
    "range_bind": (PART + 'step(P, I, I > S / 2 ? "upper" : "lower") :- part(P, _, _, _, S, _), I in [1 .. S].\n?- step(P, I, H).', "default", "SELECT p_partkey AS \"P\", i AS \"I\", CASE WHEN i > p_size // 2 THEN 'upper' ELSE 'lower' END AS \"H\" FROM part, unnest(range(1, p_size + 1)) t(i)"),
    "facts": ("colour(\"red\", 1). colour(\"green\", 2). colour(\"red\", 1).\n?- colour(C, N).", "default", "SELECT * FROM (VALUES ('red', CAST(1 AS BIGINT)), ('green', 2)) t(\"C\", \"N\")"),
    "ground_query": (NATION + '?- nation(_, "NATION_7", _).', "default", "SELECT true AS \"__probe\" WHERE EXISTS (SELECT 1 FROM nation WHERE n_name = 'NATION_7')"),
    "nullary": (NATION + 'any() :- nation(_, "NATION_7", _).\nnone() :- nation(_, "NOWHERE", _).\n?- nation(N, _, _), any(), not none().', "default", 'SELECT CAST(n_nationkey AS BIGINT) AS "N" FROM nation'),
    "constraint_ok": (CUSTOMER + ORDERS + "known(C) :- customer(C, _, _, _, _).\n!- orders(_, C, _, _, _, _), not known(C).\noutput predicate checked(count(*)) :- orders(_, _, _, _, _, _).", "checked", 'SELECT count(*) AS "count" FROM orders'),
    "refinement": (NATION + "key(N: integer, _: N >= 0) :- nation(N, _, _).\n?- key(N).", "default", 'SELECT CAST(n_nationkey AS BIGINT) AS "N" FROM nation'),
    "head_names": (CUSTOMER + "output predicate s(N, count(*) as K, K * 2) :- customer(_, _, N, _, _).", "s", 'SELECT CAST(c_nationkey AS BIGINT) AS "N", count(*) AS "count", 2 * count(*) AS "col3" FROM customer GROUP BY 1'),
    "int_division": (ORDERS + "?- orders(O, _, _, _, _, _), Q = O / 7, R = (0 - O) % 7, H = (0 - O) / 7.", "default", 'SELECT o_orderkey AS "O", o_orderkey // 7 AS "Q", -(o_orderkey % 7) AS "R", -(o_orderkey // 7) AS "H" FROM orders'),
    "float_arithmetic": (SUPPLIER + "?- supplier(S, _, _, B), R = round(B / 3.0, 2), H = round(B), F = floor(B), C = ceil(B).", "default", 'SELECT s_suppkey AS "S", s_acctbal AS "B", round(s_acctbal / 3.0, 2) AS "R", CAST(round(s_acctbal) AS BIGINT) AS "H", CAST(floor(s_acctbal) AS BIGINT) AS "F", CAST(ceil(s_acctbal) AS BIGINT) AS "C" FROM supplier'),
    "maths": (SUPPLIER + "?- supplier(S, _, _, B), Q = round(sqrt(B), 4), L = round(ln(B), 4), E = round(exp(B / 10000.0), 4), P = B ** 2.", "default", 'SELECT s_suppkey AS "S", s_acctbal AS "B", round(sqrt(s_acctbal), 4) AS "Q", round(ln(s_acctbal), 4) AS "L", round(exp(s_acctbal / 10000.0), 4) AS "E", pow(s_acctbal, 2) AS "P" FROM supplier WHERE s_acctbal > 0'),
    "bitwise": (ORDERS + "?- orders(O, _, _, _, _, _), A = O & 12, B = O | 3, X = O ^ 5, L = O << 2, R = O >> 1.", "default", 'SELECT o_orderkey AS "O", o_orderkey & 12 AS "A", o_orderkey | 3 AS "B", xor(o_orderkey, 5) AS "X", o_orderkey << 2 AS "L", o_orderkey >> 1 AS "R" FROM orders'),
    "overflow": ("n(9007199254740991). n(1).\n?- n(X), Y = X + 1.", "default", 'SELECT CAST(1 AS BIGINT) AS "X", CAST(2 AS BIGINT) AS "Y"'),
    "partial_div": (EVENTS + "k(E, as_integer(parse_json(P)[\"k\"])) :- events(E, _, _, _, _, P).\n?- k(E, K), Q = 100 / (K % 7).", "default", f'SELECT event_id AS "E", {K} AS "K", CAST(trunc(100.0 / ({K} % 7)) AS BIGINT) AS "Q" FROM events WHERE {K} % 7 <> 0'),
    "defined": (EVENTS + "k(E, as_integer(parse_json(P)[\"k\"])) :- events(E, _, _, _, _, P).\n?- k(E, K), not defined(100 / (K % 7)).", "default", f'SELECT event_id AS "E", {K} AS "K" FROM events WHERE {K} % 7 = 0'),
    "strings": (CUSTOMER + '?- customer(C, N, _, _, S), U = upper(S), L = lower(S), A = S[0], P = S[1:4], G = length(N), R = replace(N, "Customer", "C"), T = S + "/" + C.', "default", 'SELECT c_custkey AS "C", c_name AS "N", c_mktsegment AS "S", upper(c_mktsegment) AS "U", lower(c_mktsegment) AS "L", c_mktsegment[1] AS "A", c_mktsegment[2:4] AS "P", CAST(length(c_name) AS BIGINT) AS "G", replace(c_name, \'Customer\', \'C\') AS "R", c_mktsegment || \'/\' || c_custkey AS "T" FROM customer'),
    "conversions": (
        'raw("12"). raw("-3"). raw("007"). raw("1.50"). raw("x"). raw("true").\nas_int(S, to_integer(S)) :- raw(S).\nas_real(S, to_float(S)) :- raw(S).\noutput predicate all_of(S, I, F) :- as_int(S, I), as_real(S, F).',
        "all_of",
        "SELECT * FROM (VALUES ('12', CAST(12 AS BIGINT), 12.0::DOUBLE), ('-3', -3, -3.0)) t(\"S\", \"I\", \"F\")",
    ),
    "to_string": ("n(1.0). n(2.5). n(1000000.0).\n?- n(X), S = to_string(X).", "default", "SELECT * FROM (VALUES (1.0::DOUBLE, '1'), (2.5, '2.5'), (1000000.0, '1000000')) t(\"X\", \"S\")"),
    "json_object": (EVENTS + '?- events(E, _, _, _, _, P), K = as_integer(parse_json(P)["k"]).', "default", f'SELECT event_id AS "E", props AS "P", {K} AS "K" FROM events'),
    "json_iter": (EVENTS + "?- events(E, _, _, _, _, P), object_entry(parse_json(P), Key, V), T = type_of(V).", "default", f"SELECT event_id AS \"E\", props AS \"P\", 'k' AS \"Key\", CAST({K} AS VARCHAR) AS \"V\", 'number' AS \"T\" FROM events"),
    "json_build": (NATION + 'row({"name": N, "key": K, "pair": [K, R]}) :- nation(K, N, R).\n?- row(V).', "default", "SELECT '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"pair\":[' || n_nationkey || ',' || n_regionkey || ']}' AS \"V\" FROM nation"),
    "json_array": (NATION + "keys_of(R, list(K)) :- nation(K, _, R).\n?- keys_of(R, L), array_element(L, I, E), N = length(L), H = L[0:2].", "default", "WITH g AS (SELECT CAST(n_regionkey AS BIGINT) r, n_nationkey k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 i, count(*) OVER (PARTITION BY n_regionkey) n FROM nation), l AS (SELECT r, '[' || string_agg(k, ',' ORDER BY k) || ']' l, '[' || string_agg(k, ',' ORDER BY k) FILTER (i < 2) || ']' h FROM g GROUP BY r) SELECT r AS \"R\", l AS \"L\", i AS \"I\", CAST(k AS VARCHAR) AS \"E\", n AS \"N\", h AS \"H\" FROM g JOIN l USING (r)"),
    "type_lift": (NATION + "v(N) :- nation(N, _, 0).\nv(M) :- nation(_, M, 1).\n?- v(X), T = type_of(X).", "default", "SELECT CAST(n_nationkey AS VARCHAR) AS \"X\", 'number' AS \"T\" FROM nation WHERE n_regionkey = 0 UNION SELECT '\"' || n_name || '\"', 'string' FROM nation WHERE n_regionkey = 1"),
    "dates": (ORDERS + '?- orders(O, _, _, _, D, _), Y = D[0:4].', "default", "SELECT o_orderkey AS \"O\", strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS \"D\", strftime(o_orderdate, '%Y') AS \"Y\" FROM orders"),
    "proof_terms": (TURNS + TURN_EDGES + "path(C, X, Y) :: Step() :- e(C, X, Y).\npath(C, X, Z) :: Then(P) :- e(C, X, Y), P : path(C, Y, Z).\n?- path(C, X, Y).", "default", TURN_CLOSURE),
    "proof_match": ("num(0). num(1).\nlst(0) :: Nil.\nlst(n + 1) :: Cons :- num(Car), n < 2, lst(n).\nhead_of(C, N) :- P : lst(N), P = Cons(C, _).\n?- head_of(C, N).", "default", "SELECT * FROM (VALUES ('0', CAST(1 AS BIGINT)), ('1', 1), ('0', 2), ('1', 2)) t(\"C\", \"N\")"),
    "pricing_summary": (
        LINE + 'output predicate q1(F, S, round(sum(Q), 2), round(avg(P), 2), count(*)) :- lineitem(_, _, _, _, Q, P, _, F, S, D), D <= "1998-09-02T00:00:00.000Z".',
        "q1",
        "SELECT l_returnflag AS \"F\", l_linestatus AS \"S\", round(sum(l_quantity), 2) AS \"col3\", round(avg(l_extendedprice), 2) AS \"col4\", count(*) AS \"count\" FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    ),
    "revenue_by_nation": (
        CUSTOMER + ORDERS + LINE + NATION + "output predicate revenue(N, round(sum(P * (1.0 - D)), 2)) :- lineitem(O, _, _, _, _, P, D, _, _, _), orders(O, C, _, _, _, _), customer(C, _, K, _, _), nation(K, N, _).",
        "revenue",
        'SELECT n_name AS "N", round(sum(l_extendedprice * (1 - l_discount)), 2) AS "col2" FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1',
    ),
    # One query or more for each function and for what has no place above.
    "count_expr": (ORDERS + "output predicate n(S, count(1000 / (O % 5)), count(*)) :- orders(O, _, S, _, _, _).", "n", 'SELECT o_orderstatus AS "S", count(CASE WHEN o_orderkey % 5 <> 0 THEN 1 END) AS "count", count(*) AS "count_" FROM orders GROUP BY 1'),
    "connectives": (ORDERS + '?- orders(O, C, S, T, _, _), T > 200000.0 && S = "F" || !(T > 1000.0) && S <> "O".', "default", "SELECT o_orderkey AS \"O\", o_custkey AS \"C\", o_orderstatus AS \"S\", o_totalprice AS \"T\" FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F' OR NOT (o_totalprice > 1000) AND o_orderstatus <> 'O'"),
    "guarded_or": (ORDERS + "?- orders(O, _, _, _, _, _), (O % 3 = 0) || (100 / (O % 3) = 50).", "default", 'SELECT o_orderkey AS "O" FROM orders WHERE o_orderkey % 3 <> 1'),
    "unary_minus": (SUPPLIER + "?- supplier(S, _, N, B), M = -N, F = -B.", "default", 'SELECT s_suppkey AS "S", CAST(s_nationkey AS BIGINT) AS "N", s_acctbal AS "B", -CAST(s_nationkey AS BIGINT) AS "M", -s_acctbal AS "F" FROM supplier'),
    "abs_of": (SUPPLIER + "?- supplier(S, _, _, B), A = abs(B), I = abs(3 - S).", "default", 'SELECT s_suppkey AS "S", s_acctbal AS "B", abs(s_acctbal) AS "A", abs(3 - s_suppkey) AS "I" FROM supplier'),
    "trim_of": (CUSTOMER + '?- customer(C, N, _, _, _), T = trim("  " + N + " "), I = "<" + trim("\\t" + N) + ">".', "default", "SELECT c_custkey AS \"C\", c_name AS \"N\", c_name AS \"T\", '<' || chr(9) || c_name || '>' AS \"I\" FROM customer"),
    "precedence": (ORDERS + "?- orders(O, _, _, _, _, _), X = 2 + O * 3 - 4 / 2, Y = O & 6 | 1, Z = 10 - O - 1.", "default", 'SELECT o_orderkey AS "O", o_orderkey * 3 AS "X", (o_orderkey & 6) | 1 AS "Y", 9 - o_orderkey AS "Z" FROM orders'),
    "binary_literal": (PART + "?- part(P, _, _, _, _, _), M = P & 0b1011.", "default", 'SELECT p_partkey AS "P", p_partkey & 11 AS "M" FROM part'),
    "round_digits": (PART + "?- part(P, _, _, _, _, R), A = round(R, 1), B = round(P, -2), F = floor(R / 7.0), C = ceil(R / 7.0).", "default", 'SELECT p_partkey AS "P", p_retailprice AS "R", round(p_retailprice, 1) AS "A", CAST(floor(p_partkey / 100.0 + 0.5) * 100 AS BIGINT) AS "B", CAST(floor(p_retailprice / 7.0) AS BIGINT) AS "F", CAST(ceil(p_retailprice / 7.0) AS BIGINT) AS "C" FROM part'),
    "json_keys": (EVENTS + '?- events(E, _, _, _, _, P), V = parse_json(P), H = has_key(V, "k"), M = has_key(V, "m"), K = keys(V), W = values(V), J = to_json(V), N = length(V).', "default", f"""SELECT event_id AS "E", props AS "P", '{{"k":' || {K} || '}}' AS "V", true AS "H", false AS "M", '["k"]' AS "K", '[' || {K} || ']' AS "W", '{{"k":' || {K} || '}}' AS "J", CAST(1 AS BIGINT) AS "N" FROM events"""),
    "json_missing": (EVENTS + '?- events(E, _, _, _, _, P), V = parse_json(P), not defined(V["none"]), not defined(V[0]), not defined(as_string(V["k"])).', "default", f"""SELECT event_id AS "E", props AS "P", '{{"k":' || {K} || '}}' AS "V" FROM events"""),
    "extractions": (
        CUSTOMER + 'rec(C, {"n": N, "b": B > 0.0, "f": B, "c": C}) :- customer(C, N, _, B, _).\nout(C, S, T, F, I) :- rec(C, V), S = as_string(V["n"]), T = as_boolean(V["b"]), F = as_float(V["f"]), I = as_integer(V["c"]).\n?- out(C, S, T, F, I).',
        "default",
        'SELECT c_custkey AS "C", c_name AS "S", c_acctbal > 0 AS "T", c_acctbal AS "F", c_custkey AS "I" FROM customer',
    ),
    "implicit_extraction": (NATION + 'rec({"key": K, "name": N}) :- nation(K, N, _).\nnext(P["key"] + 1, P["name"] + "!") :- rec(P).\n?- next(K, N).', "default", "SELECT CAST(n_nationkey + 1 AS BIGINT) AS \"K\", n_name || '!' AS \"N\" FROM nation"),
    "literal_keys": (NATION + '?- nation(K, _, _), V = {"bb": K, "a": 1, "bb": 2}.', "default", "SELECT CAST(n_nationkey AS BIGINT) AS \"K\", '{\"a\":1,\"bb\":2}' AS \"V\" FROM nation"),
    "value_of_conditional": (NATION + '?- nation(K, _, R), V = K > 3 ? [K] : R.', "default", "SELECT CAST(n_nationkey AS BIGINT) AS \"K\", CAST(n_regionkey AS BIGINT) AS \"R\", CASE WHEN n_nationkey > 3 THEN '[' || n_nationkey || ']' ELSE CAST(n_regionkey AS VARCHAR) END AS \"V\" FROM nation"),
    "cond_null": (CUSTOMER + 'rich(C, B > 0.0) :- customer(C, _, N, B, _), N > 4.\nrich(C, null) :- customer(C, _, N, _, _), N <= 4.\n?- rich(C, T), W = T ? "rich" : "poor".', "default", "SELECT c_custkey AS \"C\", c_acctbal > 0 AS \"T\", CASE WHEN c_acctbal > 0 THEN 'rich' ELSE 'poor' END AS \"W\" FROM customer WHERE c_nationkey > 4"),
    "refinement_computed": (PART + "sized(P, S * 2 as D, S + 1 as N, _: N <= D, _: 0 <= P) :- part(P, _, _, _, S, _), S > 0.\n?- sized(P, D, N).", "default", 'SELECT p_partkey AS "P", CAST(p_size * 2 AS BIGINT) AS "D", CAST(p_size + 1 AS BIGINT) AS "N" FROM part WHERE p_size > 0'),
    "to_float_strict": (SUPPLIER + 'raw(S, S + ".50") :- supplier(S, _, _, _).\nraw(S, S + "e3") :- supplier(S, _, _, _).\nraw(S, "-0.5" + S) :- supplier(S, _, _, _).\nraw(S, "0" + S) :- supplier(S, _, _, _).\nf(T, to_float(T)) :- raw(_, T).\n?- f(T, F).', "default", "SELECT s_suppkey || '.50' AS \"T\", s_suppkey + 0.5::DOUBLE AS \"F\" FROM supplier UNION SELECT '-0.5' || s_suppkey, CAST('-0.5' || s_suppkey AS DOUBLE) FROM supplier"),
    "conversions_of": (ORDERS + 'i(O, to_integer("" + O)) :- orders(O, _, _, _, _, _).\nb(S, to_boolean(S = "F" ? "true" : S)) :- orders(_, _, S, _, _, _).\n?- orders(O, _, S, _, _, _), i(O, I), b(S, B), T = to_string(O), U = to_string(S = "F").', "default", "SELECT o_orderkey AS \"O\", o_orderstatus AS \"S\", o_orderkey AS \"I\", true AS \"B\", CAST(o_orderkey AS VARCHAR) AS \"T\", 'true' AS \"U\" FROM orders WHERE o_orderstatus = 'F'"),
    "overflow_of": (ORDERS + "?- orders(O, _, _, _, _, _), X = 9007199254740000 + O.", "default", 'SELECT o_orderkey AS "O", 9007199254740000 + o_orderkey AS "X" FROM orders WHERE o_orderkey <= 991'),
    "facts_joined": (ORDERS + 'name("F", "filled"). name("O", "open").\n?- orders(O, _, S, _, _, _), name(S, N).', "default", "SELECT o_orderkey AS \"O\", o_orderstatus AS \"S\", CASE o_orderstatus WHEN 'F' THEN 'filled' ELSE 'open' END AS \"N\" FROM orders WHERE o_orderstatus IN ('F', 'O')"),
    "recursive_sum": (TURNS + TURN_EDGES + "run(C, 0, 1) :- conversations(C, 0, _).\nrun(C, Y, S + Y) :- run(C, X, S), e(C, X, Y).\n?- run(C, T, S).", "default", 'WITH RECURSIVE r AS (SELECT DISTINCT conv_id c, CAST(turn AS BIGINT) t, CAST(1 AS BIGINT) s FROM conversations WHERE turn = 0 UNION SELECT r.c, v.turn, r.s + v.turn FROM r JOIN conversations v ON v.conv_id = r.c AND v.turn = r.t + 1) SELECT c AS "C", t AS "T", s AS "S" FROM r'),
    "proof_patterns": (
        NATION + 'at(N) :: Home(R) :- nation(N, _, R), R < 2.\nat(N) :: Away :- nation(N, _, R), R >= 2.\nhome(N, R) :- P : at(N), P = Home(R).\n?- home(N, R).',
        "default",
        'SELECT CAST(n_nationkey AS BIGINT) AS "N", CAST(n_regionkey AS VARCHAR) AS "R" FROM nation WHERE n_regionkey < 2',
    ),
    "proof_anti_join": (TURNS + TURN_EDGES + "path(C, X, Y) :: Step() :- e(C, X, Y).\npath(C, X, Z) :: Then(P) :- e(C, X, Y), P : path(C, Y, Z).\n?- conversations(C, T, _), not path(C, 0, T).", "default", 'WITH RECURSIVE r AS (SELECT DISTINCT conv_id c, turn t FROM conversations WHERE turn = 0 UNION SELECT r.c, v.turn FROM r JOIN conversations v ON v.conv_id = r.c AND v.turn = r.t + 1) SELECT DISTINCT conv_id AS "C", turn AS "T" FROM conversations v WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.c = v.conv_id AND r.t = v.turn AND r.t > 0)'),
    "aliases": ('type Key = integer.\ntype Row = {key: Key, name: string}.\ninput predicate nation(n_nationkey: Key, n_name: string, n_regionkey: integer).\nrow({"key": K, "name": N}: Row) :- nation(K, N, _).\n?- row(R), K = R["key"] + 0.', "default", "SELECT '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS \"R\", CAST(n_nationkey AS BIGINT) AS \"K\" FROM nation"),
    "annotations": (NATION + "k(N: float) :- nation(N, _, _).\nk(R: integer?) :- nation(_, _, R).\n?- k(X).", "default", 'SELECT CAST(n_nationkey AS BIGINT) AS "X" FROM nation UNION SELECT n_regionkey FROM nation'),
    "range_safe_order": (PART + "?- part(P, _, _, _, S, _), I in [S .. S + 1], J = I * 2, J in [10 .. 14].", "default", 'SELECT p_partkey AS "P", CAST(p_size AS BIGINT) AS "S", CAST(i AS BIGINT) AS "I", CAST(2 * i AS BIGINT) AS "J" FROM part, unnest([p_size, p_size + 1]) t(i) WHERE 2 * i BETWEEN 10 AND 14'),
    "negated_null": (CUSTOMER + ORDERS + NO_P + 'lj(C, N) :- customer(C, _, N, _, _), p_order(C).\nlj(C, null) :- customer(C, _, _, _, _), not p_order(C).\nknown(C, N + 1) :- lj(C, N), not N = null.\n?- known(C, M).', "default", "SELECT c_custkey AS \"C\", CAST(c_nationkey + 1 AS BIGINT) AS \"M\" FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "interval_join": (ORDERS + 'p(O, T) :- orders(O, _, "P", T, _, _).\nband(A, A * 10000.0, A * 10000.0 + 9999.99) :- A in [0 .. 60].\nn(A, count(*)) :- band(A, L, H), p(_, T), L <= T, T <= H.\n?- n(A, N).', "default", "SELECT CAST(a AS BIGINT) AS \"A\", count(*) AS \"N\" FROM range(0, 61) t(a) JOIN (SELECT DISTINCT o_orderkey, o_totalprice p FROM orders WHERE o_orderstatus = 'P') ON p BETWEEN a * 10000.0 AND a * 10000.0 + 9999.99 GROUP BY 1"),
    "documents_by_language": (DOCS + "output predicate sizes(L, count(*), sum(N), max(N)) :- documents(_, L, _, N).", "sizes", 'SELECT lang AS "L", count(*) AS "count", CAST(sum(n_chars) AS BIGINT) AS "sum", max(n_chars) AS "max" FROM documents GROUP BY 1'),
}


#: Files of the module query: a closure over any edges, and a module that wires it.
MODULES = {
    "reach.dl": "input predicate edge(c: integer, a: integer, b: integer).\ntc(C, X, Y) :- edge(C, X, Y).\ntc(C, X, Z) :- tc(C, X, Y), edge(C, Y, Z).\n?- tc(C, X, Y).",
}


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive closure by a module whose input is wired to this program's edges."""
    program = TURNS + TURN_EDGES + 'input predicate t(c: integer, x: integer, y: integer) := from "reach.dl"(edge = e).\n?- t(C, X, Y).'
    session = Session(spark, resolve=MODULES.__getitem__)
    session.bind("conversations", spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return session.run(program)["default"]


def _csv(table: DataFrame, path: str, header: bool = True) -> None:
    """Cells as they are; Spark's writer would cut white space and control characters at their ends."""
    table.write.csv(path, header=header, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _through(fmt: str, program: str, name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's declared columns written to a file of a format, and read again by the program.

    CSV cannot tell a null string from an empty one: a declared column ``no_<name>`` says where another is null.
    """
    columns = [c.name for c in next(s for s in parse(program).statements if isinstance(s, Input) and s.name == name).columns]
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    table = table.select(*(F.col(c) if c in table.columns else F.col(c.removeprefix("no_")).isNull().alias(c) for c in columns))
    path = f"{Store(spark).root}/{name}.{fmt}"
    if fmt == "csv":
        _csv(table, path)
    else:
        table.write.json(path, ignoreNullFields=False)
    return Session(spark).bind(name, path, fmt, unique=set(columns) >= KEYS[name]).run(program)["default"]


#: name -> (format, program, table, SQL)
SOURCES: dict[str, tuple[str, str, str, str]] = {
    "csv_source": ("csv", CUSTOMER + "?- customer(C, N, K, B, S).", "customer", 'SELECT c_custkey AS "C", c_name AS "N", CAST(c_nationkey AS BIGINT) AS "K", c_acctbal AS "B", c_mktsegment AS "S" FROM customer'),
    "jsonl_source": ("jsonl", SUPPLIER + "?- supplier(S, N, K, B).", "supplier", 'SELECT s_suppkey AS "S", s_name AS "N", CAST(s_nationkey AS BIGINT) AS "K", s_acctbal AS "B" FROM supplier'),
    "csv_text": ("csv", "input predicate documents(doc_id: integer?, text: string, lang: string, no_lang: boolean).\nn(L, N, count(*), sum(length(T))) :- documents(_, T, L, N).\nm(L, C, S) :- n(L, false, C, S).\nm(null, C, S) :- n(_, true, C, S).\n?- m(L, C, S).", "documents", 'SELECT lang AS "L", count(*) AS "C", CAST(sum(length(coalesce(text, \'\'))) AS BIGINT) AS "S" FROM documents GROUP BY 1'),
}


def two_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two instances of one module, by named export and by its query, whose wired inputs differ."""
    program = TURNS + TURN_EDGES + 'back(C, Y, X) :- e(C, X, Y).\n'
    program += 'input predicate t(c: integer, x: integer, y: integer) := tc from "reach.dl"(edge = e).\ninput predicate u(c: integer, x: integer, y: integer) := from "reach.dl"(edge = back).\n?- t(C, X, Y), u(C, Y, X).'
    session = Session(spark, resolve=MODULES.__getitem__)
    session.bind("conversations", spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return session.run(program)["default"]


def directory_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An input that nothing binds: a folder holds a file of its name."""
    root = Store(spark).root
    _csv(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), f"{root}/supplier.csv")
    return Session(spark, root).run(SUPPLIER + "?- supplier(S, N, K, B).")["default"]


def bound_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path and a format that the program itself names; the file begins with data."""
    path = f"{Store(spark).root}/rows"
    _csv(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path, header=False)
    return Session(spark, csv_header=False).run(f'input predicate supplier(a: integer, b: string, c: integer, d: float) := "{path}" as csv.\n?- supplier(S, N, K, B).')["default"]


def structural_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose declared shape is checked, and whose fields are then typed."""
    path = f"{Store(spark).root}/rec.jsonl"
    spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).write.json(path)
    return Session(spark).bind("rec", path, "jsonl").run('input predicate rec(r: {key: integer, name: string, age?: integer}).\nout(R["key"] + 1, R["name"] + "!") :- rec(R).\n?- out(K, N).')["default"]


def iteration_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursion cut off after two rounds: what was derived up to there."""
    session = Session(spark, max_iterations=2).bind("conversations", spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return session.run(PROGRAMS["tc_linear"][0])["default"]


def round_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each round of a recursion adds."""
    events: list[dict] = []
    session = Session(spark, trace=events.append).bind("conversations", spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    session.run(PROGRAMS["tc_linear"][0])
    rows = [(e["round"], n) for e in events if e["kind"] == "round" for n in e["new"].values() if n]
    return spark.createDataFrame(rows, "round long, rows long")


def growing_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program that grows by chunks: inputs and edges first, then the closure, then a query."""
    session = Session(spark).bind("conversations", spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    growing = Incremental(session)
    growing.add(TURNS + TURN_EDGES)
    growing.add("tc(C, X, Y) :- e(C, X, Y).\ntc(C, X, Z) :- tc(C, X, Y), e(C, Y, Z).")
    return growing.add("?- tc(C, X, Y).")["default"]


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that break a constraint, in place of the error that ``run`` raises."""
    program = CUSTOMER + "!- customer(C, _, _, B, _), B < 0.0."
    session = Session(spark).bind("customer", spark.read.parquet(f"{sf_dir}/customer.parquet"))
    core = session.compile(program)
    session._run(core, check=False)
    return session.violations(core, core.constraints[0])


JSON_SQL = 'SELECT CAST(n_nationkey AS BIGINT) AS "K", n_name AS "N" FROM nation'
MERMAID_SQL = "SELECT 'r' || n_regionkey AS \"R\", 'n' || n_nationkey AS \"N\", n_name AS \"L\" FROM nation"


def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as one JSON document, iterated."""
    path = f"{Store(spark).root}/nation.json"
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    nation.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name")))).coalesce(1).write.text(path)
    program = "input predicate nation(doc: value).\n?- nation(D), array_element(D, _, E), K = as_integer(E[\"n_nationkey\"]), N = as_string(E[\"n_name\"])."
    return Session(spark).bind("nation", path, "json").run(program)["default"].select("K", "N").distinct()


def mermaid_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as a diagram: an edge from each one's region, with its name."""
    path = f"{Store(spark).root}/nation.mmd"
    line = F.concat(F.lit("  r"), "n_regionkey", F.lit(" -->|"), "n_name", F.lit("| n"), "n_nationkey")
    edges = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("value"))
    edges.select(F.concat(F.lit("graph TD\n"), "value")).coalesce(1).write.text(path)
    return Session(spark).bind("nation", path, "mmd").run("input predicate nation(a: string, b: string, l: string).\n?- nation(R, N, L).")["default"]


SUPPLIER_SQL = 'SELECT s_suppkey AS "S", s_name AS "N", CAST(s_nationkey AS BIGINT) AS "K", s_acctbal AS "B" FROM supplier'
_STEPS = "WITH RECURSIVE e AS (SELECT DISTINCT a.conv_id c, a.turn x, b.turn y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), tc AS (SELECT c, x, y, 1 n FROM e UNION SELECT tc.c, tc.x, e.y, n + 1 FROM tc JOIN e ON tc.c = e.c AND tc.y = e.x) "
#: name -> (function, SQL)
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "modules": (modules, TURN_CLOSURE),
    "two_modules": (two_modules, TURN_CLOSURE),
    "directory_source": (directory_source, SUPPLIER_SQL),
    "bound_source": (bound_source, SUPPLIER_SQL),
    "structural_input": (structural_input, "SELECT c_custkey + 1 AS \"K\", c_name || '!' AS \"N\" FROM customer"),
    "iteration_cap": (iteration_cap, _STEPS + 'SELECT c AS "C", x AS "X", y AS "Y" FROM tc WHERE n <= 3'),
    "round_trace": (round_trace, _STEPS + "SELECT CAST(n - 1 AS BIGINT) AS round, count(*) AS rows FROM tc GROUP BY n"),
    "growing_program": (growing_program, TURN_CLOSURE),
    "json_source": (json_source, JSON_SQL),
    "mermaid_source": (mermaid_source, MERMAID_SQL),
    "violations": (violations, 'SELECT c_custkey AS "C", c_acctbal AS "B" FROM customer WHERE c_acctbal < 0'),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: partial(run, program, label) for name, (program, label, _) in PROGRAMS.items()}
    found |= {name: partial(_through, fmt, program, table) for name, (fmt, program, table, _) in SOURCES.items()}
    return found | {name: query for name, (query, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for name, (_, _, sql) in PROGRAMS.items() if sql is not None}
    found |= {name: sql for name, (_, _, _, sql) in SOURCES.items()}
    return found | {name: sql for name, (_, sql) in OTHERS.items()}
