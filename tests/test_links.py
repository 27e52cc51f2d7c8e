import pytest
from helpers import asked, doc, docs
from pyspark.sql import functions as F

from schemaloom.config import RetrievalConfig
from schemaloom.functions import jsontext as J
from schemaloom.functions import links as L
from schemaloom.operators import links as ops
from schemaloom.operators import retrieval as R

SHOP = doc(
    {"Orders": ["OrderID", "Total"], "Customer": ["CustID", "Name", "C2"], "Empty": []},
    pk=["Orders.OrderID"],
)


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def items(spark, text):
    obj = J.entries_last_wins(J.unwrap_links(J.first_json_object(F.lit(text))))
    rows = value(spark, F.transform(obj, lambda p: F.struct(p.key, J.string_items(p.value).alias("names"))))
    return None if rows is None else {r.key: r.names for r in rows}


@pytest.mark.parametrize(
    "text, found",
    [
        ('{"a":["x"]}', {"a": ["x"]}),
        ('  {"a":["x"]}  ', {"a": ["x"]}),
        ('Answer: {"a":["x"]} and more', {"a": ["x"]}),
        ('```json\n{"a":["x"]}\n```', {"a": ["x"]}),
        ('{"a":["x"]} {"b":["y"]}', {"a": ["x"]}),
        ('[{"a":["x"]}]', {"a": ["x"]}),
        ('{"a":["x"', None),
        ('{"a":["x"],}', None),
        ('{"a":[01]}', None),
        ('{"a":"x\ty"}', None),
        ('{a:["x"]}', None),
        ("{'a':['x']}", None),
        ('{"a":["x"] /* c */}', None),
        ("no braces", None),
        ("", None),
        ("{", None),
        ("{ not json } then {\"a\":[\"x\"]}", {"a": ["x"]}),
        ('{"bad":[} {"a":{"b":1}}', {"a": ["b"]}),
        ('{"a":"{\\"b\\":1}"}', {"a": ['{"b":1}']}),
        ('{"schema_links":{"a":["x"]}}', {"a": ["x"]}),
        ('{"schema_links":["x"],"a":["y"]}', {"schema_links": ["x"], "a": ["y"]}),
        ('{"T1":"C1"}', {"T1": ["C1"]}),
        ('{"T1":{"C1":1,"C2":2}}', {"T1": ["C1", "C2"]}),
        ('{"T1":null}', {"T1": []}),
        ('{"T1":7}', {"T1": []}),
        ('{"T1":["C1",2,null,true,["C2"]]}', {"T1": ["C1"]}),
        ('{"a":["x"],"a":["y"]}', {"a": ["y"]}),
        ('{"a":["x"],"A":["y"]}', {"a": ["x"], "A": ["y"]}),
        ('{"é":["ü"]}', {"é": ["ü"]}),
        ("{}", {}),
    ],
)
def test_first_json_object(spark, text, found):
    assert items(spark, text) == found


def parsed(spark, response, c=RetrievalConfig(max_tables=2, include_join_neighbors=False)):
    rows = asked(spark, [(1, "k", "customer name")])
    offered = R.candidate_schema(rows, docs(spark, {"k": SHOP}), c, 10)
    row = ops.parse_links(offered.withColumn("response", F.lit(response)), "response").first()
    return [(e.table_name, e.cols) for e in row.parsed]


def test_candidate_ids_of_the_fixture(spark):
    rows = asked(spark, [(1, "k", "customer name")])
    offered = R.candidate_schema(
        rows, docs(spark, {"k": SHOP}), RetrievalConfig(max_tables=2, include_join_neighbors=False), 10
    )
    assert [(t.table_id, t.table_name) for t in offered.first().candidates] == [("T1", "Customer"), ("T2", "Orders")]


@pytest.mark.parametrize(
    "response, links",
    [
        ('{"T1":["C2"],"T2":[]}', [("Orders", []), ("Customer", ["Name"])]),
        ('{" t1 ":[" c1 "]}', [("Customer", ["CustID"])]),
        # An ID wins over a column spelled the same way: C2 is the second column, Name.
        ('{"Customer":["C2"]}', [("Customer", ["Name"])]),
        ('{"CUSTOMER":["name","NAME","custid"]}', [("Customer", ["CustID", "Name"])]),
        # Keys for one table are merged.
        ('{"T1":["C1"],"customer":["Name"]}', [("Customer", ["CustID", "Name"])]),
        # Tables outside the candidates resolve by name.
        ('{"Empty":[]}', [("Empty", [])]),
        ('{"T9":["C1"],"ghost":[]}', []),
        ('{"T1":["C9","ghost"]}', [("Customer", [])]),
        ('{"T1":"Name"}', [("Customer", ["Name"])]),
        ("nothing", []),
    ],
)
def test_parse_links(spark, response, links):
    assert parsed(spark, response) == links


def test_normalize_links_last_folded_key_wins(spark):
    rows = asked(spark, [(1, "k", "q")]).withColumn(
        "links", F.lit('{"customer":["name"],"ORDERS":["total","orderid"],"Customer":["CUSTID","nope"],"x":[]}')
    )
    row = ops.normalize_links(rows, docs(spark, {"k": SHOP}), "links", 10).first()
    assert [(e.table_name, e.cols) for e in row.normalized] == [("Orders", ["OrderID", "Total"]), ("Customer", ["CustID"])]


def test_validate_links_is_exact(spark):
    rows = asked(spark, [(7, "k", "q")]).withColumn(
        "links", F.from_json(F.lit('{"Orders":["Total","total"],"orders":["x"],"Empty":[]}'), L.LINKS_TYPE)
    )
    got = sorted(r.warning for r in ops.validate_links(rows, docs(spark, {"k": SHOP}), "links", 10).collect())
    assert got == [
        "question_id=7 db_id=k: column 'total' not in table 'Orders'",
        "question_id=7 db_id=k: table 'Empty' not in schema",
        "question_id=7 db_id=k: table 'orders' not in schema",
    ]


def canonical(spark, text, is_gold=False, d=SHOP):
    rows = asked(spark, [(1, "k", "q")]).withColumn("links", F.lit(text))
    c = ops.canonical_links(rows, docs(spark, {"k": d}), "links", 10, is_gold).first().canonical
    pairs = {tuple(p.split(L.PAIR_SEPARATOR)) for p in c.pairs}
    return set(c.tables), pairs, c.bad_tables, c.bad_columns


def test_canonical_sets(spark):
    text = '{"orders":["TOTAL","ghost",5,null],"Ghost":["a"],"customer":"Name"}'
    tables, pairs, bad_tables, bad_columns = canonical(spark, text)
    assert tables == {"Orders", "__hallu__:ghost", "Customer"}
    assert pairs == {
        ("Orders", "Total"),
        ("Orders", "__hallu__:ghost"),
        ("Orders", "__hallu__:5"),
        ("Orders", "__hallu__:none"),
        ("__hallu__:ghost", "__hallu__:a"),
    }
    assert (bad_tables, bad_columns) == (1, 4)
    assert canonical(spark, text, is_gold=True)[:2] == ({"Orders", "Customer"}, {("Orders", "Total")})


def test_canonical_sets_count_repeats_but_hold_them_once(spark):
    tables, pairs, bad_tables, bad_columns = canonical(spark, '{"Orders":["x","X","Total","total"],"ORDERS":["Total"]}')
    assert tables == {"Orders"} and len(pairs) == 2 and (bad_tables, bad_columns) == (0, 2)
    assert canonical(spark, "not an object") == (set(), set(), 0, 0)
    folded = doc({"T": ["Name", "NAME"]})
    assert canonical(spark, '{"t":["name"]}', d=folded)[1] == {("T", "NAME")}


def test_rendering(spark):
    links = F.from_json(F.lit('{"b":["z","a"],"a\\"q":[]}'), L.LINKS_TYPE)
    assert value(spark, L.normalized_json(links)) == '{"a\\"q": [], "b": ["a", "z"]}'
    assert value(spark, L.table_count(links)) == 2
    assert value(spark, L.column_count(links)) == 2
    assert value(spark, L.has_empty_table(links)) is True


def test_target_json(spark):
    rows = asked(spark, [(1, "k", "customer name")]).withColumn(
        "links", F.from_json(F.lit('{"orders":["Total"],"CUSTOMER":["c2","CustID"],"Empty":[]}'), L.LINKS_TYPE)
    )
    c = RetrievalConfig(max_tables=2, max_columns_per_table=2, min_columns_per_table=1, include_join_neighbors=False)
    df = R.candidate_schema(rows, docs(spark, {"k": SHOP}), c, 10)
    made = lambda fmt: df.select(L.target_json(F.col("links"), F.col("candidates"), F.col("tables"), fmt)).first()[0]
    # C2 was pruned: IDs cannot name it, names can. Empty is no candidate.
    assert made("ids") == '{"T2":["C2"],"T1":["C1"]}'
    assert made("names") == '{"Orders":["Total"],"Customer":["CustID","C2"]}'
