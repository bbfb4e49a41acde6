import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import confidence as C
from tessera.operators import discover as D
from tessera.operators import inclusion as I
from tessera.sources import catalog
from tests.fixtures_schemas import SCHEMAS, definitions

GOLDEN = {tuple(e.split(">")) for e in "orders>customer lineitem>orders lineitem>part lineitem>supplier customer>nation supplier>nation nation>region labels>documents".split()}


def table(name, *cols):
    return {"name": name, "columns": [{"name": c.rstrip("*").split()[0], "type": (c.rstrip("*").split() + ["NUMBER"])[1], "is_primary_key": c.endswith("*")} for c in cols]}


def pairs(found):
    return {(e.left, e.right) for e in found.edges}


@pytest.mark.parametrize("name", SCHEMAS)
def test_reference_schemas(name):
    text, edges, least = SCHEMAS[name]
    found = {f"{a}>{b}".lower() for a, b in pairs(D.discover_from_definitions(definitions(text), min_confidence=least, max_relationships=50))}
    assert {e for e in edges.split() if e[0] != "!"} <= found and not {e[1:] for e in edges.split() if e[0] == "!"} & found


@pytest.mark.parametrize("name", SCHEMAS)
def test_order_of_tables_and_columns_doesnt_matter(name):
    defs = definitions(SCHEMAS[name][0])
    mixed = [dict(t, columns=list(reversed(t["columns"]))) for t in reversed(defs)]
    a, b = (D.discover_from_definitions(d, min_confidence=0.5) for d in (defs, mixed))
    assert {(e.left, e.right, e.via) for e in a.edges} == {(e.left, e.right, e.via) for e in b.edges}


def test_generic_and_bare_ids():
    assert not pairs(D.discover_from_definitions([table("table_a", "id*", "value"), table("table_b", "id*", "value")]))
    assert not pairs(D.discover_from_definitions([table("orders", "id*", "order_date DATE"), table("products", "id*", "order_reference")], min_confidence=0.4))
    hub = D.discover_from_definitions([table("users", "id*", "name STRING"), table("posts", "id*", "user_id"), table("comments", "id*", "post_id", "user_id")], min_confidence=0.6)
    assert [(e.left, e.right, e.via) for e in hub.edges] == [("POSTS", "USERS", "COMMENTS")] and "_via_" in hub.edges[0].name
    trap = D.discover_from_definitions([table("orders", "order_id*", "customer_id"), table("products", "product_id*", "order_reference STRING")])
    assert ("PRODUCTS", "ORDERS") not in pairs(trap)


def test_best_match_and_two_part_names():
    best = D.discover_from_definitions([table("customer", "c_custkey*", "c_nationkey"), table("nation", "n_regionkey", "n_nationkey*", "n_name STRING")])
    assert [(e.left, e.right, e.keys) for e in best.edges] == [("CUSTOMER", "NATION", [("c_nationkey", "n_nationkey")])]
    named = D.discover_from_definitions([table("demo.sales.orders", "order_id*", "customer_id"), table("sales.customers", "customer_id*")])
    assert pairs(named) == {("ORDERS", "CUSTOMERS")} and named.tables == ["CUSTOMERS", "ORDERS"]


def test_two_roles_are_two_edges():
    found = D.discover_from_definitions([table("orders", "order_id*", "bill_to_address_id", "ship_to_address_id"), table("address", "address_id*")])
    assert len(found.edges) == 2 and all(len(e.keys) == 1 for e in found.edges) and len({e.name for e in found.edges}) == 2


def test_composite_key_edge():
    found = D.discover_from_definitions([table("plan", "contract_id*", "period_no*"), table("record", "record_id*", "contract_id", "period_no")])
    assert [e.keys for e in found.edges if e.right == "PLAN"] == [[("contract_id", "contract_id"), ("period_no", "period_no")]]


def test_self_reference_needs_values():
    edge = D.discover_from_definitions(definitions("employee(employee_id INT*=1/2/3/4, manager_id INT=1/1/2/NULL)")).edges[0]
    assert edge.is_self and edge.keys == [("manager_id", "employee_id")] and edge.join_type == "left_outer"
    found = D.discover_from_definitions(definitions("employee(employee_id INT*, manager_id INT)"))
    assert not found.edges and found.missed[0]["column"] == "manager_id"


def test_zero_overlap_vetoes():
    apart = "orders(order_id INT=1/2/3, customer_id INT=900/901/902) customers(customer_id INT=1/2/3)"
    assert not D.discover_from_definitions(definitions(apart)).edges and D.discover_from_definitions(definitions(apart.replace("900", "2"))).edges


def test_join_types_and_cardinality_without_data():
    found = D.discover_from_definitions(definitions("orders(order_id INT*, customer_id INT=1/NULL/2) customers(customer_id INT*)"))
    assert found.edges[0].join_type == "left_outer" and found.edges[0].cardinality == "many_to_one"
    one = D.discover_from_definitions([table("user", "user_id*", "name STRING"), table("user_settings", "user_id*", "theme STRING")])
    assert [(e.left, e.right, e.cardinality) for e in one.edges] == [("USER", "USER_SETTINGS", "one_to_one")]


def test_caps_flags_and_bands():
    defs = definitions(SCHEMAS["tpch"][0])
    found = D.discover_from_definitions(defs, max_relationships=3)
    assert len(found.edges) == 3 and found.limited_by_relationships and found.edges[0].confidence >= found.edges[-1].confidence
    assert D.discover_from_definitions(defs, max_tables=2).limited_by_tables and D.discover_from_definitions(defs, timeout_seconds=-1).timed_out
    assert [D.band(x) for x in (0.9, 0.7, 0.5, 0.3, 0.1)] == ["very_high", "high", "medium", "low", "very_low"]


def test_bad_definitions():
    for bad in ("x", [{"columns": []}], [{"name": "t", "columns": []}], [{"name": "t", "columns": [{"type": "INT"}]}], [{"name": "a.b.c.d", "columns": [{"name": "x"}]}]):
        with pytest.raises(catalog.DefinitionError):
            catalog.tables_from_definitions(bad)
    t = catalog.tables_from_definitions([{"table": "w.s.t", "columns": [{"column_name": "a", "is_primary": "yes", "values": ["1", "1", None]}]}])[0]
    assert (t.database, t.schema, t.name) == ("w", "s", "T") and t.columns[0].data_type == "STRING" and t.columns[0].is_primary_key and t.columns[0].uniqueness == 0.5


def test_driver_tables_precision_and_recall(spark, small):
    names = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations embeddings".split()
    found = D.discover_from_frames(catalog.parquet_tables(spark, small, names))
    assert {(e.left, e.right) for e in found.edges if not e.via} == GOLDEN
    assert all(e.evidence["orphan_rows"] == 0 and e.join_type == "inner" for e in found.edges if not e.via)
    df = found.dataframe(spark)
    assert df.filter("confidence < 0.5").count() == 0 and df.count() == len(found.edges)


def test_random_schemas_with_known_truth(spark):
    rng = random.Random(4)
    words = "apple banana cherry falcon guitar hammer island jacket kettle ladder".split()
    frames, truth = {}, set()
    for i, w in enumerate(words):
        n = 40 + i
        cols = [F.col("id").alias(f"{w}_id")]
        for p in rng.sample(words[:i], min(i, rng.randrange(3))):
            cols.append((F.col("id") * 7 % (40 + words.index(p))).alias(f"{p}_id"))
            truth.add((f"{w}s", f"{p}s"))
        frames[f"{w}s"] = spark.range(n).select(*cols, F.rand(1).alias("amount"))
    found = D.discover_from_frames(frames)
    assert {(e.left, e.right) for e in found.edges if not e.via and not e.is_self} == truth
    assert {e.cardinality for e in found.edges if not e.via} <= {"many_to_one", "one_to_one"}


def test_evidence_decides(spark):
    orders = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 77)], "order_id int, customer_id int")
    customers = spark.createDataFrame([(1,), (2,)], "customer_id int")
    e = D.discover_from_frames({"orders": orders, "customers": customers}).edges[0]
    assert e.join_type == "left_outer" and e.cardinality == "many_to_one" and e.evidence["null_rows"] == 1 and e.evidence["orphan_rows"] == 1
    twice = spark.createDataFrame([(1,), (1,), (2,)], "customer_id int")
    found = D.discover_from_frames({"orders": orders, "customers": twice})
    assert not found.edges and "not unique" in found.missed[0]["reason"]


def test_inclusion_by_brute_force(spark):
    rng = random.Random(9)
    child = [(rng.choice([None, *range(20)]),) for _ in range(200)]
    parent = [(rng.choice([None, *range(10, 40)]),) for _ in range(60)]
    r = I.inclusion(spark.createDataFrame(child, "a int"), ["a"], spark.createDataFrame(parent, "b long"), ["b"]).first()
    c, p = [x for (x,) in child if x is not None], [x for (x,) in parent if x is not None]
    assert (r.rows_child, r.null_rows, r.ndv_child, r.ndv_parent, r.ndv_union) == (200, 200 - len(c), len(set(c)), len(set(p)), len(set(c) | set(p)))
    assert r.orphan_keys == len(set(c) - set(p)) and r.orphan_rows == sum(x not in p for x in c) and r.max_child == max(map(c.count, c)) and r.max_parent == max(map(p.count, p))
    nothing = spark.createDataFrame([], "a int")
    assert I.inclusion(nothing, ["a"], nothing, ["a"]).first().coverage is None
    two = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (None, 3)], "a int, b int")
    assert I.composite_uniqueness(two, ["a", "b"]).first()[:2] == (3, 2)


def test_can_contain():
    p = I.ColumnProfile("integer", 100, 100, 100, "1", "100")
    assert I.can_contain(I.ColumnProfile("integer", 500, 50, 500, "3", "90"), p) and I.can_contain(None, p)
    for child in (I.ColumnProfile("integer", 9, 1, 9, "3", "3"), I.ColumnProfile("integer", 900, 106, 900, "1", "100"), I.ColumnProfile("integer", 9, 5, 9, "0", "9"), I.ColumnProfile("string", 9, 5, 9)):
        assert not I.can_contain(child, p)
    assert not I.can_contain(p, I.ColumnProfile("integer", 100, 50, 100, "0", "200"))


def test_reports_and_scores(spark):
    defs = definitions(SCHEMAS["tpch"][0])
    found = D.discover_from_definitions(defs, prefilter=True)
    assert D.evaluate(found, {("orders", "customer")})["recall"] == 1.0
    told = found.detailed()
    assert "FROM `ORDERS` JOIN `CUSTOMER` ON `ORDERS`.`o_custkey` = `CUSTOMER`.`c_custkey`" in {e["suggested_join_sql"] for e in told["relationships"]} and told["summary"]["relationships"] == len(found.edges)
    assert found.missed_dataframe(spark).count() == len(found.missed)
    assert D.sample_confidence([str(i % 5) for i in range(30)], [str(i) for i in range(30)]) == 1.0 and D.sample_confidence(["1"], ["1"]) == 0.0


def test_bridge_joins_are_sql(spark):
    found = D.discover_from_definitions(definitions(SCHEMAS["tpch"][0]))
    joins = [r["suggested_join_sql"] for r in found.detailed()["relationships"] if r["via"]]
    assert all("<" not in j for j in joins)
    hub = D.discover_from_definitions([table("student", "student_id*"), table("course", "course_id*"), table("enrolment", "student_id", "course_id")])
    sql = next(r["suggested_join_sql"] for r in hub.detailed()["relationships"] if r["via"])
    assert sql == "FROM `ENROLMENT` JOIN `COURSE` ON `ENROLMENT`.`course_id` = `COURSE`.`course_id` JOIN `STUDENT` ON `ENROLMENT`.`student_id` = `STUDENT`.`student_id`"


def test_confidence_is_the_sum_of_its_factors():
    t = {x.name: x for x in catalog.tables_from_definitions([table("fact_sales", "sale_id*", "customer_id", "id", "other"), table("dim_customer", "customer_id*", "id")])}
    one = lambda pairs, **m: C.confidence(t["FACT_SALES"], t["DIM_CUSTOMER"], pairs, roles=("fact", "dimension"), keys=(("sale_id",), ("customer_id",)), **m)
    good = {f: p for f, p, _ in one([("customer_id", "customer_id")], unique=(0.2, 1.0), values=50).factors}
    assert good == {"key": 0.3, "name": 0.35, "fk_pattern": 0.1, "aligned": 0.05, "uniqueness": 0.2, "type": 0.1, "identical": 0.1, "role": 0.15, "limit": pytest.approx(-0.35)}
    bad = one([("sale_id", "customer_id")])
    assert ("misaligned" in {f for f, _, _ in bad.factors}) and bad.value <= 0.15 + 0.1 + 0.15
    assert {f: p for f, p, _ in one([("id", "id")]).factors}["generic"] == -0.15
    twice = one([("customer_id", "customer_id"), ("customer_id", "id")])
    assert "inconsistent" in {f for f, _, _ in twice.factors} and not C.consistent([("a", "x"), ("a", "y")]) and C.consistent([("a", "x"), ("b", "y")])
    d = C.domain(t["FACT_SALES"], t["DIM_CUSTOMER"], [("customer_id", "customer_id")], ("fact", "dimension"), (("sale_id",), ("customer_id",)))
    assert {f: p for f, p, _ in d.factors} == {"business_pair": 0.25, "usual_fk": 0.15, "convention": 0.2, "mentions": 0.1, "schema_pattern": 0.2}


def test_pair_scores_and_thresholds():
    assert C.pair_score("o_custkey", "c_custkey") == pytest.approx(0.95 + 0.5 + 0.1) and C.pair_score("o_custkey", "c_custkey", 1.0) == pytest.approx(2.15)
    assert C.least_score("o_custkey", "c_custkey") == 0.3 and C.least_score("sender_account_id", "account_id") == 0.3 and C.least_score("a_x", "b_y") == 0.6 and C.least_score("a_x", "b_y", 0.7) == 0.3
    assert C.related_entities("account", "sender_account") and not C.related_entities("order", "product")


def test_composite_keys():
    use = C.key_use(["ORDER_ID", "LINE_ID"], ("order_id", "line_id"))
    assert use.coverage == 1.0 and use.whole_composite and not use.partial and use.identifiers == 2
    assert C.key_use(["ORDER_ID"], ("order_id", "line_id")).partial
    pairs = [("a", "x"), ("b", "y"), ("c", "z")]
    assert C.composite_passes(pairs, (), ("x", "y", "z")) and not C.composite_passes(pairs, (), ("x", "y", "z", "w")) and C.composite_passes(pairs[:2], (), ("x", "y", "z")) and not C.composite_passes(pairs[:2], (), ())
    assert C.composite_cardinality(pairs, (), ("x", "y", "z")) == "many_to_one" and C.composite_cardinality(pairs, ("a", "b", "c"), ()) == "one_to_many" and C.composite_cardinality(pairs, (), ()) is None
    assert C.composite_cardinality(pairs, (), (), (0.3, 0.95)) == "many_to_one"
    assert C.reversed_better("t", "u", [("id", "x")], ("id",), ()) and C.reversed_better("dim_x", "fact_y", [("a", "b")], (), ()) and not C.reversed_better("fact_y", "dim_x", [("a", "b")], (), ())


def test_composite_keys_are_found_without_declarations(spark):
    n = lambda e: e.selectExpr("int(id % 40) AS order_id", "int(id div 40) AS line_number", "id * 1.5 AS amount")
    frames = {"orders": spark.range(40).selectExpr("int(id) AS order_id", "id * 2 AS total"), "lines": n(spark.range(120)), "shipments": spark.range(60).selectExpr("int(id) AS shipment_id", "int(id % 40) AS order_id", "int(id div 40) AS line_number")}
    found = D.discover_from_frames(frames)
    edge = next(e for e in found.edges if e.left == "shipments" and e.right == "lines" and len(e.keys) == 2)
    assert edge.keys == [("line_number", "line_number"), ("order_id", "order_id")] and edge.cardinality in ("many_to_one", "one_to_one") and found.primary_keys["lines"].columns == ("line_number", "order_id")
    twice = dict(frames, lines=frames["lines"].union(frames["lines"]))
    assert not [e for e in D.discover_from_frames(twice).edges if len(e.keys) == 2]


def test_edges_settle():
    e = lambda a, b, s=1.0: D.Edge(a, b, [("x_id", "x_id")], s)
    key = lambda t: D.Key(t, ("x_id",), "name")
    assert [(x.left, x.right) for x in D._settle([e("a", "b"), e("b", "a", 0.5), e("a", "b")], {})] == [("a", "b")]
    assert [(x.left, x.right) for x in D._settle([e("a", "b")], {"a": key("a")})] == [("b", "a")]


def test_self_reference_of_whole_tables(spark):
    staff = spark.range(50).selectExpr("int(id) AS employee_id", "CASE WHEN id > 0 THEN int(id div 4) END AS manager_id")
    found = D.discover_from_frames({"employee": staff})
    assert [(e.is_self, e.join_type) for e in found.edges] == [(True, "left_outer")]
    apart = staff.withColumn("manager_id", F.col("manager_id") + 1000)
    assert not D.discover_from_frames({"employee": apart}).edges


def test_pruning_changes_nothing_and_time_is_kept(spark, small, monkeypatch):
    f = catalog.parquet_tables(spark, small, "region nation customer supplier part orders lineitem".split())
    want = {(e.left, e.right) for e in D.discover_from_frames(f).edges}
    monkeypatch.setattr(D, "PRUNE_FROM", 0)
    assert {(e.left, e.right) for e in D.discover_from_frames(f).edges} == want
    late = D.discover_from_frames(f, timeout_seconds=0.05)
    assert late.timed_out
