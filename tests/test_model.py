import json

import pytest
import yaml
from pyspark.sql import functions as F

from tessera.operators import filters as SF
from tessera.operators import profile as P
from tessera.operators.fingerprint import fingerprint
from tessera.plans import build, enrich, logical, parse, partner, validate
from tessera.plans import model as M
from tessera.plans.model import BaseTable, Column, Metric, RelationKey, Relationship, SemanticModel, Table
from tessera.plans.query import PathError, Planner, SemanticQuery, bridge_join, choose_path, paths, run_verified_queries
from tessera.queries import DBT, frames, tpch_model
from tessera.sources import catalog, sinks
from tessera.streaming.incremental import run_to_folder, windowed_profile
from tests.fixtures_schemas import definitions

GOOD = """
name: shop
tables:
  - name: orders_table
    base_table: {database: d, schema: s, table: orders}
    dimensions:
      - {name: order_state, expr: state, data_type: TEXT, sample_values: [1, true, 2.5]}
    facts:
      - {name: amount_paid, expr: paid, data_type: NUMBER}
    filters:
      - {name: by_udf, expr: "my_udf(col1, col2)"}
      - {name: by_window, expr: "COUNT(i) OVER (PARTITION BY p ORDER BY o) > 1"}
"""


def test_yaml_round_trip_and_strictness(spark):
    m = M.from_yaml(GOOD)
    assert m.tables[0].dimensions[0].sample_values == ["1", "true", "2.5"] and M.from_yaml(M.to_yaml(m)) == m
    assert not validate.problems(spark, m)
    for bad in (GOOD.replace("table: orders}", "x: 1}"), GOOD + "surprise: 1\n", GOOD.replace("name: shop", "title: shop"), "a: [", GOOD.replace("facts:", "facts: 3\n    x:")):
        with pytest.raises(M.ModelError):
            M.from_yaml(bad)
    for bad, what in ((GOOD.replace('"my_udf(col1, col2)"', '"(cogs > 100"'), "SQL"), (GOOD.replace("TEXT", "VARIANT"), "VARIANT"), (GOOD.replace("order_state", "select"), "usable name"), (GOOD.replace("order_state", "two words"), "usable name")):
        assert any(what in p for p in validate.problems(spark, M.from_yaml(bad)))
    twice = GOOD + "verified_queries:\n" + "  - {name: a, question: q, sql: SELECT 1}\n" * 2
    assert any("twice" in p for p in validate.problems(spark, M.from_yaml(twice)))
    assert M.BaseTable.parse("a.b.c") == M.BaseTable("a", "b", "c")
    with pytest.raises(ValueError):
        M.BaseTable.parse("a.b")


def test_context_budget():
    m = M.SemanticModel("m", tables=[M.Table("t", M.BaseTable("", "", "t"), dimensions=[M.Column("a", "a", sample_values=["x" * 1000] * 50)])])
    assert validate.check_context(m) is None
    m.description = "y" * 200_000
    assert "tokens" in validate.check_context(m)
    with pytest.raises(M.ModelError):
        validate.check_context(m, throw=True)


def test_binding(spark, small):
    f = frames(spark, small)
    assert not validate.problems(spark, tpch_model()) and not validate.binding_problems(spark, tpch_model(), f)
    bad = tpch_model()
    bad.table("orders").metrics.append(M.Metric("oops", "sum(no_such_column)"))
    assert validate.binding_problems(spark, bad, f)
    assert validate.validate(spark, M.to_yaml(tpch_model()), f) == tpch_model()


def test_column_format():
    t = M.Table("t", M.BaseTable("", "", "t"), dimensions=[M.Column("d", "d")], time_dimensions=[M.Column("w", "w")], measures=[M.Column("m", "m")], facts=[M.Column("f", "f")])
    assert [(c.name, c.kind) for c in M.column_format(t).columns] == [("d", "dimension"), ("w", "time_dimension"), ("m", "measure"), ("f", "fact")]
    assert M.column_format(M.column_format(t)) == M.column_format(t)
    t.columns.append(M.Column("x", "x"))
    with pytest.raises(M.ModelError):
        M.column_format(t)


def test_editing():
    m = tpch_model()
    m.put_column("part", "dimensions", M.Column("p_new", "p_name"))
    assert m.table("part").field("P_NEW")
    m.drop_column("part", "p_new")
    m.drop_table("nation")
    assert not m.table("part").field("p_new") and not [r for r in m.relationships if "nation" in (r.left_table, r.right_table)]
    with pytest.raises(KeyError):
        m.put_relationship(M.Relationship("r", "part", "nowhere"))
    m.put_verified_query(M.VerifiedQuery("q", "?", "SELECT 1"))
    m.put_verified_query(M.VerifiedQuery("q", "?", "SELECT 2"))
    assert [q.sql for q in m.verified_queries] == ["SELECT 2"]


def test_placeholders():
    assert M.mark_placeholders("a: __\nb: x__") == "a: ''" + M.PLACEHOLDER + "\nb: x__"
    assert yaml.safe_load(M.mark_placeholders("description: __")) == {"description": ""}


@pytest.mark.parametrize("expr, want", [("foo", False), ("sum(foo)", True), ("sum(foo)/sum(bar)", True), ("avg(foo)", True), ("foo + bar", False), ("sum(foo) over (partition by bar)", False)])
def test_aggregates(spark, expr, want):
    assert parse.is_aggregate(spark, expr) == want


def test_references_and_selects(spark):
    assert parse.references(spark, "sum(B.x) + `Q y` / a") == ["Q y", "a", "b.x"]
    t = M.Table("t", M.BaseTable("d", "s", "t"), columns=[M.Column("cost", "cst"), M.Column("clicks", "clcks"), M.Column("cpc", "sum(cst) / sum(clcks)")])
    assert {c.name for c in logical.with_passthroughs(spark, t).columns} == {"cost", "clicks", "cpc", "cst", "clcks"}
    w = M.Table("t", M.BaseTable("d", "s", "t"), columns=[M.Column("d1", "d1"), M.Column("total", "sum(d2)"), M.Column("run", "sum(d3) over (partition by d1)")])
    assert logical.generated_selects(spark, w, 5) == ["SELECT sum(d2) AS total FROM d.s.t LIMIT 5", "SELECT d1, sum(d3) over (partition by d1) AS run FROM d.s.t LIMIT 5"]
    assert [c.name for c in logical.direct_columns(spark, t)] == ["cost", "clicks"]
    with pytest.raises(M.ModelError):
        logical.cte_body(spark, M.Table("t", M.BaseTable("", "", "t")))


def test_with_parts(spark):
    m = M.SemanticModel("m", tables=[M.Table("a", M.BaseTable("", "s", "a"), columns=[M.Column("x", "x")])])
    assert logical.expand_logical_tables(spark, "WITH q AS (SELECT 1) SELECT * FROM q, __a", m) == "WITH __a AS (SELECT x FROM s.a), q AS (SELECT 1) SELECT * FROM q, __a"
    with pytest.raises(M.ModelError):
        logical.expand_logical_tables(spark, "WITH __a AS (SELECT 1) SELECT 1", m)
    for sql, want in (
        ("WITH __a AS (SELECT * FROM t) SELECT * FROM __a", "SELECT * FROM __a"),
        ("WITH __b AS (SELECT * FROM t) SELECT * FROM __b", "WITH __b AS (SELECT * FROM t) SELECT * FROM __b"),
        ("WITH __a AS (SELECT ')' FROM t), __b AS (SELECT (1)) SELECT * FROM __a", "WITH __b AS (SELECT (1)) SELECT * FROM __a"),
    ):
        assert logical.remove_logical_tables(sql, ["A"]) == want
    for bad in ("SELECT 1", "WITH q AS (SELECT 1) SELECT 1"):
        with pytest.raises(ValueError):
            logical.remove_logical_tables(bad, ["a"])
    assert logical.qualify("WITH a AS (SELECT 1) SELECT * FROM a JOIN b ON 'from b' = x.b", {"a": "d.s.a", "b": "d.s.b"}).endswith("FROM a JOIN d.s.b ON 'from b' = x.b")
    assert logical.ensure_limit("SELECT 1 ; ") == "SELECT 1 LIMIT 200" and logical.ensure_limit("SELECT 1 limit 3") == "SELECT 1 limit 3"
    assert parse.normalize_dialect("x < DATEADD('day', 5, b.y)") == "x < date_add(b.y, 5)"


def test_planner_paths_and_guards(spark, small):
    p = Planner(spark, tpch_model(), frames(spark, small))
    assert len(paths(p.model, "lineitem", "nation")) == 2
    with pytest.raises(PathError, match="several ways"):
        p.run(SemanticQuery(["lineitem.revenue"], ["nation.n_name"]))
    with pytest.raises(PathError, match="without repeating"):
        p.run(SemanticQuery(["customer.n_customers"], ["orders.o_orderstatus"]))
    assert [s.target for s in choose_path(p.model, "lineitem", "nation", ["supplier_nation"])] == ["supplier", "nation"]
    with pytest.raises(M.ModelError):
        p.run(SemanticQuery(["lineitem.nothing"]))
    one = p.run(SemanticQuery(["total_revenue", "customer.c_acctbal", "orders.open_orders"])).first()
    f = frames(spark, small)
    assert one.open_orders == f["orders"].filter("o_orderstatus = 'O'").count() and one.total_revenue > 0
    some = p.run(SemanticQuery(["orders.n_orders"], ["customer.c_mktsegment"], ["customer: c_mktsegment = 'BUILDING'"]))
    assert [r.c_mktsegment for r in some.collect()] == ["BUILDING"]


def test_bridge_and_verified_queries(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "a_id int"), spark.createDataFrame([(7,), (8,)], "b_id int")
    ab = spark.createDataFrame([(1, 7), (1, 7), (2, 8), (None, 8)], "x int, y int")
    assert sorted(tuple(r) for r in bridge_join(a, ab, b, ("x", "a_id"), ("y", "b_id")).collect()) == [(1, 7), (2, 8)]
    m = M.SemanticModel("m", verified_queries=[M.VerifiedQuery("one", "?", "SELECT 1 AS x;")])
    assert run_verified_queries(spark, m)["one"].collect()[0].x == 1


def test_build_model(spark):
    f = {
        "customers": spark.createDataFrame([(i, f"n{i}", i / 2) for i in range(1, 30)], "customer_id int, name string, loyalty_score double"),
        "orders": spark.createDataFrame([(i, 1 + i % 29, "2024-01-05", "open" if i % 2 else "closed", [1]) for i in range(60)], "order_id int, customer_id int, order_date string, status string, tags array<int>"),
    }
    told = []
    m = build.build_model(spark, f, "shop", primary_keys={"customers": ["customer_id"]}, client=enrich.Offline(), progress=lambda s, x: told.append(s))
    c, o = m.table("customers"), m.table("orders")
    assert [x.name for x in c.facts] == ["loyalty_score"] and "customer_id" in [x.name for x in c.dimensions] and c.primary_key.columns == ["customer_id"]
    assert [(x.name, x.data_type) for x in o.time_dimensions] == [("order_date", "TIMESTAMP_NTZ")] and not o.field("tags")
    assert {x.name for x in o.filters} == {"order_date_last_30_days", "status_values"} and "IN ('closed', 'open')" in next(x.expr for x in o.filters if x.name == "status_values")
    assert [(r.left_table, r.right_table, r.relationship_type) for r in m.relationships] == [("orders", "customers", "many_to_one")]
    assert c.description == "Rows of customers." and m.description.startswith("A model of") and {"tables", "relationships"} <= set(told)
    assert M.from_yaml(build.model_text(m)) == m


def test_enrichment(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 3.0)], "order_status string, total_amount double")
    t = M.Table("orders", M.BaseTable("", "", "orders"), "__", dimensions=[M.Column("order_status", "order_status", "STRING", description="mine")], facts=[M.Column("total_amount", "total_amount", "DOUBLE", description="__", synonyms=["Total"])])
    m = M.SemanticModel("m", "__", tables=[t])
    client = enrich.Scripted(
        [
            dict(
                table_description="Orders.", model_description="Sales.", business_metrics=[dict(name="GMV", description="gross value", source_columns=["total_amount"])],
                columns=[dict(name="order_status", description="theirs"), dict(name="TOTAL_AMOUNT", description="Money", synonyms=["total", "sum paid"])],
            ),
            "Here you are: " + json.dumps({"model_metrics": [{"name": "Total", "expr": "SUM(orders.total_amount)"}, {"name": "Broken", "expr": "SUM(orders.nothing)"}]}),
            {"verified_queries": [{"name": "All", "question": "?", "sql": "SELECT sum(total_amount) AS s FROM __orders"}, {"name": "Bad", "question": "?", "sql": "SELECT nothing FROM nowhere"}]},
        ]
    )
    shares = []
    enrich.enrich(spark, m, client, sources={"orders": df}, progress=lambda x, s: shares.append(x))
    assert t.description == "Orders." and t.dimensions[0].description == "mine" and t.facts[0].description == "Money" and t.facts[0].synonyms == ["Total", "sum paid"]
    assert [(x.name, x.expr) for x in t.metrics] == [("gmv", "SUM(total_amount)")] and m.description == "Sales."
    assert [x.name for x in m.metrics] == ["total"] and [(q.name, q.sql) for q in m.verified_queries] == [("All", "SELECT sum(total_amount) AS s FROM __orders LIMIT 200")]
    assert shares == sorted(shares) and shares[-1] == 1.0
    plain = M.SemanticModel("m", "d", tables=[M.Table("orders", M.BaseTable("", "", "orders"), dimensions=[M.Column("order_status", "order_status")])])
    quiet = enrich.Scripted(["not json"])
    enrich.enrich(spark, plain, quiet, sources={"orders": df})
    assert not any('"metrics"' in p and '"task": "metrics"' in p for p in quiet.prompts)


def test_partner_merge(spark):
    ours, theirs = partner.model_rows(spark, tpch_model().table("orders")), partner.dbt_rows(spark, DBT)
    rows = {r.field_key: r for r in partner.merge(ours, theirs, "partner").collect()}
    assert rows["O_ORDERSTATUS"].name == "status" and rows["O_ORDERSTATUS"].section == "dimensions" and rows["O_TOTALPRICE"].default_aggregation == "sum" and rows["TAX_PAID"].origin == "partner"
    assert {r.origin for r in partner.merge(ours, theirs, keep_ours=False, keep_partner=False).collect()} == {"merged"}
    assert catalog.read_dbt("semantic_models:\n  - name: x\n") == [{"name": "x"}] and catalog.read_dbt("") == []


def test_profile_edges(spark):
    df = spark.createDataFrame([(1, None, "n/a"), (1, float("nan"), "x"), (2, 3.0, None)], "a int, b double, c string")
    p = {r.column_name: r for r in P.profile(df).collect()}
    assert (p["a"].row_count, p["a"].ndv, p["a"].non_null, p["a"].min_value, p["a"].max_value) == (3, 2, 3, "1", "2")
    n = {r.column_name: r for r in P.null_probe(df).collect()}
    assert n["c"].nullish_ratio == pytest.approx(2 / 3, abs=1e-6) and n["b"].nullish_ratio == pytest.approx(2 / 3, abs=1e-6) and not n["a"].has_null
    assert P.profile(df.limit(0)).count() == 3 and P.null_probe(df.limit(0)).first().null_ratio == 0
    assert P.adaptive_thresholds([], [], [], 3) == P.Thresholds(50, 0.95, 0.6)
    t = P.adaptive_thresholds([0.95], [12.0], [10], 11)
    assert t.uniqueness <= 0.99 and t.similarity == pytest.approx(0.54) and t.min_sample_size >= 10
    assert [(r.column_name, r.value) for r in catalog.sample_values(df, 1).orderBy("column_name").collect()] == [("a", "1"), ("b", "3.0"), ("c", "n/a")]


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).selectExpr("id", "id % 7 as k")
    assert fingerprint(df).collect() == fingerprint(df.orderBy("k").repartition(5)).collect()
    assert fingerprint(df).collect() != fingerprint(df.union(df.limit(1))).collect() and fingerprint(df.limit(0)).first().n_rows == 0


def test_fingerprint_tells_nulls_apart_and_takes_maps(spark):
    one = lambda rows, kind: tuple(fingerprint(spark.createDataFrame(rows, kind)).first())
    assert one([(None, "a")], "a string, b string") != one([("a", None)], "a string, b string")
    assert one([([None, "a"],)], "a array<string>") != one([(["a", None],)], "a array<string>")
    assert one([({"x": 1, "y": None},)], "m map<string, int>") == one([({"y": None, "x": 1},)], "m map<string, int>") != one([({"x": 1},)], "m map<string, int>")


def test_profile_of_extreme_doubles_and_of_nothing(spark):
    df = spark.createDataFrame([(1e40, 1.0, float("-inf")), (-1e40, float("nan"), 2.5)], "a double, b double, c double")
    p = {r.column_name: (r.min_value, r.max_value) for r in P.profile(df).collect()}
    assert p == {"a": ("-1.0E40", "1.0E40"), "b": ("1.000000", "NaN"), "c": ("-Infinity", "2.500000")}
    assert P.profile(spark.createDataFrame([([1],)], "a array<int>")).count() == 0


def test_user_aggregates(spark):
    import pandas as pd

    def mean(v: pd.Series) -> float:
        return float(v.mean())

    spark.udf.register("my_avg", F.pandas_udf(mean, "double"))
    spark.udf.register("plus_one", lambda x: x + 1, "double")
    assert parse.is_aggregate(spark, "my_avg(x)") and not parse.is_aggregate(spark, "plus_one(x)") and not parse.is_aggregate(spark, "no_such_function(x)")
    t = Table("t", BaseTable("", "", "t"), columns=[Column("k", "k"), Column("m", "my_avg(x)")])
    assert [c.name for c in logical.split_aggregates(spark, t)[1]] == ["m"]


def test_qualify_lists_of_tables():
    known = {"a": "d.s.a", "b": "d.s.b", "c": "d.s.c"}
    assert logical.qualify("SELECT * FROM a, b x, c AS y WHERE a.i = x.i", known) == "SELECT * FROM d.s.a, d.s.b x, d.s.c AS y WHERE a.i = x.i"
    assert logical.qualify("SELECT a, b FROM a JOIN b ON a.i = b.i", known) == "SELECT a, b FROM d.s.a JOIN d.s.b ON a.i = b.i"


def test_planner_over_a_bridge_and_a_self_reference(spark):
    f = {
        "student": spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "cid")], "student_id int, sname string"),
        "course": spark.createDataFrame([(10, "art"), (20, "bio")], "course_id int, title string"),
        "enrolment": spark.createDataFrame([(1, 10), (1, 10), (1, 20), (2, 20), (None, 10)], "student_id int, course_id int"),
        "employee": spark.createDataFrame([(1, None, "ann"), (2, 1, "bob"), (3, 1, "cid")], "employee_id int, manager_id int, ename string"),
    }
    dims = lambda t: Table(t, BaseTable("", "", t), dimensions=[Column(c, c) for c in f[t].columns], metrics=[Metric("n", "count(*)")])
    rel = lambda n, a, ac, b, bc, **m: Relationship(n, a, b, [RelationKey(ac, bc)], **m)
    model = SemanticModel("m", tables=[dims(t) for t in f], relationships=[
        rel("e_s", "enrolment", "student_id", "student", "student_id"), rel("e_c", "enrolment", "course_id", "course", "course_id"),
        rel("s_c", "course", "course_id", "student", "student_id", relationship_type="many_to_many", via="enrolment"), rel("boss", "employee", "manager_id", "employee", "employee_id", join_type="left_outer"),
    ])
    plan = Planner(spark, model, f)
    with pytest.raises(PathError):
        plan.run(SemanticQuery(["student.n"], ["course.title"]))
    got = plan.run(SemanticQuery(["student.n"], ["course.title"], path=["s_c"]))
    assert sorted(map(tuple, got.collect())) == [("art", 1), ("bio", 2)]
    back = plan.run(SemanticQuery(["course.n"], ["student.sname"], path=["s_c"]))
    assert sorted(map(tuple, back.collect())) == [("ann", 2), ("bob", 1)]
    bosses = plan.run(SemanticQuery(["employee.n"], ["employee@boss.ename"]))
    assert sorted(map(tuple, bosses.collect()), key=str) == [("ann", 2), (None, 1)]


def test_live_catalog_walk(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS walked")
    sinks.create_table(spark, "walked.people", {"person_id": "int", "name": "string"})
    spark.sql("ALTER TABLE walked.people SET TBLPROPERTIES ('primary_key' = 'person_id')")
    rows = catalog.walk(spark, ["walked"]).orderBy("COLUMN_NAME").collect()
    assert [tuple(r)[:5] for r in rows] == [("walked", "people", "name", "STRING", False), ("walked", "people", "person_id", "INT", True)]
    assert catalog.qualified_tables(spark, "walked")[-1:] == ["spark_catalog.walked.people"] or "spark_catalog.walked.people" in catalog.qualified_tables(spark, "walked")
    assert catalog.try_query(spark, "SELECT nothing FROM nowhere")[0] is None and catalog.try_query(spark, "SELECT 1 AS x")[0].first().x == 1
    assert [len(b) for b in catalog.cursor(spark.range(25), 10)] == [10, 10, 5]
    assert catalog.quick_samples(spark.range(1000).selectExpr("id % 3 AS a", "string(id) AS b"), 5) == {"a": ["0", "1", "2"], "b": ["0", "1", "2", "3", "4"]}
    spark.sql("DROP DATABASE walked CASCADE")


def test_filters(spark):
    raw = catalog.tables_from_definitions(definitions("orders(status STRING=OPEN/CLOSED/OPEN, order_date TIMESTAMP, created_at STRING=2024-01-05T10:00:00, ship_mode INT=1/2, amount INT=1/2)"))[0]
    assert {f.name: f.expr for f in SF.suggest(raw)} == {"status_values": "status IN ('CLOSED', 'OPEN')", "order_date_last_30_days": "order_date >= date_sub(current_date(), 30)", "created_at_last_30_days": "created_at >= date_sub(current_date(), 30)", "ship_mode_values": "ship_mode IN (1, 2)"}
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(50)], "n int, c string")
    assert SF.small_domains(df) == {"c": ["a", "b"]}


def test_catalog_and_sinks(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS shelf")
    sinks.create_table(spark, "shelf.things", {"id": "int", "odd name": "string"})
    sinks.create_table(spark, "shelf.things", {"id": "int"})
    sinks.set_table_comment(spark, "shelf.things", "it's here")
    spark.sql("ALTER TABLE shelf.things SET TBLPROPERTIES ('primary_key' = 'id')")
    assert catalog.table_exists(spark, "shelf.things") and "things" in catalog.tables(spark, "shelf") and "shelf" in catalog.schemas(spark) and "spark_catalog" in catalog.databases(spark)
    assert catalog.describe(spark, "shelf.things") == {"id": "INT", "odd name": "STRING"} and catalog.primary_keys(spark, "shelf.things") == ["id"]
    assert catalog.same_schema(spark.table("shelf.things"), {"ID": "int", "ODD NAME": "str"})
    meta = catalog.columns(spark, {"things": spark.table("shelf.things")}, {"things": ["id"]})
    assert catalog.tables_from_metadata(meta)[0].column("id").is_primary_key
    path = sinks.write_model(spark, tpch_model(), f"file://{tmp_path}", "trade")
    assert catalog.yaml_files(spark, f"file://{tmp_path}") == ["trade.yaml"] and M.from_yaml(catalog.read_text(spark, path)) == tpch_model()
    assert sinks.delete_file(spark, path) and catalog.query(spark, "SELECT :x + 1 AS y", x=4).first().y == 5
    spark.sql("DROP DATABASE shelf CASCADE")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", "ab"[i % 2], float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "ts string, kind string, value double").selectExpr("cast(ts as timestamp) as ts", "kind", "value")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = run_to_folder(windowed_profile(stream, "ts", "kind", "value"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    late = spark.createDataFrame([("2024-02-01 00:00:00", "a", 1.0)], "ts string, kind string, value double").selectExpr("cast(ts as timestamp) as ts", "kind", "value")
    late.write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark past all windows before
    q = run_to_folder(windowed_profile(stream, "ts", "kind", "value"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    got, want = (sorted(map(tuple, x.collect())) for x in (spark.read.parquet(str(tmp_path / "out")), windowed_profile(df, "ts", "kind", "value")))
    assert got == want and q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1  # only the open window is still held
