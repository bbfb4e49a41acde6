import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import metrics as M
from tessera.functions import names as N


def test_tokens_and_stems():
    assert N.identifier_tokens("orderItemID_2x") == ["ORDER", "ITEM", "ID", "2X"]
    assert N.identifier_tokens("dim_customer", frozenset({"DIM"})) == ["CUSTOMER"]
    assert N.sanitize_identifier_name("o_orderkey") == "ORDERKEY" and N.sanitize_identifier_name("stg_orders", frozenset({"STG"})) == "ORDERS"
    for name, want in {"o_custkey": ("CUST", "KEY"), "owner_user_id": ("OWNER_USER", "ID"), "channel": ("CHANNEL", ""), "id": ("", "ID"), "merchant_no": ("MERCHANT", "NO"), "uid": ("U", "ID"), "l_linenumber": ("LINE", "NUMBER")}.items():
        assert N.key_stem(name) == want
    assert [N.singularize(w) for w in ("CITIES", "BOXES", "ORDERS", "CLASS", "STATUS", "BUS")] == ["CITY", "BOX", "ORDER", "CLASS", "STATUS", "BUS"]
    assert N.entity_tokens("dim_customer_info") == ["CUSTOMER"] and N.entity_tokens("t_user_account") == ["USER", "ACCOUNT"]
    assert N.global_prefixes(["c_name", "c_key", "o_x"]) == {"C"} and N.table_prefixes("dim_date") >= {"DIM"}


def test_safe_names():
    used: set[str] = set()
    assert [N.safe_semantic_identifier(n, used, frozenset({"YEAR"})) for n in ("year", "Year", "2nd place", "a b", "A-B", "")] == ["year_2", "year_3", "field_2nd_place", "a_b", "a_b_2", "field"]
    assert N.normalize_identifier("a  b!!c") == "a_b_c" and N.is_valid_identifier("a$1") and not N.is_valid_identifier("1a")
    assert N.sanitize_slug("Gross Value!", set()) == "gross_value" and N.sanitize_query_name("Top  ten", {"Top ten"}) == "Top ten (2)"
    assert N.to_snake_case("Top Ten-Items") == "top_ten_items"


def test_types():
    assert N.base_type("number(38, 0) not null") == "NUMBER" and N.clean_column_type(" decimal(3,1)  NULL ") == "DECIMAL(3,1)"
    assert [N.type_family(t) for t in ("TIMESTAMP_NTZ", "varchar(9)", "INT", "ARRAY<INT>", "INTERVAL")] == ["time", "categorical", "numeric", "object", "unknown"]
    assert [N.key_family(t) for t in ("BIGINT", "DECIMAL(10,0)", "DECIMAL(10,2)", "NUMBER", "STRING", "BOOLEAN", "DOUBLE")] == ["integer", "integer", None, "integer", "string", None, None]


def test_levenshtein_and_similarity(spark):
    rng = random.Random(0)
    pairs = [("".join(rng.choice("abc_") for _ in range(rng.randrange(9))), "".join(rng.choice("abc_") for _ in range(rng.randrange(9)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.levenshtein("a", "b").alias("d"))
    assert all(N.levenshtein(r.a, r.b) == r.d for r in df.collect())
    assert N.name_similarity("o_custkey", "C_CUSTKEY") == 0.95 and N.name_similarity("x", "X") == 1.0 and N.name_similarity("cust_id", "customer_key") == 0.9
    assert N.are_variants("DEPT", "DEPARTMENT") and N.are_variants("ORDER", "ORDERS") and not N.are_variants("REGION", "NATION")


def test_keys_by_name():
    assert N.looks_like_primary_key("orders", "o_orderkey") and N.looks_like_primary_key("x", "id") and N.looks_like_primary_key("x", "record_id")
    assert not N.looks_like_primary_key("orders", "o_custkey") and not N.looks_like_primary_key("nation", "n_regionkey")
    assert N.looks_like_foreign_key("orders", "customers", "customer_id") and N.looks_like_foreign_key("t", "users", "created_by") and not N.looks_like_foreign_key("t", "users", "note")
    assert N.excluded_from_matching("created_at", "TIMESTAMP") and N.excluded_from_matching("status", "STRING") and N.excluded_from_matching("total", "INT")
    assert not N.excluded_from_matching("status_id", "INT") and not N.excluded_from_matching("order_date_key", "NUMBER")
    assert N.is_join_key_candidate("anything", "DOUBLE", True) and not N.is_join_key_candidate("price", "DOUBLE") and N.could_be_identifier("x_id", "INT") and not N.could_be_identifier("comment", "STRING")
    assert N.is_generic_identifier("key_value") and not N.is_generic_identifier("order_id") and N.follows_fk_pattern("l_orderkey", "o_orderkey")
    assert N.column_mentions_table("order_reference", "orders") and not N.column_mentions_table("batch_id", "orders")
    for t in ("orders_v2", "tmp_x", "x_bak", "orders_20240101", "test_orders", "orders_archive"):
        assert N.is_noise_table(t)
    assert not N.is_noise_table("orders") and not N.is_noise_table("latest_orders")


def test_time_like():
    assert N.is_time_like("x", "DATE") and N.is_time_like("created", "STRING", ["2024-01-05 10:00:00"]) and not N.is_time_like("day_name", "STRING", ["Monday"])
    assert not N.is_time_like("width", "STRING") and not N.is_time_like("updated_by", "STRING") and N.is_time_like("order_date", "STRING")


def test_quoting_and_literals():
    assert N.quote_identifier('"a`b"') == "`a``b`" and N.split_identifier("`a.b`.c.d") == ["a.b", "c", "d"] and N.join_quoted("x", None, "y") == "`x`.`y`"
    assert N.format_literal("5", "INT") == "5" and N.format_literal("o'k", "STRING") == "'o''k'" and N.format_literal("yes", "BOOLEAN") == "TRUE" and N.format_literal("n/a", "INT") == "'n/a'"
    assert all(map(N.is_nullish, (None, float("nan"), "", " n/a ", "None"))) and not N.is_nullish("0")


def test_metric_words():
    assert [M.metric_intent(t) for t in ("average basket", "number of orders", "unique customers count", "discounted price", "quantity times price", "revenue")] == ["avg", "count", "count_distinct", "sum", "product", "sum"]
    assert M.metric_expression("product", [("q", "INT"), ("p", "DOUBLE")]) == "SUM(q * p)" and M.metric_expression("avg", [("s", "STRING")]) == "COUNT(s)" and M.metric_expression("sum", []) == "COUNT(*)"
    assert M.metric_expression("count_distinct", [("s", "STRING")]) == "COUNT(DISTINCT s)" and M.aggregation("count_distinct", "x") == "count(distinct x)"
    with pytest.raises(ValueError):
        M.aggregation("mode", "x")
