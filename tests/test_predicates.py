"""Filter objects by the rows they keep."""

from __future__ import annotations

import datetime

import pytest

from quernel.plans.filter_model import compile_model, options_of, plain_filters, split_place
from quernel.plans.names import camel_columns, to_camel, to_snake
from quernel.plans.predicates import UNSET, Compiler, like_pattern

ROWS = [(1, "ann", 10, True, datetime.date(2024, 1, 1), None), (2, "Bob", 20, False, datetime.date(2024, 6, 1), "x"), (3, "a_b", None, None, None, "50%"), (4, None, 40, True, datetime.date(2025, 1, 1), "y\\z")]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, "id int, name string, age int, active boolean, born date, note string").cache()


@pytest.mark.parametrize(
    ("where", "ids"),
    [
        ({}, [1, 2, 3, 4]),
        (None, [1, 2, 3, 4]),
        ({"name": "ann"}, [1]),
        ({"name": None}, [4]),
        ({"name": UNSET, "id": 2}, [2]),
        ({"born": datetime.date(2024, 6, 1)}, [2]),
        ({"born": {"gte": "2024-06-01"}}, [2, 4]),
        ({"age": [10, 40]}, [1, 4]),
        ({"age": []}, []),
        ({"age": {"equals": None}}, [3]),
        ({"age": {"equals": 20}}, [2]),
        ({"age": {"not": None}}, [1, 2, 4]),
        ({"age": {"not": 20}}, [1, 4]),
        ({"age": {"not": {"gt": 15}}}, [1]),
        ({"age": {"gt": 10, "lt": 40}}, [2]),
        ({"age": {"lte": "20"}}, [1, 2]),
        ({"name": {"contains": "_"}}, [1, 2, 3]),
        ({"name": {"contains": "\\_"}}, [3]),
        ({"name": {"startsWith": "a"}}, [1, 3]),
        ({"name": {"endsWith": "B", "mode": "insensitive"}}, [2, 3]),
        ({"note": {"contains": "\\z"}}, [4]),
        ({"note": {"contains": "\\\\"}}, [4]),
        ({"age": {"in": [20]}}, [2]),
        ({"age": {"notIn": [20]}}, [1, 4]),
        ({"age": {"notIn": [20, None]}}, []),
        ({"age": {"notIn": []}}, [1, 2, 3, 4]),
        ({"age": {"isNull": True}}, [3]),
        ({"age": {"isNull": False}}, [1, 2, 4]),
        ({"age": {"isNotNull": True}}, [1, 2, 4]),
        ({"age": {"isNotNull": False}}, [3]),
        ({"AND": []}, [1, 2, 3, 4]),
        ({"OR": []}, [1, 2, 3, 4]),
        ({"OR": "no list"}, [1, 2, 3, 4]),
        ({"OR": [{"id": 1}, {"name": None}]}, [1, 4]),
        ({"AND": [{"active": True}, {"age": {"gt": 10}}]}, [4]),
        ({"NOT": [{"active": True, "age": 10}]}, [2, 4]),
        ({"NOT": [{"id": 1}, {"id": 1}]}, [2, 3, 4]),
        ({"active": True, "OR": [{"id": 1}, {"AND": [{"id": 4}, {"NOT": [{"age": 40}]}]}]}, [1]),
        ({"age": {"$gt": 10, "$lte": 40}}, [2, 4]),
        ({"age": {"$ne": 10}, "name": {"$like": "B%"}}, [2]),
        ({"age": {"$eq": 10}}, [1]),
        ({"age": {"$in": [10]}, "name": {"$notLike": "B%"}}, [1]),
        ({"age": {"$isNull": True}}, [3]),
    ],
)
def test_where(people, where, ids):
    test = Compiler(people.schema).where(where)
    rows = people if test is None else people.where(test)
    assert sorted(r.id for r in rows.collect()) == ids


@pytest.mark.parametrize("where", [{"nobody": 1}, {"age": {"near": 3}}, {"age": "x"}, {"age": 1.5}, {"age": {"in": 3}}, {"age": {"notIn": "a"}}, {"born": "soon"}, {"active": "maybe"}, {"name": {"contains": 3, "$like": 3}}])
def test_refused(people, where):
    with pytest.raises(ValueError):
        Compiler(people.schema).where(where)


def test_ignoring_case(people):
    assert people.where(Compiler(people.schema, ignore_case=True).where({"name": "BOB"})).count() == 1
    assert people.where(Compiler(people.schema).where({"name": "BOB"})).count() == 0


def test_pushed_to_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    rows = df.where(Compiler(df.schema).where({"o_totalprice": {"gte": 1000}, "o_orderstatus": ["O", "F"]})).select("o_orderkey")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in plan and "In(o_orderstatus" in plan


def test_patterns():
    assert like_pattern("a\\b\\%c\\") == "ab\\%c\\\\"


@pytest.mark.parametrize(
    ("model", "ids"),
    [
        ({"andFilter": {"active": True, "age": None}}, [1, 4]),
        ({"andFilter": {"name": {"_type": "find-operator", "_value": "a%"}}}, [1, 3]),
        ({"andFilter": {"age": {"_type": "between", "_value": [10, 20]}}}, [1, 2]),
        ({"andFilter": {"age": {"minimum": 20}}}, [2, 4]),
        ({"andFilter": {"age": {"maximum": 20}}}, [1, 2]),
        ({"andFilter": {"age": []}}, []),
        ({"likeFilter": {"name": "nn"}}, [1]),
        ({"likeFilter": {"name": "b%"}}, []),
        ({"orFilter": [{"id": 1, "name": "Bob"}, {"age": 40}]}, [1, 2, 4]),
        ({"andFilter": {"active": True}, "orFilter": [{"id": 1}]}, [1]),
        ({"andFilter": {}, "wildcardQueryString": "B", "wildCardMatchWithFields": ["name", "note"]}, [2, 3]),
    ],
)
def test_filter_model(people, model, ids):
    test = compile_model(Compiler(people.schema), model)
    assert sorted(r.id for r in people.where(test).collect()) == ids


def test_model_options_and_places(people):
    assert options_of({"selectFields": ["a"], "orderBy": "b", "order": "DESC", "limit": 3, "skip": 4}, {"limit": 9}) == {"select": ["a"], "order_by": [{"column": "b", "direction": "DESC"}], "limit": 9, "offset": 4}
    model, geo = split_place({"andFilter": {"lat": 1, "lng": 2, "x": 3}}, "lat", "lng")
    assert model == {"andFilter": {"x": 3}} and geo["center"] == {"lat": 1.0, "lng": 2.0}
    assert split_place({"andFilter": {"lat": 1}}, "lat", "lng")[1] is None
    assert people.where(plain_filters(Compiler(people.schema), {"id": 2, "page": 5, "limit": 1})).count() == 1


def test_names(spark):
    assert to_camel("canonical_city_name") == "canonicalCityName" and to_snake("canonicalCityName") == "canonical_city_name"
    assert camel_columns(spark.createDataFrame([(1,)], "a_b int")).columns == ["aB"]
