"""Queries without SQL that take everything their operator takes, on small tables of their own."""

from __future__ import annotations

import math

from quernel.queries import texts


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_terms(spark, tmp_path):
    words = "cache küche cache< `cache cäche čäche кэш ca€he caches coach cash ache table ca\U0001f600he"
    spark.createDataFrame([(1, words), (2, "cache ĉaĉhe"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.term: r.edits for r in texts.fuzzy_terms(spark, str(tmp_path)).collect()}
    assert found == {w: n for w in [*words.split(), "ĉaĉhe"] if (n := _edits(w, "cache")) <= 2}
    assert {"küche", "cache<", "`cache", "čäche"} <= set(found)


def test_geo_centroid(spark, tmp_path):
    points = [("one", 12.5, -170.25), ("two", 10.0, 179.0), ("two", 10.0, -179.0), ("against", 0.0, 0.0), ("against", 0.0, 180.0), ("poles", 90.0, 0.0), ("poles", -90.0, 0.0), (None, 1.0, 2.0), ("bad", 95.0, 1.0), *[("many", 20.0 + i, 30.0 + 2 * i) for i in range(5)]]
    rows = [(i, n, (a, o)) for i, (n, a, o) in enumerate(points)]
    spark.createDataFrame(rows, "geo_id long, location_name string, location struct<lat: double, lng: double>").write.parquet(f"{tmp_path}/geo_documents.parquet")
    found = {r.location_name: (r.n, r.lat, r.lng) for r in texts.geo_centroid(spark, str(tmp_path)).collect()}
    many = [(math.radians(a), math.radians(o)) for n, a, o in points if n == "many"]
    x, y, z = (sum(v) for v in zip(*[(math.cos(a) * math.cos(o), math.cos(a) * math.sin(o), math.sin(a)) for a, o in many]))
    assert found.pop("many") == (5, round(math.degrees(math.atan2(z, math.hypot(x, y))), 4), round(math.degrees(math.atan2(y, x)), 4))
    n, lat, lng = found.pop("two")
    assert n == 2 and lat == 10.0015 and abs(lng) == 180
    assert found == {"one": (1, 12.5, -170.25), "against": (2, None, None), "poles": (2, None, None), None: (1, 1.0, 2.0)}


def test_stem_vocab(spark, tmp_path):
    spark.createDataFrame([("Añadimos caches, Москва is 東京 x9!",), ("Running\u3000caches -- naïve\u00a0ponies",), ("",), (None,)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.word: r.stem for r in texts.stem_vocab(spark, str(tmp_path)).collect()}
    assert set(found) == set("añadimos caches москва is 東京 x9 running naïve ponies".split())
    assert (found["caches"], found["running"], found["москва"], found["東京"]) == ("cach", "run", "москва", "東京")


def test_place_normalize(spark, tmp_path):
    names = ["NYC", "NYC", "the big apple", "Phoenixx", "Quindo Bay", "", None]
    spark.createDataFrame([(n,) for n in names], "location_name string").write.parquet(f"{tmp_path}/geo_documents.parquet")
    rows = [tuple(r) for r in texts.place_normalize(spark, str(tmp_path)).collect()]
    assert len(rows) == 5 and {n for n, _, _ in rows} == {n for n in names if n is not None}
    assert {n: how for n, _, how in rows} == {"NYC": "alias", "the big apple": "direct", "Phoenixx": "fuzzy", "Quindo Bay": "as_is", "": None}
