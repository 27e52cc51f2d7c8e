"""The first object of a text, against Python's decoder at every brace."""

import json
import random
import time

from pyspark.sql import functions as F

from schemaloom.functions import jsontext as J
from schemaloom.functions.arrays import last_of_each


def first(text):
    """Objects only; the parser of the engine knows no bare words beyond JSON's."""
    for i, c in enumerate(text or ""):
        if c == "{":
            try:
                found, _ = json.JSONDecoder().raw_decode(text[i:])
            except (ValueError, RecursionError):
                continue
            return sorted(map(str, found))
    return None


def keys(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = rows.select("id", F.array_sort(F.map_keys(J.first_json_object(F.col("t")))).alias("k")).collect()
    return [r.k for r in sorted(got, key=lambda r: r.id)]


def test_against_every_brace(spark):
    draw = random.Random(5)
    parts = ["{", "}", '"', "\\", ":", ",", " ", "\n", '"a":1', '"b": [2, {"c": "}"}]', '{"d":null}', "x", "[", "]", '{ "e" :"{"}', "é", '\\"']
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(1_500)]
    texts += [None, "", "{", "}", "{}", "{ }", "}{", 'say "{" {"a":1}', 'He said "look: {"a":1}', '{"a":{"b":1}', '{"a":1} {"b":2}', '{"a" 1 {"b":2}} }']
    # An object with repeated names is a matter of the parser, not of the search.
    pairs = [(t, g, first(t)) for t, g in zip(texts, keys(spark, texts))]
    assert [(t, g, e) for t, g, e in pairs if (None if g is None else sorted(set(g))) != e] == []
    assert sum(e is not None for _, _, e in pairs) > 300


def test_floods_of_braces(spark):
    n = 20_000
    texts = ["{" * n, "{ " * n + "}" * n, '{"a":' * n, '{"a":' * n + "1" + "}" * 5, "{x" * n + '{"a":1}' + "{" * n, "}" * n + '{"b":1}', '"{' * n + "}"]
    keys(spark, ['{"a":1}'])
    start = time.time()
    assert keys(spark, texts) == [None, [], None, ["a"], ["a"], ["b"], []]
    assert time.time() - start < 60


def test_last_of_each(spark):
    """Equal keys keep the last element; arrays without any stay as they are."""
    given = [[("a", 1), ("b", 2)], [("a", 1), ("b", 2), ("a", 3)], [], None]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(given)], "id int, a array<struct<key:string,n:int>>")
    got = rows.select("id", last_of_each(F.col("a"), lambda x: x.key).alias("a")).orderBy("id").collect()
    plain = [r.a and [tuple(x) for x in r.a] for r in got]
    assert plain == [given[0], [("b", 2), ("a", 3)], [], None]
