"""Nested parameters against a plain recursive merge."""

import json
import random

from netaudit.operators.params import business_params, flatten


def _merged(a, b):
    out = dict(a)
    for k, v in b.items():
        out[k] = _merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _leaves(tree, path=()):
    for k, v in tree.items():
        if isinstance(v, dict) and v:
            yield from _leaves(v, (*path, k))
        else:
            yield (*path, k), v


def _tree(rnd, depth=0):
    return {rnd.choice("abcd"): _tree(rnd, depth + 1) if depth < 3 and rnd.random() < 0.55 else rnd.choice([1, "x", None, True, [1, {"q": 2}], {}, 1.5, "é \" ,"]) for _ in range(rnd.randint(0 if depth else 1, 4))}


def test_merge_brute_force(spark):
    rnd = random.Random(8)
    defaults = {"a": {"b": {"c": 1, "d": {"a": 2}}, "c": [1]}, "b": "x", "c": {"a": {}}, "d": {"a": 1}}
    own = {f"p{k}": json.dumps(_tree(rnd)) for k in range(60)} | {"broken": '{"a": ', "list": "[1]", "none": None, "empty": "{}", "text": '"a"'}
    rows = spark.createDataFrame(list(own.items()), "project_id string, params string")
    got: dict = {p: {} for p in own}
    for r in business_params(rows, json.dumps(defaults)).collect():
        assert tuple(r.path) not in got[r.project_id]
        got[r.project_id][tuple(r.path)] = json.loads(r.value)
    for p, text in own.items():
        try:
            tree = json.loads(text) if text else {}
        except ValueError:
            tree = {}
        want = _merged(defaults, tree) if isinstance(tree, dict) else defaults
        assert got[p] == dict(_leaves(want)), p


def test_flatten(spark):
    df = spark.createDataFrame([("p", '{"a": {"b": {"c": 1}}, "n": null, "l": [1, {"x": 2}]}')], "k string, j string")
    assert {tuple(r.path): r.value for r in flatten(df, ["k"], "j").collect()} == {("a", "b", "c"): "1", ("n",): "null", ("l",): '[1,{"x":2}]'}
    assert flatten(df.limit(0), ["k"], "j").count() == 0
