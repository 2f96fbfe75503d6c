import json

from lectern.operators.nested import _lifted, child_table, flatten, p7_found
from lectern.plans.runtime import table


def load(text):
    try:
        v = json.loads(text)
        if isinstance(v, str):
            try:
                return json.loads(v)
            except ValueError:
                pass
        return v
    except (TypeError, ValueError):
        return None


def lists(v, path, found):
    if isinstance(v, list):
        found.add(path)
        for x in v:
            lists(x, (*path, "[]"), found)
    elif isinstance(v, dict):
        for k, x in v.items():
            lists(x, (*path, k), found)


def nodes(v, path, name, parent, known, out):
    if isinstance(v, dict) and path in known and path[-1:] != ("[]",):
        v = [v]
    if isinstance(v, list):
        for i, x in enumerate(v):
            at = f"{name}[{i}]"
            if isinstance(x, dict):
                out.append((at, parent))
                for k, y in x.items():
                    nodes(y, (*path, "[]", k), f"{at}.{k}", at, known, out)
            elif isinstance(x, list):
                nodes(x, (*path, "[]"), at, parent, known, out)
    elif isinstance(v, dict):
        for k, x in v.items():
            nodes(x, (*path, k), f"{name}.{k}", parent, known, out)


def brute(rows, columns):
    """rows: (id, text, ...)"""
    out = []
    for i, c in enumerate(columns, 1):
        known = set()
        for r in rows:
            lists(load(r[i]), (), known)
        known = _lifted(known)
        for r in rows:
            mine = []
            nodes(load(r[i]), (), c, c, known, mine)
            out += [(r[0], *x) for x in mine]
    return sorted(out)


COLUMNS = ["openalex_metadata", "search_hits_openalex"]


def test_matches_a_plain_traversal(spark, sf):
    rows = table(spark, sf, "raw_bundles").select("id", *COLUMNS).collect()
    assert sorted(map(tuple, p7_found(spark, sf).collect())) == brute(rows, COLUMNS)


def test_edge_cases(spark):
    rows = [
        (1, json.dumps({"a": [{"b": [{}, None, 3, {"c": "x"}]}, None, {"b": {"c": "lone"}}], "m": {"w": [1, 2], "v": [3]}})),
        (2, json.dumps(json.dumps({"a": {"b": None}}))),
        (3, None),
        (4, ""),
        (5, '{"a": [{"b"'),
        (6, json.dumps([[{"k w": 1}], [[{"n": {"o": [{}]}}]], "s"])),
        (7, json.dumps({"odd name": [{"é": [{"q`t": [{}]}]}]})),
        (8, '"just text"'),
        (9, json.dumps({"a": "text here", "m": {}})),
        (1, json.dumps({"a": []})),
    ]
    df = spark.createDataFrame([(i, t, "node", "x" * 10000) for i, t in rows], "id long, col string, node string, v string")
    assert sorted((r.id, r.node, r.parent) for r in flatten(df, "id", ["col"]).collect()) == brute(rows, ["col"])
    assert flatten(df.limit(0), "id", ["col"]).count() == 0
    t = child_table(flatten(df, "id", ["col"], keep_values=True), "id", "col[].a[].b", {"c": "string"})
    assert sorted((r.id, r.node, r.parent, r.ordinal, r.c) for r in t.collect()) == [(1, "col[0].a[0].b[0]", "col[0].a[0]", 0, None), (1, "col[0].a[0].b[3]", "col[0].a[0]", 3, "x"), (1, "col[0].a[2].b[0]", "col[0].a[2]", 0, "lone")]


def test_mixed_values_at_any_depth(spark):
    from lectern.operators.nested import infer_lists
    from pyspark.sql import functions as F

    value = [1, {"b": [{"c": 1}]}]
    for _ in range(14):
        value = [{"a": value}]
    docs = spark.createDataFrame([(json.dumps(value),)], "s string").select(F.try_parse_json("s").alias("v"))
    found = infer_lists(docs, [docs.columns[-1]])[0]
    assert max(found, key=len)[-1] == "b" and len(found) == 16
