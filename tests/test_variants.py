import json

from rankloom.functions import variants


def brute(payload):
    """Distinct strings under path keys, by key at each level and index in lists."""
    try:
        value = json.loads(payload)
    except (TypeError, ValueError):
        return []
    found = []

    def walk(key, value):
        if isinstance(value, dict):
            for k in sorted(value):
                walk(k, value[k])
        elif isinstance(value, list):
            for x in value:
                walk(key, x)
        elif isinstance(value, str) and value and key.lower().replace("-", "_").endswith(variants.PATH_KEYS):
            found.append(value)

    if isinstance(value, dict):
        walk("", value)
    return list(dict.fromkeys(found))


ROWS = [
    None, "", "no json", "[1, 2]", '"file"', "{}", '{"file": null, "path": 3, "paths": true}', '{"file": ""}', '{"File": "a", "b-FILENAMES": ["b", "a", {"path": "c", "x": "d"}]}',
    '{"files": [["deep", ["deeper", {"no": "e", "my_path": "f"}]]], "z": {"y": {"x": {"w": {"changed-files": ["g", "a"]}}}}}', '{"profile": "h", "pathx": "i", "a": "{\\"file\\": \\"j\\"}"}', '{"files": ' + "[" * 30 + '"k"' + "]" * 30 + "}", '{"file": "é/ü"}', '{"file": ["' + '", "'.join(f"p{n}" for n in range(1500)) + '"]}', '{"broken": "file',
]


def test_path_hints_against_a_plain_walk(spark):
    rows = spark.createDataFrame([(n, p, "clash") for n, p in enumerate(ROWS)], "id long, payload string, key string")
    found = {r.id: r.paths for r in variants.path_hints(rows, "id", "payload").collect()}
    assert found == {n: brute(p) for n, p in enumerate(ROWS)}


def test_repeated_ids_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, '{"file": "b"}'), (1, '{"file": "b"}')], "id long, payload string")
    assert [tuple(r) for r in variants.path_hints(rows, "id", "payload").collect()] == [(1, ["b"])]
    assert variants.path_hints(rows.limit(0), "id", "payload").count() == 0
