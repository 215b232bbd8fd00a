import json
import random

from mercanta.operators import nested
from mercanta.operators.nested import ARRAYS, array_objects, declared_ways

TREE = ARRAYS["mercado_livre_products_raw"]


def _found(spark, payloads):
    df = spark.createDataFrame([(str(i), p, "x") for i, p in enumerate(payloads)], "id string, payload string, object string")
    return sorted((r.record_id, r.parent_path, r.object_path) for r in array_objects(df, "id", "payload", "p", TREE).collect())


def _brute(value, declared):
    """(parent path, path) of every array object, by plain recursion."""
    out = []

    def go(x, path, parent, way):
        if isinstance(x, list):
            for i, y in enumerate(x):
                here = f"{path}[{i}]"
                if isinstance(y, dict):
                    out.append((parent, here))
                go(y, here, here if isinstance(y, dict) else parent, way)
        elif isinstance(x, dict):
            for name, y in x.items():
                w = f"{way}.{name}" if way else name
                if w in declared:
                    try:
                        y = json.loads(y) if isinstance(y, str) else y
                    except ValueError:
                        continue
                    y = [y] if isinstance(y, dict) else y
                go(y, f"{path}.{name}" if path else name, parent, w)

    go(value, "", "", "")
    return out


def _expected(payloads):
    out = []
    for i, p in enumerate(payloads):
        try:
            v = json.loads(p) if p is not None else None
            v = json.loads(v) if isinstance(v, str) else v
        except ValueError:
            continue
        out += [(str(i), *r) for r in _brute(v, declared_ways(TREE))]
    return sorted(out)


def test_shapes(spark):
    values = [{"id": "1", "struct": {"n": 1}}, None, "text", 3, {"name": "ç"}]
    payloads = [
        json.dumps({"attributes": [{"id": "A", "values": values}, None, {"values": {"id": 2}}, {"values": json.dumps(values)}], "pictures": {"sizes": []}}),
        json.dumps({"attributes": json.dumps([{"id": "B"}]), "pickers": [{"products": [{"tags": ["x"], "thumbs": [{"sizes": {"w": 1}}]}]}], "buy_box_winner": {"sale_terms": {"values": [{"id": 1}]}}}),
        json.dumps(json.dumps({"main_features": [{"text": "a"}, {"text": "b"}]})),
        '{"attributes": [{"id": "cut', "", None, "null", "[]", "12", '{"attributes": null, "pictures": [], "pickers": 5, "main_features": "no json"}',
        json.dumps({"unknown": {"deep": [{"a": [{"b": 1}, []]}, [{"c": 1}]]}, "attributes": [{"id": "A"}]}), json.dumps([{"a": 1}, {"pictures": [{"id": 1}]}]),
        json.dumps({"pictures": [{"sizes": [{"w": i} for i in range(3000)], "id": "x" * 50_000}]}),
    ]
    assert _found(spark, payloads) == _expected(payloads)
    assert ("0", "attributes[0]", "attributes[0].values[4]") in _found(spark, payloads[:1])
    assert _found(spark, []) == []


def test_random_payloads(spark):
    rnd = random.Random(9)

    def arrays(tree, depth=0):
        out = {}
        for name, sub in tree.items():
            if "." in name or rnd.random() < 0.3:
                continue
            items = [rnd.choice([None, {"id": rnd.random(), **arrays(sub, depth + 1)}, {**arrays(sub, depth + 1)}]) for _ in range(rnd.randrange(4))]
            shape = rnd.random()
            out[name] = items if shape < 0.7 else json.dumps(items) if shape < 0.85 else (items[0] if items else {})
        return out

    payloads = [json.dumps(arrays(TREE)) for _ in range(200)]
    assert _found(spark, payloads) == _expected(payloads)


def test_arrays_that_nobody_declared(spark):
    payloads = [
        '{"foo":{"values":[{"a":1}]}}', '{"x":{"pictures":[{"b":2}]}}', '{"attributes":[{"sizes":[{"c":1}]}]}', '{"extra":[1,{"d":[{}]}]}', '{"foo-bar":[{"e":1}]}', '[[{"a":[{"b":"x\\\\"}]}],{"q\\"u":[null,{"z":"[{]"}]}]',
        '{"a.b":[[1,[{}]]],"attributes":"[{\\"id\\":\\"{\\\\\\"}]\\"}]"}', '{"attributes":"{\\"values\\":\\"[{}]\\"}"}', '{"k":[{"t":"say \\"[{}]\\", then , : go"}]}', "{}", '{"a":[{"b":1}', "{} {}",
    ]
    assert _found(spark, payloads) == _expected(payloads) and len(_expected(payloads)) >= 14


def test_blocks_and_texts(spark, monkeypatch):
    payload = json.dumps({"attributes": [{"id": "á", "values": {"id": 1}}, {"id": "B"}]}, ensure_ascii=False)
    df = spark.createDataFrame([(str(i), payload) for i in range(500)], "id string, payload string")
    monkeypatch.setattr(nested, "BLOCK_BYTES", 700)
    rows = array_objects(df, "id", "payload", "p", TREE).collect()
    assert len(rows) == 1500 and {r.object for r in rows} == {'{"id": "á", "values": {"id": 1}}', '{"id": 1}', '{"id": "B"}'} and {r.table_name for r in rows} == {"p.attributes", "p.attributes.values"}
