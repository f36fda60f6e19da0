"""Keys, types and checks from schema tables."""

import json

import pytest

from gridtally.operators import blocks

SCHEMAS = [
    {"block_type": "a", "type": "object", "required": ["x", "odd'name"], "properties": {"x": {"type": "integer"}, "y": {"type": "number"}, "z": {"type": "array"}}, "keys_extracted": [{"key": "kx", "from": "x"}, {"key": "ky", "from": "y"}, {"key": "kz", "from": "z"}, {"key": "deep", "from": "o.p.q"}]},
    {"block_type": "b", "_status": "pending", "required": ["x"]},
    {"block_type": "c", "type": "object"},
    {"block_type": "d", "required": ["x"]},
    {"title": "no type"},
]
BLOCKS = [(1, "a", {"x": 3, "y": 2, "z": [1, "two"], "o": {"p": {"q": "deep"}}}), (2, "a", {"x": 3.5, "y": 1e300, "z": {}, "o": {"p": 1}}), (3, "a", {"x": None}), (4, "a", 7), (5, "a", [1]), (6, "b", {}), (7, "c", {}), (8, "d", {}), (9, "e", {}), (10, "d", "text"), (11, "a", None)]


@pytest.fixture(scope="module")
def given(spark):
    texts = [json.dumps(s).replace("odd'name", "odd name") for s in SCHEMAS] + ["no json"]
    rows = [(i, t, json.dumps(p)) for i, t, p in BLOCKS] + [(12, "d", "{broken"), (13, "a", None)]
    return spark.createDataFrame(rows, "block_id long, block_type string, payload string"), blocks.schemas(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_extract(given):
    rows, parsed = given
    assert {r.key: (r.block_type, r.path, r.type) for r in blocks.key_table(parsed).collect()} == {"kx": ("a", "x", "integer"), "ky": ("a", "y", "number"), "kz": ("a", "z", "array"), "deep": ("a", "o.p.q", None)}
    got = {(r.block_id, r.key): (r.value, r.type_ok) for r in blocks.extract(rows, blocks.key_table(parsed)).collect()}
    assert got == {(1, "kx"): ("3", True), (1, "ky"): ("2", True), (1, "kz"): ('[1,"two"]', True), (1, "deep"): ("deep", True), (2, "kx"): ("3.5", False), (2, "ky"): ("1.0E300", True), (2, "kz"): ("{}", False), (3, "kx"): (None, False)}


def test_check(given):
    got = sorted((r.block_id, r.problem, r.field or "") for r in blocks.check(*given).collect())
    lacks = lambda i, *fields: [(i, "missing", f) for f in fields]
    assert got == sorted(lacks(1, "odd name") + lacks(2, "odd name") + lacks(3, "odd name") + [(4, "type", "")] + lacks(5, "odd name", "x") + lacks(8, "x") + lacks(10, "x") + lacks(11, "odd name", "x") + lacks(12, "x") + lacks(13, "odd name", "x"))


def test_no_schema(spark, given):
    none = given[1].limit(0)
    assert blocks.extract(given[0], blocks.key_table(none)).count() == 0 and blocks.check(given[0], none).count() == 0
