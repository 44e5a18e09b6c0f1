"""Array files in any number of byte ranges against a reader of whole files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from auditweave.sources import json_arrays


def whole(spark, path):
    """One task per file: the document is parsed as a whole."""
    read = spark.read.format("json").option("singleVariantColumn", "v").option("multiLine", True).load(path)
    return read.select(F.explode(F.expr("cast(v as array<variant>)")).alias("v")).select(F.to_json("v").alias("raw"))


def texts(frame):
    return sorted(r["raw"] for r in frame.collect())


@pytest.fixture
def ranges(spark):
    """Set the bytes of a range; restored afterwards."""
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


NASTY = [
    {"a": 1, "s": "}"}, {"s": "{[\"]},{\\"}, {"s": "\\\\", "t": "\\\""}, {}, {"deep": [{"x": [{}, {"y": "}{"}]}]},
    {"k}": "v", "[": "]"}, {"e": "é😀}漢"}, {"n": None, "b": True, "f": 1.5}, {"nl": "a\nb\r\n}"}, 7, "text, with } and ]", [1, {"z": 2}, []], None, {"last": 1},
]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 16, 61, 1 << 20])
def test_cuts_anywhere(spark, tmp_path, ranges, size, indent):
    path = tmp_path / "x.json"
    path.write_text(json.dumps(NASTY, indent=indent, ensure_ascii=False))
    expected = texts(whole(spark, str(path)))
    assert len(expected) == len(NASTY)
    if size == 1 and indent:
        size = 9  # hundreds of one-byte tasks show nothing new
    ranges(size)
    assert texts(json_arrays.read_json_arrays(spark, str(path))) == expected


def random_value(rng, depth):
    kind = rng.random()
    if depth and kind < 0.35:
        return {"".join(rng.choices('ab}{"\\,', k=rng.randint(0, 4))): random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    if depth and kind < 0.5:
        return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, rng.randint(-9, 9), "".join(rng.choices('xy}{][",:\\\n é', k=rng.randint(0, 12)))])


def test_random_documents(spark, tmp_path, ranges):
    for seed in range(12):
        rng = random.Random(seed)
        folder = tmp_path / str(seed)
        folder.mkdir()
        for i in range(3):
            values = [random_value(rng, 4) if rng.random() < 0.3 else {"id": j, "v": random_value(rng, 3)} for j in range(rng.randint(0, 25))]
            (folder / f"{i}.json").write_text(json.dumps(values, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5))
        ranges(1 << 20)
        expected = texts(whole(spark, str(folder)))
        ranges(rng.randint(9, 200))
        assert texts(json_arrays.read_json_arrays(spark, str(folder))) == expected


def test_empty_files_spaces_and_marks(spark, tmp_path, ranges):
    contents = {"a.json": "[]", "b.json": "  [ ]\n", "c.json": '\ufeff[{"a":1} , {"b":2}]  \n\n', "d.json": "", "e.json": "[ \n{}\n]"}
    for name, content in contents.items():
        (tmp_path / name).write_text(content, encoding="utf-8")
    for size in (2, 1 << 20):
        ranges(size)
        assert texts(json_arrays.read_json_arrays(spark, str(tmp_path))) == ['{"a":1}', '{"b":2}', "{}"]


def test_a_cut_off_file_keeps_its_whole_elements(spark, tmp_path, ranges):
    (tmp_path / "x.json").write_text('[{"a":1},{"b":"}"},{"c":')
    for size in (4, 1 << 20):
        ranges(size)
        found = texts(json_arrays.read_json_arrays(spark, str(tmp_path)))
        assert found[1:] == ['{"b":"}"}', '{"c":'][:2] or sorted(found) == sorted(['{"a":1}', '{"b":"}"}', '{"c":'])


def test_one_file_is_many_tasks_and_its_bytes_move_once(spark, tmp_path, ranges):
    (tmp_path / "x.json").write_text(json.dumps([{"i": i, "s": "}" * (i % 5)} for i in range(4_000)]))
    ranges(4_096)
    cut = json_arrays.pieces(spark, str(tmp_path / "x.json"))
    assert cut.rdd.getNumPartitions() > 10
    assert cut.select("start").distinct().count() > 10
    found = json_arrays.read_json_arrays(spark, str(tmp_path / "x.json"))
    assert found.count() == 4_000
    assert sorted(json.loads(r.raw)["i"] for r in found.collect()) == list(range(4_000))
