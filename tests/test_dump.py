"""Indented dumps read by many tasks: every split position, layout and odd list against the plain reader."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from wattline.session import scratch_path
from wattline.sources.files import dump_separator, read_landed_dump, read_landed_payloads


def records(n, entries=2):
    return [{"priceArea": None if i % 7 == 0 else f'NO{i % 5} "}}\n    }}', "attributes": {"productionPerGroupMbaHour": [
        {"priceArea": None, "productionGroup": "vindå" * (1 + i % 3), "startTime": "}\n]", "quantityKwh": i + k / 4} for k in range(i % (entries + 1))]}}
        for i in range(n)]


def jackson(rows, indent):
    """Lists on the line of their first record, as the other common printer writes them."""
    texts = [json.dumps(r, indent=2).replace("\n", "\n" + indent) for r in rows]
    return "[ " + ", ".join(texts) + " ]"


LAYOUTS = {
    "list": lambda r: json.dumps(r, indent=4),
    "envelope": lambda r: json.dumps({"data": r}, indent=4),
    "tabs": lambda r: json.dumps(r, indent="\t", ensure_ascii=False) + "\n",
    "windows": lambda r: json.dumps({"data": r}, indent=2).replace("\n", "\r\n"),
    "same line": lambda r: jackson(r, ""),
    "same line, envelope": lambda r: '{\n  "data" : ' + jackson(r, "  ") + "\n}\n",
}


def saved(spark, tmp_path, text, name="dump.json"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return f"file:{path}"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("layout", LAYOUTS)
def test_a_dump_equals_the_plain_read_in_many_tasks(spark, tmp_path, layout):
    path = saved(spark, tmp_path, LAYOUTS[layout](records(1500)))
    want = rows(read_landed_payloads(spark, path))
    assert len(want) == 1500
    for size in (10_007, 65_536):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        try:
            got = read_landed_dump(spark, path)
            assert got.rdd.getNumPartitions() >= 3
            assert rows(got) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_every_split_position_gives_every_record_once(spark, tmp_path):
    text = json.dumps(records(6), indent=4)
    path = saved(spark, tmp_path, text)
    want = rows(read_landed_payloads(spark, path))
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    spark.conf.set("spark.sql.files.minPartitionNum", 1)
    try:
        # Cuts run over the separators that follow the second record, byte by byte.
        at = text.index("\n    }", text.index("\n    }") + 1)
        for size in range(at - 2, at + 12):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert rows(read_landed_dump(spark, path)) == want, size
    finally:
        for key in ("openCostInBytes", "minPartitionNum", "maxPartitionBytes"):
            spark.conf.unset(f"spark.sql.files.{key}")


@pytest.mark.parametrize("rows_in", [[], [{}], [{}, {}], [{}, *records(3)], [*records(3), {}, {}], [{}, *records(2), {}, *records(2)], records(1)])
@pytest.mark.parametrize("layout", ["list", "envelope", "windows"])
def test_lists_without_records_or_with_empty_ones(spark, tmp_path, rows_in, layout):
    path = saved(spark, tmp_path, LAYOUTS[layout](rows_in))
    assert rows(read_landed_dump(spark, path)) == rows(read_landed_payloads(spark, path))


def test_a_folder_of_several_layouts(spark, tmp_path):
    for i, layout in enumerate(LAYOUTS):
        saved(spark, tmp_path, LAYOUTS[layout](records(5)), f"{i}.json")
    for name in ("_SUCCESS", ".hidden", "none.json"):
        saved(spark, tmp_path, "" if name != ".hidden" else "x", name)
    got = rows(read_landed_dump(spark, f"file:{tmp_path}"))
    assert len(got) == 5 * len(LAYOUTS) and len(set(got)) == 5
    nothing = tmp_path / "nothing"
    nothing.mkdir()
    assert read_landed_dump(spark, f"file:{nothing}").collect() == []


@pytest.mark.parametrize("text", ["{}", '{"a": 1}', "17", '[{"priceArea": "NO1"}]', json.dumps(records(3), indent=4)[:-1],
                                  json.dumps({"data": records(3)}, indent=4)[:-1], json.dumps({"meta": 1, "data": records(2)}, indent=4)])
def test_other_layouts_and_cut_files_are_refused(spark, tmp_path, text):
    with pytest.raises(ValueError):
        read_landed_dump(spark, saved(spark, tmp_path, text))


@pytest.mark.parametrize("hurt", [lambda t: t.replace("    },\n", "    }\n", 1), lambda t: t.replace('"priceArea": ', '"priceArea" ', 1),
                                  lambda t: t[:-1].rstrip() + ",\n]", lambda t: t.replace("    },\n", "    },\n    5,\n", 1)])
def test_malformed_dumps_fail(spark, tmp_path, hurt):
    path = saved(spark, tmp_path, hurt(json.dumps([{"priceArea": "a"}, {"priceArea": "b"}, {"priceArea": "c"}], indent=4)))
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_landed_dump(spark, path).collect()


def test_separators():
    assert dump_separator('[\n    {\n        "a": 1', "\n    }\n]") == "\n    }"
    assert dump_separator('{\r\n  "data": [\r\n    {\r\n', "]\r\n}") == "\r\n    }"
    assert dump_separator('{\n  "data" : [ {\n', "} ]\n}") == "\n  }"
