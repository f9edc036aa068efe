import zipfile

import pytest

from samewise.config import ErConfig
from samewise.operators import decide as D
from samewise.operators import validate as V
from samewise.operators.packed import explode_packed, split_packed
from samewise.sources import sinks, tables

TSV = 'entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Quoted" Ltd\t\tUS\nS1-2\tnull\tA, B\t\n'


def test_tsv_scan(spark, tmp_path):
    (tmp_path / "train").mkdir()
    path = tmp_path / "train" / "train_source1.tsv"
    path.write_text(TSV)
    rows = tables.read_tsv(spark, str(path)).orderBy("entity_id").collect()
    assert [tuple(r) for r in rows] == [("S1-1", '"Quoted" Ltd', "", "US"), ("S1-2", "null", "A, B", "")]
    assert tables.find_source(spark, str(tmp_path), "train", 1).endswith("train/train_source1.tsv")
    assert tables.find_source(spark, str(tmp_path), "test", 1) is None
    assert sorted(r.id for r in tables.read_id_set(spark, str(path)).collect()) == ["S1-1", "S1-2"]


def test_prepared_round_trip_and_pruning(spark, tmp_path):
    df = spark.createDataFrame([("S1-1", "A", "1 x", "US"), ("S1-2", "B", "2 y", "France")], "entity_id string, business_name string, business_address string, country string")
    path = str(tmp_path / "p")
    tables.write_prepared(df, path)
    tables.write_prepared(df.limit(0), path)  # it is there, so nothing happens
    some = tables.load_prepared(spark, path, ["entity_id", "addr"], "france")
    assert [tuple(r) for r in some.collect()] == [("S1-2", "2 y")]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(land" in plan and "business_name" not in plan


def test_one_row_per_id_takes_the_latest(spark, tmp_path):
    df = spark.sql("select * from values ('S1-1','old','a','US',timestamp'2020-01-01'),('S1-1','new',null,'US',timestamp'2021-01-01'),(null,'x','y','z',timestamp'2021-01-01') t(entity_id,business_name,business_address,country,loaded_at)")
    df.write.parquet(str(tmp_path / "s"))
    assert [tuple(r) for r in tables.source_table(spark, str(tmp_path / "s")).collect()] == [("S1-1", "new", "", "us")]


def test_sink_then_validator_passes(spark, tmp_path):
    scored = spark.createDataFrame([("S1-1", "S2-1", 0.5, 0.9), ("S1-1", "S3-2", 0.5, 0.8)], "s1 string, cand string, score double, p double")
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "id string")
    path = str(tmp_path / "m")
    sinks.write_id_lists(D.id_lists(D.decide(scored, "thr"), ids, "id"), path, order="s1")
    part = next((tmp_path / "m").glob("part-*"))
    assert part.read_text() == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2\nS1-2\t\n"
    errors, warnings = V.validate_outputs(spark, path, ids, str(tmp_path / "none"))
    assert errors == [] and len(warnings) == 2
    sinks.package([path], str(tmp_path / "z.zip"))
    assert zipfile.ZipFile(tmp_path / "z.zip").namelist() == ["m.tsv"]


@pytest.mark.parametrize(
    ("body", "issue"),
    [("S1-1\tS2-1\nS1-1\t\nS1-2\t", "duplicate_row"), ("S1-1\tS2-1,S2-1\nS1-2\t", "repeated_id"), ("S1-1\tS1-2\nS1-2\t", "self_match"), ("S1-1\tS2-1,\nS1-2\t ", "wrong_prefix"), ("S1-1\t", "missing_row"), ("S1-1\t\nS1-2\t\nS1-3\t", "extra_row"), ("S1-1\t\nS1-2\t\nbad", "malformed_row"), ("S1-1\tS2-9\nS1-2\t", "unknown_id")],
)
def test_validator_finds_each_issue(spark, tmp_path, body, issue):
    path = tmp_path / "f.tsv"
    path.write_text("source1_entity_id\tmatched_entity_ids\n" + body + "\n\n")
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "id string")
    valid = spark.createDataFrame([("S2-1",)], "id string")
    errors, _ = V.validate_outputs(spark, str(path), ids, valid=valid)
    assert len(errors) == 1 and issue in errors[0]


def test_validator_fatal_errors_and_warning(spark, tmp_path):
    ids = spark.createDataFrame([("S1-1",)], "id string")
    (tmp_path / "c.tsv").write_text("source1_entity_id,matched_entity_ids\n")
    (tmp_path / "h.tsv").write_text("a\tb\n")
    (tmp_path / "m.tsv").write_text("Source1_Entity_ID\t matched_entity_ids\nS1-1\tS2-1\n")
    (tmp_path / "k.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-2\n")
    assert "comma_separated" in V.validate_outputs(spark, str(tmp_path / "c.tsv"), ids)[0][0]
    assert "unexpected_header" in V.validate_outputs(spark, str(tmp_path / "h.tsv"), ids)[0][0]
    assert "file_not_found" in V.validate_outputs(spark, str(tmp_path / "none.tsv"), ids)[0][0]
    errors, warnings = V.validate_outputs(spark, str(tmp_path / "m.tsv"), ids, str(tmp_path / "k.tsv"))
    assert errors == [] and any("outside_candidates" in w for w in warnings)


def test_stage_is_kept_by_its_settings(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for k in (1, 1, 2):
        assert sinks.stage(spark, sinks.stage_path(str(tmp_path), "x", k=k), make).count() == 3
    assert len(made) == 2
    sinks.write_metadata({"K": 7}, str(tmp_path / "m.json"))
    assert sinks.read_metadata(str(tmp_path / "m.json")) == {"K": 7}


def test_settings_from_environment():
    c = ErConfig.from_env({"ER_K": "5", "ER_THR": "0.4", "ER_CE_MODE": "full", "ER_BACKEND": "cpu"})
    assert (c.k, c.decision.thr, c.rerank, c.strategy) == (5, 0.4, "full", "relational")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []), ("", []), ("  ", []), ("n/a", []), ("None", []), ("[]", []), ('""', []), (",", []), ("-", []), ("a,b", ["a", "b"]), ("a;b|c / d\te\nf g", list("abcdefg")),
        ('["a", "b"]', ["a", "b"]), ("{a,b}", ["a", "b"]), ("'a','a'", ["a", "a"]), ('"S3-1;2",S2-1', ["S3-1;2", "S2-1"]), ('"S3-1, C"', ["S3-1, C"]), (',a,,"b" | ', ["a", "b"]),
        ('"a""b",c', ['a"b', "c"]), ('"a\\"b",c', ['a"b', "c"]), ("a(b,c),d", ["a(b,c)", "d"]), ('"open', ["open"]), ("a, n/a, none, b", ["a", "b"]), ("“x, y”; z", ["x, y", "z"]),
    ],
)
def test_packed_values(text, want):
    assert split_packed(text) == want


def test_packed_positions_long_fields_and_other_columns(spark):
    long = ",".join(f"v{i}" for i in range(20_000))
    df = spark.createDataFrame([("k", 'x,"y,z"', 1, "c"), ("n", None, 2, "c"), (None, "q", 3, "c"), ("l", long, 4, "c")], "id string, packed string, pos int, value string")
    rows = explode_packed(df, "id", "packed").collect()
    assert {tuple(r) for r in rows if r.id != "l"} == {("k", 1, "x"), ("k", 2, "y,z"), (None, 1, "q")}
    assert sum(r.id == "l" for r in rows) == 20_000
    assert explode_packed(df.limit(0), "id", "packed").count() == 0
