import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pairlens.operators import clean, codes
from pairlens.session import materialize, scratch_path, shared_dir
from pairlens.sources import read_replicate, read_source, replicate_ids, write_replicates

from conftest import as_set


def test_headerless_csv_is_named_by_position(spark, tmp_path):
    (tmp_path / "x.csv").write_text("2,NA,41\n3,b,-9\n")
    got = read_source(spark, str(tmp_path / "x.csv"), "code int, name string, deg double", "csv", False, ["-9", "NA"], ["code", "deg", "name"])
    assert got.columns == ["code", "deg", "name"]
    assert as_set(got, "code", "deg", "name") == {(2, 41.0, None), (3, None, "b")}


def test_csv_with_header_and_sentinel(spark, tmp_path):
    (tmp_path / "y.csv").write_text("code,imports\n2,-9\n3,1.5\n")
    got = read_source(spark, str(tmp_path / "y.csv"), "code int, imports double", "csv", True, ["-9"])
    assert as_set(got, "code", "imports") == {(2, None), (3, 1.5)}


def test_replicates_round_trip(rows, spark):
    df = rows([(i, j, k, k * 1.5) for i in (1, 2) for j in (1, 2, 3) for k in range(4)], "imp_i int, imp_j int, k int, v double")
    path = scratch_path(spark, "reps")
    write_replicates(df, path)
    assert replicate_ids(spark, path) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]
    assert read_replicate(spark, path, imp_i=2, imp_j=3).count() == 4
    plan = read_replicate(spark, path, imp_i=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(imp_i" in plan


def test_shared_folder_comes_from_the_session(spark, rows):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named
    stored = materialize(rows([(1,)], "x int"), "probe")
    assert stored.count() == 1 and all(f"{named}/probe-" in f for f in stored.inputFiles())


def test_shared_folder_falls_back_to_a_temporary_one():
    """A session of its own, because the setting of the tests' session cannot be taken back."""
    code = (
        "from pairlens.session import local_session, shared_dir\n"
        "s = local_session(1, 1, 'no-shared-folder')\n"
        "first = shared_dir(s)\n"
        "assert first and shared_dir(s) == first and s.conf.get('spark.checkpoint.dir', None) is None\n"
        "s.stop()\nprint('fell back')"
    )
    root = Path(__file__).resolve().parents[1]
    run = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert "fell back" in run.stdout, run.stderr[-2000:]


def test_conform_codes_uses_validity_intervals(rows):
    mapping = rows([(10, 0, 1990, "10"), (10, 1991, 9999, "11"), (12, 0, 9999, None)], "raw_code int, valid_from int, valid_to int, canonical_code string")
    df = rows([(10, 1990), (10, 1991), (12, 1991), (13, 1991)], "code int, year int")
    kept = codes.conform_codes(df, "code", "year", mapping, key_name="key")
    assert as_set(kept, "code", "year", "key") == {("10", 1990, "10_1990"), ("11", 1991, "11_1991")}
    every = codes.conform_codes(df, "code", "year", mapping, drop_invalid=False)
    assert sorted(every.select("code").collect(), key=str) == sorted([("10",), ("11",), (None,), (None,)], key=str)


def test_conform_two_code_columns(rows):
    mapping = rows([(1, 0, 99, 5), (2, 0, 99, 2)], "raw_code int, valid_from int, valid_to int, canonical_code int")
    df = rows([(1, 2, 7), (1, 3, 7)], "a int, b int, year int")
    assert as_set(codes.conform_codes(df, ["a", "b"], "year", mapping), "a", "b", "year") == {(5, 2, 7)}


def test_conform_codes_normalizes_text(rows):
    mapping = rows([(2, 0, 99, 2), (20, 0, 99, 21)], "raw_code int, valid_from int, valid_to int, canonical_code int")
    df = rows([("002", 5), (" 20", 5), ("x", 5)], "code string, year int")
    got = codes.conform_codes(df, "code", "year", mapping, normalize=True)
    assert as_set(got, "code", "year") == {("2", 5), ("21", 5)}


def test_canonical_code_and_display_key(rows):
    df = rows([("002",), (" 20 ",), ("x",), (None,)], "c string").select("c", codes.canonical_code(F.col("c")).alias("k"))
    assert as_set(df, "c", "k") == {("002", "2"), (" 20 ", "20"), ("x", None), (None, None)}
    keys = rows([(None, 1920), (2, 1920)], "c int, y int").select(codes.display_key(F.col("c"), F.col("y")).alias("k"))
    assert as_set(keys, "k") == {(None,), ("2_1920",)}


def test_group_filter_any_and_none(rows):
    df = rows([(1, 5, "a"), (1, 1, "b"), (2, 1, "a"), (3, 9, None)], "g int, v int, c string")
    assert as_set(codes.group_filter(df, "g", any_=F.col("v") >= 4), "g", "v") == {(1, 5), (1, 1), (3, 9)}
    assert as_set(codes.group_filter(df, "g", none_=F.col("c").isNull()), "g") == {(1,), (2,)}
    assert as_set(codes.group_filter(df, "g", F.col("v") >= 4, F.col("c").isNull()), "g") == {(1,)}


def test_sentinels_and_special_codes(rows):
    df = rows([(1, -9.0, -66), (2, 3.0, 5), (3, None, None)], "i int, x double, p int").withColumn("p2", F.lit(0))
    assert as_set(clean.sentinel_to_null(df, ["x"], -9.0), "i", "x") == {(1, None), (2, 3.0), (3, None)}
    assert as_set(clean.recode_special(df, "p", [-66, -77], "p2"), "i", "p") == {(1, 0), (2, 5), (3, None)}


def test_patch_rows_modes(rows):
    df = rows([(1, 1990, 5.0), (1, 1991, 6.0)], "u int, y int, v double")
    patch = clean.expand_ranges(rows([(1, 9.0, 1991, 1992), (2, 9.0, 5, 4)], "u int, v double, a int, b int"), "a", "b", "y")
    assert as_set(clean.patch_rows(df, patch, ["u", "y"]), "u", "y", "v") == {(1, 1990, 5.0), (1, 1991, 9.0), (1, 1992, 9.0)}
    assert clean.patch_rows(df, patch, ["u", "y"], "append").count() == 4
    cloned = clean.clone_rows(df, F.col("y") == 1990, {"u": F.lit(7)}, ["u", "y"])
    assert as_set(cloned, "u", "y", "v") == {(1, 1990, 5.0), (1, 1991, 6.0), (7, 1990, 5.0)}
    with pytest.raises(ValueError):
        clean.patch_rows(df, patch, ["u", "y"], "replace")


def test_patch_values_leaves_cells_without_a_value(rows):
    df = rows([(1, 1.0, "a"), (2, 2.0, "b")], "k int, x double, s string")
    patch = rows([(2, 9.0, None)], "k int, x double, s string")
    assert as_set(clean.patch_values(df, patch, "k", ["x", "s"]), "k", "x", "s") == {(1, 1.0, "a"), (2, 9.0, "b")}


def test_drop_ineligible_open_bounds(rows):
    df = rows([(u, y) for u in (1, 2, 3) for y in (1, 2, 3)], "u int, y int")
    rules = rows([(1, None, None), (2, None, 2), (3, 3, None)], "u int, drop_from int, drop_to int")
    assert as_set(clean.drop_ineligible(df, rules, "u", "y"), "u", "y") == {(2, 3), (3, 1), (3, 2)}


def test_fill_defaults_under_condition(rows):
    df = rows([(1, None), (2, None), (None, None), (1, 5)], "y int, v int")
    assert sorted(r[1] for r in clean.fill_defaults(df, {"v": 0}).collect()) == [0, 0, 0, 5]
    part = clean.fill_defaults(df, {"v": 0}, F.col("y") != 2)
    assert as_set(part, "y", "v") == {(1, 0), (2, None), (None, None), (1, 5)}


def test_keep_first_and_duplicate_audit(rows):
    df = rows([(1, 3, "c"), (1, 2, "b"), (1, 2, "a"), (2, None, "z")], "k int, o int, s string")
    assert as_set(clean.keep_first(df, "k", ["o"]), "k", "o", "s") == {(1, 2, "a"), (2, None, "z")}
    assert as_set(clean.duplicate_audit(df, "k"), "k", "n") == {(1, 3)}


def test_coverage_and_missing_profile(rows):
    universe = rows([(1, 1, "x"), (1, 2, "y"), (1, 3, "z"), (2, 1, "w")], "u int, y int, abb string")
    got = clean.coverage_audit(universe, rows([(1, 1), (2, 1)], "u int, y int"), ["u", "y"], "u", "y", "abb")
    assert as_set(got, "u", "abb", "first_missing", "last_missing", "n_missing") == {(1, "y", 2, 3, 2)}
    prof = clean.missing_profile(rows([(1, None), (None, None), (3, 1)], "a int, b int"))
    assert {r[0]: round(r[1], 6) for r in prof.collect()} == {"a": 33.3, "b": 66.7}


def test_complete_cases_keeps_everything_when_nothing_is_missing(rows):
    assert clean.complete_cases(rows([(1, 2), (3, 4)], "a int, b int")).count() == 2
    assert clean.complete_cases(rows([(1, None), (3, 4)], "a int, b int")).count() == 1
    assert clean.complete_cases(rows([(1, None), (3, 4)], "a int, b int"), ["a"]).count() == 2
