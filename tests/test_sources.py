import pytest
from conftest import rows

import ensemblescope as es
from ensemblescope.session import scratch_path
from ensemblescope.sources import readers, schema, writers


def write_text(path, text):
    path.write_text(text)
    return str(path)


LONG_CSV = """Model,SCENARIO,region,Variable,year,value,Category
M1,S1,World,A|x,2030,,C1
M1,S1,World,A|x,2030,5.0,C1
M1,S1,World,A|x,2030,4.0,C1
M1,S1,World,B,2030,NaN,NA
M1,S1,"Wor""ld, x",B,2030,n/a,C1
"""


def test_csv_headers_types_and_missing_texts(spark, tmp_path):
    df = readers.read_scenarios(spark, write_text(tmp_path / "a.csv", LONG_CSV))
    assert df.columns == ["model", "scenario", "region", "variable", "year", "value", "category"]
    assert dict(df.dtypes)["year"] == "int" and dict(df.dtypes)["value"] == "double"
    assert [r.value for r in df.collect()] == [None, 5.0, 4.0, None, None]
    assert df.where("category is null").count() == 1
    assert df.where("""region = 'Wor"ld, x'""").count() == 1


def test_first_value_in_file_order(spark, tmp_path):
    path = write_text(tmp_path / "a.txt", LONG_CSV)
    long = es.tidy(readers.read_scenarios(spark, path, input_order=True))
    assert rows(es.first_cells(long), "variable", "value") == [("A|x", 5.0)]
    copy = writers.write_table(readers.read_scenarios(spark, path), str(tmp_path / "b.parquet"), "parquet")
    long = es.tidy(readers.read_scenarios(spark, copy, input_order=True))
    assert rows(es.first_cells(long), "variable", "value") == [("A|x", 5.0)]


def test_year_filter_reaches_the_parquet_scan_with_input_order(spark, tmp_path):
    path = str(tmp_path / "c.parquet")
    spark.createDataFrame([("m", "s", "A", 2030, 1.0)], "model string, scenario string, variable string, year int, value double").write.parquet(path)
    long = es.tidy(readers.read_scenarios(spark, path, input_order=True)).where("year = 2030")
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(year,2030)" in plan


def test_category_map_headers(spark, tmp_path):
    path = write_text(tmp_path / "c.csv", "Models,Scenario,CATEGORIES,extra\nM,S,C1,z\n")
    assert rows(readers.read_category_map(spark, path)) == [("M", "S", "C1")]
    with pytest.raises(ValueError, match="category"):
        readers.read_category_map(spark, write_text(tmp_path / "d.csv", "model,scenario\nM,S\n"))


def test_sector_map_needs_its_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="Sector"):
        readers.read_sector_map(spark, write_text(tmp_path / "s.csv", "Variable,sector\nA,x\n"))


def test_detect_format(spark):
    def frame(*columns):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))

    assert schema.detect_format(frame("variable", "year", "value")) == schema.LONG
    assert schema.detect_format(frame("variable", "2030", "2050")) == schema.SEMI_WIDE
    assert schema.detect_format(frame("model", "A (2030)")) == schema.WIDE
    with pytest.raises(ValueError, match="unknown layout"):
        schema.detect_format(frame("model", "203"))


def test_scenario_keys():
    assert schema.scenario_keys(["region", "category"]) == ["model", "scenario", "region", "category"]
    assert schema.scenario_keys(["category", "temp_bucket"]) == ["model", "scenario", "temp_bucket"]


def test_output_paths_and_formats(spark, tmp_path):
    assert writers.default_output_path("/a/b.csv", "parquet") == "/a/b_pivoted.parquet"
    with pytest.raises(ValueError):
        writers.default_output_path("/a/b.csv", "xlsx")
    with pytest.raises(ValueError):
        writers.write_table(spark.range(1), str(tmp_path / "x"), "xlsx")


def test_pivot_file(spark, tmp_path):
    path = write_text(
        tmp_path / "semi.csv",
        "Model,Scenario,Variable,Category,2030,2050\nM1,S1,A,C1,1.5,\nM1,S1,B,C1,2,3\nM2,S1,A,C9,,\n",
    )
    target = es.pivot_file(spark, path)
    assert target == str(tmp_path / "semi_pivoted.csv")
    wide = es.read_table(spark, target)
    assert wide.columns == ["model", "scenario", "temp_bucket", "A (2030)", "B (2030)", "B (2050)"]
    assert rows(wide) == [("M1", "S1", "1.5", 1.5, 2.0, 3.0)]
    assert es.pivot_file(spark, target) == target


def test_load_with_category_map(spark, tmp_path):
    data = write_text(tmp_path / "l.csv", "model,scenario,variable,year,value\nM,S,A,2030,1\nM,T,A,2030,2\n")
    mapping = write_text(tmp_path / "m.csv", "Model,Scenario,Category\nM,S,C2\n")
    long = es.load_scenarios(spark, data, mapping)
    assert rows(long, "scenario", "temp_bucket") == [("S", "1.5"), ("T", None)]


def test_rewrite_needs_another_path(spark):
    with pytest.raises(ValueError):
        es.rewrite_with_bucket(spark, "/tmp/x", "/tmp/x/")


def test_long_table_is_partitioned_by_year(spark):
    df = spark.createDataFrame([("A", 2030, 1.0), ("B", 2050, 2.0)], "variable string, year int, value double")
    path = es.write_long(df, scratch_path(spark, "t"))
    plan = spark.read.parquet(path).where("year = 2030")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_malformed_numbers_are_not_lost(spark, tmp_path):
    path = str(tmp_path / "odd.csv")
    lines = ["model,scenario,variable,year,value", "m,s,v,2030.0,1.5", "m,s,v,2031,NA", 'm,s,v,2032,"1,5"', "m,s,v,2033.5,2"]
    (tmp_path / "odd.csv").write_text("\n".join(lines[:3]))
    assert rows(readers.read_scenarios(spark, path), "year", "value") == [(2030, 1.5), (2031, None)]
    for bad in lines[3:]:
        (tmp_path / "odd.csv").write_text("\n".join([*lines[:2], bad]))
        with pytest.raises(Exception, match="not a number"):
            readers.read_scenarios(spark, path).collect()
        assert readers.read_scenarios(spark, path, malformed="null").where("value is null or year is null").count() == 1


def test_input_order_is_one_number_and_keeps_hash_aggregates(spark, tmp_path):
    for kind in ("csv", "parquet"):
        path = str(tmp_path / f"rows x.{kind}")
        frame = spark.range(1000).selectExpr("'m' model", "'s' scenario", "'v' variable", "2030 year", "cast(id as double) value")
        frame.repartition(5).write.option("header", True).format(kind).save(path)
        df = readers.read_scenarios(spark, path, input_order=True)
        assert df.where("input_order is null").count() == 0 and df.select("input_order").distinct().count() == 1000
        plan = es.first_cells(es.tidy(df))._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "Sort [" not in plan


def test_more_columns_than_a_table_holds_go_into_groups(spark, tmp_path):
    from ensemblescope.sources import column_groups as groups

    rows = [("m", f"s{k}", "r" if k else None, f"v{i}", 2030 + i % 2, float(k * 100 + i)) for k in range(4) for i in range(25) if (i + k) % 7]
    cells = spark.createDataFrame(rows, "model string, scenario string, region string, variable string, year int, value double")
    source = f"{tmp_path}/long.parquet"
    cells.where("region is not null").coalesce(1).write.parquet(source)
    path = es.pivot_file(spark, source, f"{tmp_path}/wide", most_columns=10)
    assert path.endswith(".groups")
    back = es.load_scenarios(spark, path)
    wanted = sorted(r[1:] for r in rows if r[2])
    assert sorted((r.scenario, r.region, r.variable, r.year, r.value) for r in back.collect()) == wanted
    plain = es.pivot_file(spark, source, f"{tmp_path}/plain.parquet", fmt="parquet")
    wide = spark.read.parquet(plain)
    names = groups.column_names(spark, path)
    assert set(names) == {c for c in wide.columns if "(" in c} and len(names) == 25
    some = [names[0], names[13], names[24]]
    picked = groups.read_columns(spark, path, some)
    assert sorted(map(tuple, picked.select("scenario", *[f"`{c}`" for c in some]).collect())) == sorted(map(tuple, wide.select("scenario", *[f"`{c}`" for c in some]).collect()))
    with pytest.raises(ValueError, match="no columns"):
        groups.read_columns(spark, path, ["nope (2030)"])


def test_ten_thousand_columns_keep_the_plan_flat(spark, tmp_path):
    from ensemblescope.sources import column_groups as groups

    rows = [("m", f"s{k}", f"v{i}", 2030, float(i)) for k in range(2) for i in range(0, 10_000, 3)]
    cells = spark.createDataFrame(rows, "model string, scenario string, variable string, year int, value double")
    columns = [(f"v{i}", 2030) for i in range(10_000)]
    path = groups.write_column_groups(cells, columns, f"{tmp_path}/w.groups")
    values = spark.read.parquet(f"{path}/values")
    assert len(values.columns) == 4 and values.count() == 20
    assert groups.read_long(spark, path).count() == len(rows)
    assert len(groups.read_long(spark, path)._jdf.queryExecution().optimizedPlan().toString()) < 5000
