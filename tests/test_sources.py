import pytest

from breathline.sources import files, tables


def test_csv_sink_appends_and_reads_back(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a", None), (2, "b,c", 2.5)], "id int, name string, x double")
    files.write_csv(df, path)
    files.write_csv(df, path, append=True)
    back = files.read_csv(spark, path, df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.union(df).collect()), key=str)
    files.write_csv(df, path)
    assert files.read_csv(spark, path, df.schema).count() == 2


def test_folder_scan_finds_headers_and_drops_bad_lines(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "a.csv").write_text('id,"na,me"\n1,x\n')
    (tmp_path / "deep" / "er" / "b.csv").write_text("id,value\n1,2\nbroken,row\n3,4\n")
    (tmp_path / "deep" / "c.txt").write_text("hidden\n")
    (tmp_path / "deep" / "d.csv").write_text("")
    names = {r.name for r in files.distinct_header_columns(spark, str(tmp_path)).collect()}
    assert names == {"id", "na,me", "value"}
    rows = files.read_csv_folder(spark, str(tmp_path / "deep"), "id int, value int").collect()
    assert sorted(map(tuple, rows)) == [(1, 2), (3, 4)]


def test_labelled_matrix(spark, tmp_path):
    tabbed = tmp_path / "t.txt"
    tabbed.write_text("1.0\t2.50\t1\n3\t4.000000\t0\n")
    got = files.read_labelled_matrix(spark, str(tabbed), 2, sep="\t").collect()
    assert sorted(map(tuple, got)) == [(1.0, 2.5, 1), (3.0, 4.0, 0)]
    ragged = tmp_path / "r.txt"
    ragged.write_text("2 1  38.5 ? 1 \n2 ? 37 4 9 2\n5 6\n")
    df = files.read_labelled_matrix(spark, str(ragged), 4)
    assert sorted(map(tuple, df.collect()), key=str) == [(2.0, 1.0, 38.5, None, 1), (2.0, None, 37.0, 4.0, 2)]
    filled = files.fill_missing(df, ["x1", "x3"]).collect()
    assert sorted(r.x1 for r in filled) == [0.0, 1.0]


def test_jdbc_options_partition_by_stay():
    plain = tables.jdbc_options("jdbc:x", "lab", "icu")
    assert plain["dbtable"] == "icu.lab" and "partitionColumn" not in plain
    ranged = tables.jdbc_options("jdbc:x", "lab", bounds=(1, 9), partitions=4, properties={"user": "u"})
    assert (ranged["lowerBound"], ranged["upperBound"], ranged["numPartitions"]) == ("1", "9", "4")
    assert ranged["user"] == "u"


def test_catalog_listing_and_lookup(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (2, 4.0)], "id bigint, v double")
    df.createOrReplaceTempView("lookup_rows")
    listed = {tuple(r) for r in tables.list_columns(spark).collect()}
    assert {("lookup_rows", "id", "bigint"), ("lookup_rows", "v", "double")} <= listed
    assert tables.rows_of_key(df, "id", 2).count() == 2
    ids = spark.createDataFrame([(1,), (1,)], "id bigint")
    assert tables.rows_of_keys(df, ids, "id").count() == 1
    spark.catalog.dropTempView("lookup_rows")


def test_malformed_line_is_an_error_unless_dropped(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("id,value\n1,2\n2,abc\n3,4\n")
    with pytest.raises(Exception, match="[Mm]alformed|MALFORMED"):
        files.read_csv(spark, str(path), "id int, value int").select("id").collect()
    kept = files.read_csv(spark, str(path), "id int, value int", drop_malformed=True)
    assert kept.count() == 2 and sorted(r.id for r in kept.select("id").collect()) == [1, 3]


def test_header_of_any_length_and_with_line_breaks(spark, tmp_path):
    names = [f"a_rather_long_column_name_{i}" for i in range(60_000)]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n")
    (tmp_path / "odd.csv").write_text('"a\nb",c\n1,2\n')
    found = files.header_columns(spark, str(tmp_path)).collect()
    assert [r.name for r in sorted(found, key=lambda r: r.position) if r.path.endswith("wide.csv")] == names
    assert {(r.position, r.name) for r in found if r.path.endswith("odd.csv")} == {(0, "a\nb"), (1, "c")}


def test_ragged_lines_are_reported(spark, tmp_path):
    path = tmp_path / "r.txt"
    path.write_text("1 2 0\n1 2 3 0\n5 6\n\n")
    got = {tuple(r) for r in files.ragged_lines(spark, str(path), 2).collect()}
    assert got == {("1 2 3 0", 4), ("5 6", 2)}


def test_matrix_source_equals_the_lines_whatever_the_ranges(spark, tmp_path):
    from pyspark.sql import functions as F

    from breathline.sources.matrix_source import lines_of, plan_ranges, use_matrix_source

    use_matrix_source(spark)
    lines = [f"{i} {i / 7} ? {-i}e-2 {i % 3}" for i in range(400)]
    lines[5], lines[9], lines[12], lines[20] = "1 2 3", "1 2 3 4 1 9 9", "1 two 3 4 1", ""
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.txt").write_text("\n".join(lines))
    (tmp_path / "m" / "b.txt").write_text("7 8 9 10 1\r\n")
    (tmp_path / "m" / "_c.txt").write_text("hidden 1 2 3 4 5\n")
    path = str(tmp_path / "m")
    for size in (1, 13, 100, 5000, 1 << 20):
        found = [x for part in plan_ranges(path, size) for chunk in lines_of(part) for x in chunk.to_pylist()]
        assert found == [*lines, "7 8 9 10 1\r"], size
    df = spark.read.format("labelled_matrix").option("features", 4).option("split_bytes", 777).load(path)
    assert df.rdd.getNumPartitions() > 5
    rows = df.collect()
    assert len(rows) == 400
    bad = {r._line: r for r in rows if r._reason}
    assert {k: r._reason for k, r in bad.items()} == {"1 2 3": "few fields", "1 2 3 4 1 9 9": "many fields", "1 two 3 4 1": "not a number"}
    assert bad["1 2 3"].x0 is None and bad["1 two 3 4 1"].x1 is None and bad["1 two 3 4 1"].x2 == 3.0 and bad["1 2 3 4 1 9 9"].x3 == 4.0
    plain = files.read_labelled_matrix(spark, path + "/[ab].txt", 4).filter("x0 <> 1").collect()
    mine = df.filter("_reason IS NULL AND x0 <> 1").select("x0", "x1", "x2", "x3", "label").collect()
    assert sorted(map(tuple, plain), key=str) == sorted(map(tuple, mine), key=str)
    few = spark.read.format("labelled_matrix").schema("label int, x3 double").option("features", 4).load(path)
    assert few.columns == ["label", "x3"] and few.filter("x3 = 10 and label = 1").count() == 1
    with pytest.raises(Exception, match="no column y"):
        spark.read.format("labelled_matrix").schema("y int").option("features", 4).load(path).collect()


def test_a_batch_is_added_once_whatever_dies(spark, tmp_path):
    import os

    from breathline.sources import batches

    path, schema = str(tmp_path / "out"), "id long, name string"
    rows = spark.range(0, 1000, 1, 4).selectExpr("id", "concat('n,', id) AS name")
    assert batches.read_batches(spark, path, schema).count() == 0

    def dies(parts):
        for frame in parts:
            yield frame
            if (frame["id"] >= 700).any():
                os._exit(1)

    with pytest.raises(Exception):
        batches.append_batch(rows.mapInPandas(dies, schema), path, "one")
    assert batches.manifests(path) == {} and batches.read_batches(spark, path, schema).count() == 0
    for _ in range(3):
        batches.append_batch(rows, path, "one")
    batches.append_batch(rows.filter("id < 10"), path, "two")
    batches.append_batch(rows.filter("id < 0"), path, "empty")
    assert {k: m["rows"] for k, m in batches.manifests(path).items()} == {"one": 1000, "two": 10, "empty": 0}
    got = batches.read_batches(spark, path, schema)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect() + rows.filter("id < 10").collect()))
    batches.drop_leftovers(path)
    assert got.count() == 1010 and batches.drop_leftovers(path) == 0
    for bad in ("", "../x", "a/b"):
        with pytest.raises(Exception):
            batches.append_batch(rows, path, bad)


def test_balanced_predicates_cover_each_row_once(spark, tmp_path):
    from pyspark.sql import functions as F

    ids = [*range(1, 500), *[77] * 3000, *range(100_000, 100_200), None, None]
    df = spark.createDataFrame(list(enumerate(ids)), "row long, id long").coalesce(1)
    df.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    low, high = 1, 100_199
    for parts, ranges, spread in ((8, 4096, "row"), (8, 4096, None), (1, 16, None), (3, 1, "row"), (50, 100_199, "row")):
        counts = [(r["at"], r["n"]) for r in tables.range_histogram(table, "id", low, high, ranges).collect()]
        made = tables.balanced_predicates(counts, "id", low, high, parts, ranges, spread)
        fits = [F.expr(f"CASE WHEN {p} THEN 1 ELSE 0 END") for p in made]
        assert table.filter(sum(fits[1:], fits[0]) != 1).count() == 0
        sizes = [table.filter(p).count() for p in made]
        if spread and ranges > 1000:
            assert max(sizes) < 2.1 * len(ids) / parts and len(made) < 2 * parts + 3
    assert tables.balanced_predicates([], "id", 1, 5, 4) == ["(id IS NOT NULL OR id IS NULL)"]
