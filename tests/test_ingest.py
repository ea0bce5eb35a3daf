"""Delimited text with drifting headers, and the other sources and sinks."""

import gzip

import pytest

from casesignal.operators import aggregate
from casesignal.sources import contract, tables, text


@pytest.fixture
def raw(tmp_path):
    def put(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content.encode("latin-1"))

    put("q1/DEMO_first.txt", 'primaryid$caseid$sex$age\n1$c1$F$30\n1$c1$F$30\n2$c2$NA$\n$c9$M$1\nNULL$c8$M$1\n3$c3$"M"$41$extra\n')
    put("q2/deep/DEMO_second.TXT", 'SEX$PRIMARYID$FDA_DT$CASEID\nM$4$20250101$"c""4"\nF$5\n')
    put("q2/DRUG_second.txt", "primaryid$drugname$role_cod\n1$caf\xe9$PS\n1$A\\B$SS\n")
    return str(tmp_path)


def test_demo(spark, raw):
    got = text.read_case_table(spark, raw, "DEMO")
    rows = {r["PRIMARYID"]: r for r in got.rows.collect()}
    assert got.rows.columns == list(text.CASE_TABLES["DEMO"])
    assert sorted(rows) == ["1", "2", "4", "5"] and got.rows.count() == 4
    assert (rows["1"]["SEX"], rows["1"]["AGE"], rows["1"]["FDA_DT"]) == ("F", "30", None)
    assert rows["2"]["SEX"] is None and rows["2"]["AGE"] is None
    assert (rows["4"]["SEX"], rows["4"]["CASEID"], rows["4"]["FDA_DT"]) == ("M", 'c"4', "20250101")
    assert (rows["5"]["SEX"], rows["5"]["FDA_DT"]) == ("F", None)
    rejected = got.rejected.collect()
    assert len(rejected) == 1 and rejected[0]["line"].startswith("3$")


def test_latin1_and_backslash(spark, raw):
    rows = text.read_case_table(spark, raw, "DRUG").rows.collect()
    assert sorted(r["DRUGNAME"] for r in rows) == ["A\\B", "caf\xe9"]


def test_line_breaks_inside_quotes(spark, tmp_path):
    """A quoted line break is part of its field; files without one are still split."""
    (tmp_path / "REAC_1.txt").write_text('primaryid$pt\n1$"line one\nline two"\n2$plain\n3$"two ""marks"" here"\n4$"a\n\nb$c"$surplus\n')
    (tmp_path / "REAC_2.txt").write_text('PRIMARYID$PT\n5$"closed"\n')
    files = text.look_at(spark, text.list_files(spark, str(tmp_path), "REAC*"), "$", "ISO-8859-1")
    assert [(f.header, f.whole) for f in files] == [(("PRIMARYID", "PT"), True), (("PRIMARYID", "PT"), False)]
    got = text.read_case_table(spark, str(tmp_path), "REAC")
    assert {tuple(r) for r in got.rows.collect()} == {("1", "line one\nline two"), ("2", "plain"), ("3", 'two "marks" here'), ("5", "closed")}
    bad = got.rejected.collect()
    assert len(bad) == 1 and bad[0].line.startswith('4$"a\n') and bad[0].error is None


def test_unreadable_files_are_set_aside(spark, tmp_path):
    """Broken from the start, or halfway: no row of such a file is taken."""
    many = "primaryid$pt\n" + "".join(f"{i}${i * i % 9973}x{i * 7919 % 10007}\n" for i in range(200_000))
    (tmp_path / "REAC_a.txt.gz").write_bytes(gzip.compress(b"primaryid$pt\n1$one\n"))
    (tmp_path / "REAC_b.txt.gz").write_bytes(b"no archive at all")
    (tmp_path / "REAC_c.txt.gz").write_bytes(gzip.compress(many.encode())[:-2000])
    (tmp_path / "REAC_d.txt.gz").write_bytes(gzip.compress(b"pt$primaryid\ntwo$2\n"))
    (tmp_path / "REAC_e.txt").write_bytes(b"")
    got = text.read_text_table(spark, str(tmp_path), ["PRIMARYID", "PT"], "REAC*")
    assert {tuple(r) for r in got.rows.collect()} == {("1", "one"), ("2", "two")}
    bad = {r.file.rsplit("/", 1)[1]: r for r in got.rejected.collect()}
    assert sorted(bad) == ["REAC_b.txt.gz", "REAC_c.txt.gz"] and all(r.line is None and r.error for r in bad.values())


def test_many_files_are_looked_at_in_one_job(spark, tmp_path):
    """Blank lines before a header, a byte order mark, a name twice, files of one line."""
    for i in range(60):
        (tmp_path / f"REAC_{i}.txt").write_text(f"{chr(10) * (i % 2)}PrimaryId$PT${'PT' if i % 3 else 'other'}\n{i}$p{i}$no\n")
    (tmp_path / "REAC_mark.txt").write_bytes(b"\xef\xbb\xbfprimaryid$pt\n100$x\n")
    (tmp_path / "REAC_none.txt").write_text("primaryid$pt\n")
    spark.sparkContext.setJobGroup("look", "look")
    try:
        files = text.look_at(spark, text.list_files(spark, str(tmp_path), "*.txt"), "$", "ISO-8859-1")
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("look")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(files) == 62 and len(jobs) < 10
    got = text.read_case_table(spark, str(tmp_path), "REAC").rows
    assert {tuple(r) for r in got.collect()} == {(str(i), f"p{i}") for i in range(60)} | {("100", "x")}


def test_no_files(spark, tmp_path):
    got = text.read_case_table(spark, str(tmp_path), "REAC")
    assert got.rows.columns == ["PRIMARYID", "PT"] and got.rows.count() == 0
    gone = text.read_case_table(spark, str(tmp_path / "absent"), "REAC")
    assert gone.rows.count() == 0 and gone.rejected.count() == 0


def test_csv_and_parquet(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b\\", 1.5, None)], "drug_name string, mol_weight double, HBD int")
    tables.write_csv(df, str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c"), df.schema).collect() == df.collect()
    tables.write_parquet(df, str(tmp_path / "p"))
    assert tables.read_parquet(spark, str(tmp_path / "p")).collect() == df.collect()


def test_cached_table_builds_once(spark, tmp_path):
    built = []

    def build(df):
        built.append(1)
        return df.distinct()

    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    other_order = spark.createDataFrame([(None,), ("b",), ("a",), ("a",)], "s string")
    for source in (df, other_order):
        assert tables.cached_table(source, "s", str(tmp_path), "t", build).count() == 3
    tables.cached_table(df.limit(1), "s", str(tmp_path), "t", build)
    assert len(built) == 2


def test_contract(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    with pytest.raises(contract.MissingColumns, match="demo lacks x"):
        contract.require_columns(df, ["a", "x"], "demo")
    assert contract.resolve_column(df, ["x", "b", "a"]) == "b"
    full = contract.ensure_columns(df, {"a": "int", "c": "double"})
    assert full.dtypes == [("a", "int"), ("b", "string"), ("c", "double")]
    assert contract.fill_nulls(full, {"b": "UNK", "c": 0}).first()[1:] == ("UNK", 0)


def test_aggregate_null_rules(spark):
    df = spark.createDataFrame(
        [(1, 2, "x"), (1, None, None), (2, None, "y"), (None, 5, "z")], "k int, v int, s string"
    )
    got = {r["k"]: r for r in aggregate.keyed(df, "k").groupBy("k").agg(*aggregate.property_stats({"v": ("sum", "mean", "std")})).collect()}
    assert got[1]["v_sum"] == 2 and got[2]["v_sum"] == 0 and got[2]["v_mean"] is None and got[1]["v_std"] is None
    assert {r["k"]: r["n"] for r in aggregate.rows_per(df, "k").collect()} == {1: 2, 2: 1}
    first = aggregate.first_per_key(df, "k", ["s"]).collect()
    assert {r["k"] for r in first} == {1, 2}


def test_tag_counts_add_duplicates(spark):
    df = spark.createDataFrame([(1, ["A", "A"]), (1, ["B"]), (2, []), (3, None)], "k int, t array<string>")
    got = aggregate.tag_counts(df, "k", "t", ["A", "B"]).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1)]
