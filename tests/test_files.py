import warnings

import pytest

from subpanel.operators import master
from subpanel.sources import files, tables
from tests.conftest import values


@pytest.fixture()
def root(tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    put("N5/N5_202503.csv", "isdn,topup_amount,topup_channel\na,10,x\nb,,y\n")
    put("N5/N5_202504.csv", "topup_channel,isdn,topup_amount\nz,a,20\n")          # other order
    put("N5/N5_202505.csv", "isdn,topup_amount\nc,30\n")                          # column missing
    put("N5/N5_202502.csv", "isdn,topup_amount,topup_channel\nold,1,x\n")        # outside the panel
    put("N5/other_202503.csv", "isdn,topup_amount,topup_channel\nno,1,x\n")      # not of the source
    put("N10/N10_202503.csv", "isdn,subscriber_type,subscriber_status,status_detail,activation_date,expire_date\n"
                              "a,PRE,ACTIF,d,1/3/2024,01/03/2034\n")
    return str(tmp_path)


def test_files_with_differing_headers(spark, root):
    df = files.read_source(spark, root, "N5")      # all months found
    assert values(df, "isdn", "topup_amount", "topup_channel", "data_month") == sorted([
        ("old", "1", "x", "202502"),
        ("a", "10", "x", "202503"), ("b", None, "y", "202503"), ("a", "20", "z", "202504"), ("c", "30", None, "202505")], key=repr)


def test_month_filter(spark, root):
    assert values(files.read_source(spark, root, "N5", ["202504"]), "isdn") == [("a",)]
    assert files.read_source(spark, root, "N5", None).count() == 5


def test_months_found(spark, root):
    assert files.months_found(spark, root, "N5") == ["202502", "202503", "202504", "202505"]
    assert files.months_found(spark, root, "N4") == []


def test_explicit_files_skip_the_month_filter(spark, root):
    df = files.read_source(spark, root, "N5", files=[f"{root}/N5/N5_202502.csv"])
    assert values(df, "isdn", "data_month") == [("old", "202502")]


def test_explicit_folder_of_part_files(spark, root, tmp_path):
    folder = str(tmp_path / "elsewhere" / "N5_202507")
    spark.createDataFrame([("p", "NA", "n/a")], "isdn string, topup_amount string, topup_channel string").write.option(
        "header", True).csv(folder)
    assert values(files.read_source(spark, root, "N5", files=[folder])) == [("p", None, None, "202507")]


def test_unreadable_file_is_reported_and_skipped(spark, root):
    chosen = [f"{root}/N5/N5_202503.csv", f"{root}/N5/N5_209901.csv"]
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert files.read_source(spark, root, "N5", files=chosen, on_error="skip").count() == 2
    assert any("N5_209901" in str(w.message) for w in seen)
    with pytest.raises(Exception, match="N5_209901"):
        files.read_source(spark, root, "N5", files=chosen)


def test_empty_source(spark, root):
    df = files.read_source(spark, root, "N4")
    assert df.count() == 0 and "amount" in df.columns and "data_month" in df.columns
    extracts = files.read_extracts(spark, root)
    assert set(extracts) == {"N5", "N10"}
    m = master.master_of(extracts)
    assert "topup_count" in m.columns and "advance_count" not in m.columns
    assert m.first().total_topup_amount == 10.0


def test_inventory(spark, root):
    rows = values(files.list_source_files(spark, root), "source", "name", "month", "file_count")
    assert ("N5", "N5_202503.csv", "202503", 4) in rows and ("N10", "N10_202503.csv", "202503", 1) in rows and len(rows) == 5


def test_source_counts(spark, root):
    got = {r.source: (r.file_count, r.has_files) for r in files.source_counts(spark, root).collect()}
    assert got["N5"] == (4, True) and got["N10"] == (1, True) and got["N7"] == (0, False) and len(got) == 9


def test_part_files_with_differing_headers_are_refused(spark, tmp_path):
    folder = tmp_path / "N5" / "N5_202503"
    folder.mkdir(parents=True)
    (folder / "part-0.csv").write_text("isdn,topup_amount\na,1\n")
    (folder / "part-1.csv").write_text("topup_amount,isdn\n2,b\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_source(spark, str(tmp_path), "N5").select("isdn", "topup_amount").collect()


def test_extract_round_trip(spark, tmp_path, sf_dir):
    from subpanel.sources import panel
    n5 = panel.n5(spark, sf_dir)
    files.write_extract(n5, str(tmp_path), "N5")
    back = files.read_source(spark, str(tmp_path), "N5")
    assert back.groupBy("data_month").count().orderBy("data_month").collect() == n5.groupBy("data_month").count().orderBy("data_month").collect()


def test_table_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "Fee", 1), ("b", "Free", 2)], "isdn string, service_type string, n int")
    tables.write_table(df, str(tmp_path / "t"))
    assert tables.read_table(spark, str(tmp_path / "t"), ["isdn"]).columns == ["isdn"]
    tables.write_csv(df, str(tmp_path / "c"))
    assert values(tables.read_table(spark, str(tmp_path / "c"), fmt="csv", schema=df.schema)) == values(df)
    tables.write_by(df, "service_type", str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("service_type=*")) == ["service_type=Fee", "service_type=Free"]
    tables.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_work_dir_is_the_clusters(spark):
    from subpanel.session import work_dir
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert work_dir(spark).startswith(shared) if shared else "subpanel-" in work_dir(spark)
