"""Daily zips, the ledger, and what bad files do."""

import io
import zipfile

from fairlead.config import Box, Domain
from fairlead.sources import reports

HEAD = "MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,VesselName,VesselType,TransceiverClass\n"


def pack(folder, day, body, name="a.csv"):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr(name, body)
    (folder / f"AIS_{day}.zip").write_bytes(held.getvalue())


def line(mmsi, day, kind=70, lon=-118.3, sog="5.0", cog="360.0", head="511"):
    return f"{mmsi},{day}T00:00:00,33.6,{lon},{sog},{cog},{head},N,{kind}, a \n"


DOMAIN = Domain(enabled=True, box=Box(-120, 33, -117, 35))


def held(spark, out):
    return sorted((r["mmsi"], str(r["day"]), r["file"]) for r in reports.stored(spark, out).collect())


def test_incremental_ingest(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    pack(raw, "2023_01_01", HEAD + line(111111111, "2023-01-01") + line("bad", "2023-01-01") + line(111111112, "2023-01-01", kind=90))
    pack(raw, "2023_01_02", HEAD + line(111111111, "2023-01-02", lon=0))
    (raw / "AIS_2023_01_03.zip").write_bytes(b"no zip")
    assert reports.ingest(spark, str(raw), out, DOMAIN) == 2
    assert reports.ingest(spark, str(raw), out, DOMAIN) == 0
    got = reports.stored(spark, out).collect()
    assert [(r["mmsi"], r["cog"], r["heading"], str(r["day"])) for r in got] == [(111111111, None, None, "2023-01-01")]
    told = reports.problems(spark, out).collect()
    assert {r["file"] for r in told} == {"AIS_2023_01_03.zip"} and len(told) == 2  # tried again by the second run
    pack(raw, "2023_01_01", HEAD + line(111111111, "2023-01-01") + line(111111113, "2023-01-01"))
    pack(raw, "2023_01_03", HEAD + line(111111114, "2023-01-03"))
    assert reports.ingest(spark, str(raw), out, DOMAIN) == 2
    assert held(spark, out) == [(111111111, "2023-01-01", "AIS_2023_01_01.zip"), (111111113, "2023-01-01", "AIS_2023_01_01.zip"), (111111114, "2023-01-03", "AIS_2023_01_03.zip")]


def test_files_of_one_day_add_up(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    pack(raw, "2023_01_01", HEAD + "".join(line(111111111 + k, "2023-01-01") for k in range(5)))
    assert reports.ingest(spark, str(raw), out, DOMAIN) == 1
    pack(raw, "extra", HEAD + line(222222222, "2023-01-01") + line(222222223, "2023-01-02"))
    pack(raw, "2023_01_01_b", HEAD + line(333333333, "2023-01-01"))
    assert reports.ingest(spark, str(raw), out, DOMAIN) == 2
    assert [x[:2] for x in held(spark, out)] == [*[(111111111 + k, "2023-01-01") for k in range(5)], (222222222, "2023-01-01"), (222222223, "2023-01-02"), (333333333, "2023-01-01")]
    days = {str(r["day"]): r for r in spark.read.parquet(f"{out}/catalog").collect()}
    first = days["2023-01-01"]
    assert (first["rows_after"], first["rows_before"], first["vessels"]) == (7, 8, 7) and first["files"] == ["AIS_2023_01_01.zip", "AIS_2023_01_01_b.zip", "AIS_extra.zip"]
    assert first["vessel_type_counts"] == {"70": 7} and first["status_counts"] == {"null": 7}
    pack(raw, "extra", HEAD + line(222222222, "2023-01-03"))  # a changed file leaves its old days
    assert reports.ingest(spark, str(raw), out, DOMAIN) == 1
    assert [x[1] for x in held(spark, out) if x[2] == "AIS_extra.zip"] == ["2023-01-03"] and len(held(spark, out)) == 7
    days = {str(r["day"]): r["rows_after"] for r in spark.read.parquet(f"{out}/catalog").collect()}
    assert days == {"2023-01-01": 6, "2023-01-02": 0, "2023-01-03": 1}
    assert spark.read.parquet(f"{out}/reports").where("problem IS NULL AND n_rows IS NULL").count() == 7  # the old version is gone


def test_a_file_that_fails_half_way_stores_nothing(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    pack(raw, "2023_01_01", HEAD + line(111111111, "2023-01-01"))
    assert reports.ingest(spark, str(raw), out, DOMAIN) == 1
    body = HEAD + "".join(line(111111111 + k, "2023-01-01") for k in range(300_000)) + "a,b,c,d,e,f,g,h,i,j,k,l,m,n\n"
    pack(raw, "2023_01_01", body)  # two chunks, then a line of too many fields
    pack(raw, "2023_01_02", HEAD + line(5, "2023-01-02"))
    assert reports.ingest(spark, str(raw), out, DOMAIN) == 1
    assert held(spark, out) == [(5, "2023-01-02", "AIS_2023_01_02.zip"), (111111111, "2023-01-01", "AIS_2023_01_01.zip")]
    assert [r["file"] for r in reports.problems(spark, out).collect()] == ["AIS_2023_01_01.zip"]


def test_listing_by_date(spark, tmp_path):
    for day in ("2023_01_01", "2023_02_01"):
        pack(tmp_path, day, HEAD)
    (tmp_path / "AIS_undated.zip").write_bytes(b"x")
    assert reports.list_days(spark, str(tmp_path)).count() == 3
    assert [str(r["day"]) for r in reports.list_days(spark, str(tmp_path), "2023-01-15", "2023-02-01").collect()] == ["2023-02-01"]


def test_problems_are_told(spark, tmp_path):
    pack(tmp_path, "2023_01_01", "A,B\n1,2\n")
    rows = reports.read_days(spark, reports.list_days(spark, str(tmp_path))).collect()
    assert len(rows) == 1 and "not a file of position reports" in rows[0]["problem"]


def test_csv_and_counts(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text(HEAD + line(111111111, "2023-01-02") + line(111111111, "2023-01-01") + line(111111112, "never"))
    assert [r["t"] for r in reports.read_csv(spark, str(f)).collect()] == [1672531200.0, 1672617600.0]
    g = tmp_path / "y.csv"
    g.write_text("MMSI,cluster_id\n1,2\n1,2\n1,x\n")
    assert [tuple(r) for r in reports.counts_from_csv(spark, str(g)).collect()] == [(1, 2, 2)]
