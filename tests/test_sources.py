import io
import zipfile

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_normalize import ERA1, ERA3
from tripweave.operators.normalize import normalize
from tripweave.sources import archive_source, archives, headers, manifest, months, tables
from tripweave.sources import csv as trip_csv

SECOND = [
    "Trip Duration", "Start Time", "Stop Time", "Start Station ID", "Start Station Name", "Start Station Latitude", "Start Station Longitude",
    "End Station ID", "End Station Name", "End Station Latitude", "End Station Longitude", "Bike ID", "User Type", "Birth Year", "Gender",
]
LINE1 = "60,2014-01-01 00:00:0{0},2014-01-01 00:01:00,72,A,40.7,-74.0,79.0,B,40.8,-74.1,1234{0},Subscriber,1980,1"
LINE3 = "R{0},classic_bike,2021-03-01 00:00:0{0},2021-03-01 00:01:00,A,JC001,B,4001.01,40.7,-74.0,40.8,-74.1,casual"


def csv_text(header, *lines):
    return "\n".join([",".join(header), *lines]) + "\n"


def write(path, text):
    path.write_text(text)
    return str(path)


def zipped(members: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def test_csv_nulls_and_header_check(spark, tmp_path):
    path = write(tmp_path / "a.csv", csv_text(ERA1, LINE1.format(1), "", LINE1.format(2).replace("1980", r"\N"), LINE1.format(3).replace("72,A", "NaN,")))
    got = trip_csv.read_trip_csv(spark, path).orderBy("starttime").collect()
    assert [(r["birth year"], r["start station id"], r["start station name"], r["file"]) for r in got] == [
        ("1980", "72", "A", "a.csv"),
        (None, "72", "A", "a.csv"),
        ("1980", None, None, "a.csv"),
    ]
    other = write(tmp_path / "b.csv", csv_text(SECOND, LINE1.format(1)))
    with pytest.raises(Exception, match="(?i)header"):
        trip_csv.read_trip_csv(spark, [path, other]).collect()


def test_three_eras(spark, tmp_path):
    paths = [
        write(tmp_path / "1.csv", csv_text(ERA1, LINE1.format(1))),
        write(tmp_path / "2.csv", csv_text(SECOND, LINE1.format(2))),
        write(tmp_path / "3.csv", csv_text(ERA3, LINE3.format(3))),
    ]
    out = trip_csv.read_trip_eras(spark, paths).orderBy("start_time").collect()
    assert [(r.ride_id, r.rideable_type, r.user_type, r.gender, r.birth_year, r.bike_id, r.end_station_id) for r in out] == [
        (None, "unknown", "Subscriber", 1, 1980, 12341, "79"),
        (None, "unknown", "Subscriber", 1, 1980, 12342, "79"),
        ("R3", "classic_bike", "Customer", 0, None, None, "4001.01"),
    ]


def test_sorted_read(spark, tmp_path):
    path = write(tmp_path / "a.csv", csv_text(ERA3, LINE3.format(3), LINE3.format(1), "", LINE3.format(2)))
    assert [r.ride_id for r in trip_csv.read_sorted_csv(spark, path).collect()] == ["R1", "R2", "R3"]


@pytest.fixture
def archive_dir(tmp_path):
    """All archive layouts: whole years of both kinds, nested months, monthly files and nested CSV archives."""
    folder = tmp_path / "archives"
    folder.mkdir()
    stem = "2014-trips"
    (folder / "2014-trips.zip").write_bytes(
        zipped(
            {
                f"{stem}/1_January/201401-trips_1.csv": csv_text(ERA1, LINE1.format(1)),
                f"{stem}/1_January/201401-trips_2.csv": csv_text(ERA1, LINE1.format(2)),
                f"{stem}/201401-trips.csv": csv_text(ERA1, LINE1.format(1), LINE1.format(2)),
                f"{stem}/201402-trips.csv": csv_text(SECOND, LINE1.format(4)),
                f"__MACOSX/{stem}/201401-trips.csv": "junk",
                f"{stem}/notes.csv": "junk\n",
            }
        )
    )
    month = zipped({"202103-trips_1.csv": csv_text(ERA3, LINE3.format(1)), "_x.csv": "junk"})
    (folder / "2021-trips.zip").write_bytes(zipped({"2021-trips/202103-trips.zip": month}))
    (folder / "JC-202404-trips.csv.zip").write_bytes(zipped({"JC-202404-trips.csv": csv_text([*ERA3, "speed"], LINE3.format(5) + ",1")}))
    parts = {f"202409-trips_{i}.csv.zip": zipped({f"202409-trips_{i}.csv": csv_text(ERA3, LINE3.format(i))}) for i in (6, 7)}
    (folder / "202409-trips.zip").write_bytes(zipped({**parts, "__MACOSX/._202409-trips_6.csv.zip": b"junk"}))
    return str(folder)


def listed(spark, folder, **options):
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
    return archives.list_members(found, **options)


def test_archive_listing(spark, archive_dir):
    got = listed(spark, archive_dir).collect()
    assert sorted((r.src_ym, r.publisher, r.layout, r.member) for r in got) == [
        (201401, "NYC", 1, "2014-trips/1_January/201401-trips_1.csv"),
        (201401, "NYC", 1, "2014-trips/1_January/201401-trips_2.csv"),
        (201401, "NYC", 2, "2014-trips/201401-trips.csv"),
        (201402, "NYC", 2, "2014-trips/201402-trips.csv"),
        (202103, "NYC", 0, "2021-trips/202103-trips.zip!202103-trips_1.csv"),
        (202404, "JC", 0, "JC-202404-trips.csv"),
        (202409, "NYC", 0, "202409-trips_6.csv.zip!202409-trips_6.csv"),
        (202409, "NYC", 0, "202409-trips_7.csv.zip!202409-trips_7.csv"),
    ]
    assert {r.src_ym: r.unexpected for r in got}[202404] == ["speed"]


def test_archive_name_types(spark, archive_dir):
    members = listed(spark, archive_dir).where("src_ym < 202000")

    def chosen(name_type):
        return sorted((r.src_ym, r.layout) for r in archives.choose_layout(members, name_type).collect())

    assert chosen(1) == [(201401, 1), (201401, 1), (201402, 2)]
    assert chosen(2) == [(201401, 2), (201402, 2)]
    assert chosen(22) == chosen(2)
    with pytest.raises(Exception, match="no type 1 member for month 201402"):
        chosen(11)
    with pytest.raises(ValueError):
        chosen(3)


@pytest.mark.parametrize("chunk_bytes", [7, 150, 1 << 20])
def test_archive_rows(spark, archive_dir, chunk_bytes):
    raw = archives.read_trip_archives(spark, f"file://{archive_dir}", chunk_bytes=chunk_bytes)
    out = normalize(raw, publisher=F.col("publisher"), keep=["src_ym", "publisher"]).orderBy("src_ym", "start_time").collect()
    assert [(r.src_ym, r.ride_id, r.bike_id, r.rideable_type, r.gender, r.end_region) for r in out] == [
        (201401, None, 12341, "unknown", 1, "NYC"),
        (201401, None, 12342, "unknown", 1, "NYC"),
        (201402, None, 12344, "unknown", 1, "NYC"),
        (202103, "R1", None, "classic_bike", 0, "NYC"),
        (202404, "R5", None, "classic_bike", 0, "JC"),
        (202409, "R6", None, "classic_bike", 0, "NYC"),
        (202409, "R7", None, "classic_bike", 0, "NYC"),
    ]
    some = archives.read_trip_archives(spark, archive_dir, months=(202101, 202405))
    assert some.count() == 2


def test_a_wanted_month_that_no_archive_has(spark, archive_dir):
    assert archives.read_trip_archives(spark, archive_dir, months=(201401, 201403), require=True).count() == 3
    with pytest.raises(FileNotFoundError, match="201403, 201404"):
        archives.read_trip_archives(spark, archive_dir, months=(201401, 201405), require=True)


def test_archive_header_mismatch(spark, tmp_path):
    (tmp_path / "202405-trips.zip").write_bytes(zipped({"202405-a.csv": csv_text(ERA3, LINE3.format(1)), "202405-b.csv": csv_text(ERA1, LINE1.format(1))}))
    assert [(r.src_ym, r.n_headers) for r in archives.header_mismatches(listed(spark, str(tmp_path))).collect()] == [(202405, 2)]
    with pytest.raises(Exception, match="headers differ within month 202405"):
        archives.read_trip_archives(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
@pytest.mark.parametrize("size", range(1, 40, 3))
def test_chunks_hold_each_line_once(size, ending):
    lines = ["h" * 9, *[str(i) * (i % 7 + 1) for i in range(25)]]
    data = ending.join(lines).encode()
    for text in (data, data + ending.encode()):
        chunks = list(archives.line_chunks(io.BytesIO(text), size))
        assert b"".join(chunks).decode().split() == lines[1:]
        assert all(c.endswith(b"\n") for c in chunks[:-1])
        assert all(len(c) >= size for c in chunks[:-1])


def source_rows(df):
    out = normalize(df, publisher=F.col("publisher"), keep=["src_ym", "publisher"])
    return rows(out)


def test_source_reads_what_the_archive_reader_reads(spark, archive_dir):
    for name_type in (1, 2):
        for chunk_bytes in (7, 1 << 20):
            found = archive_source.scan_archives(spark, archive_dir, name_type, chunk_bytes)
            assert source_rows(found) == source_rows(archives.read_trip_archives(spark, archive_dir, name_type))
    with pytest.raises(Exception, match="no type 1 member for month 201402"):
        archive_source.scan_archives(spark, archive_dir, 11).collect()


@pytest.mark.parametrize(
    ("condition", "members"),
    [("src_ym = 202404", 1), ("src_ym >= 202101 AND src_ym < 202405", 2), ("src_ym IN (201401, 202409)", 4), ("publisher = 'JC'", 1), ("publisher = 'NYC' AND src_ym > 202000 AND ride_id <> 'R6'", 3), ("src_ym = 190001", 0), ("publisher IS NULL", 0), ("src_ym <> 201401", 7)],
)
def test_source_makes_partitions_of_wanted_members_only(spark, archive_dir, condition, members):
    found = archive_source.scan_archives(spark, f"file://{archive_dir}").where(condition)
    assert source_rows(found) == source_rows(archives.read_trip_archives(spark, archive_dir).where(condition))
    assert found.rdd.getNumPartitions() == max(1, members)


def test_source_opens_wanted_members_only(archive_dir, monkeypatch):
    """Headers of other months are not read, archives of other publishers not even opened."""
    opened, members = [], []
    open_file, open_member = archives.open_file, zipfile.ZipFile.open
    monkeypatch.setattr(archives, "open_file", lambda p: opened.append(p.rsplit("/", 1)[-1]) or open_file(p))
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, **k: members.append(name) or open_member(self, name, *a, **k))
    reader = archive_source.TripArchiveReader({"path": str(archive_dir)})
    filters = [ds.EqualTo(("publisher",), "NYC"), ds.LessThan(("src_ym",), 201402), ds.EqualTo(("ride_id",), "R1"), ds.EqualTo(("src_ym",), None)]
    assert list(reader.pushFilters(filters)) == filters[2:]
    assert [(m.src_ym, m.layout) for m in reader.partitions()] == [(201401, 1)] * 2
    assert not any(n.startswith("JC-") for n in opened)
    assert [n for n in members if n.endswith(".csv")] and all("201401" in n or n.endswith(".zip") for n in members)
    before = len(members)
    for m in reader.partitions():
        assert sum(b.num_rows for b in reader.read(m)) == 1
    assert len(members) > before


def test_source_refuses_differing_headers(spark, tmp_path):
    (tmp_path / "202405-trips.zip").write_bytes(zipped({"202405-a.csv": csv_text(ERA3, LINE3.format(1)), "202405-b.csv": csv_text(ERA1, LINE1.format(1))}))
    with pytest.raises(Exception, match="headers differ within month 202405"):
        archive_source.scan_archives(spark, str(tmp_path)).collect()


def test_a_large_nested_archive_is_read_in_place(tmp_path, monkeypatch):
    lines = "\n".join(LINE3.format(i) for i in range(500))
    (tmp_path / "202409-trips.zip").write_bytes(zipped({"a.csv.zip": zipped({"202409-trips_1.csv": csv_text(ERA3, lines)})}))
    monkeypatch.setattr(archives, "NESTED_BYTES", 10)
    monkeypatch.setattr(archives.shutil, "copyfileobj", None)
    reader = archive_source.TripArchiveReader({"path": str(tmp_path)})
    (member,) = reader.partitions()
    assert sum(b.num_rows for b in reader.read(member)) == 500


def test_files_of_any_store(tmp_path):
    (tmp_path / "b.zip").write_bytes(b"12345")
    for address in (f"{tmp_path}/b.zip", f"file:{tmp_path}/b.zip", f"file://{tmp_path}/b.zip"):
        with archives.open_file(address) as f:
            f.seek(3)
            assert f.read() == b"45"


def test_a_nested_member_is_unpacked_once(tmp_path, monkeypatch):
    inner = zipped({f"202409-trips_{i}.csv": csv_text(ERA3, LINE3.format(i)) for i in range(3)})
    (tmp_path / "202409-trips.zip").write_bytes(zipped({"a.csv.zip": inner}))
    copies = []
    copy = archives.shutil.copyfileobj
    monkeypatch.setattr(archives.shutil, "copyfileobj", lambda *a: copies.append(1) or copy(*a))
    opened = archives._Opened()
    found = [m[0] for m in archives._members(str(tmp_path / "202409-trips.zip"), opened)]
    for member in found:
        with opened.member(str(tmp_path / "202409-trips.zip"), member) as stream:
            assert stream.readline()
    opened.close()
    assert len(found) == 3 and len(copies) == 1


def test_manifest(spark, tmp_path):
    a = tmp_path / "a.zip"
    a.write_text("1")
    (tmp_path / "b.zip").write_text("22")
    old = spark.createDataFrame(manifest.file_manifest(spark, str(tmp_path)).collect())
    a.write_text("333")
    (tmp_path / "c.zip").write_text("4")
    new = manifest.file_manifest(spark, str(tmp_path))
    status = {r.path[-5:]: r.status for r in manifest.manifest_diff(old, new).collect()}
    assert status == {"a.zip": "changed", "b.zip": "unchanged", "c.zip": "new"}
    assert sorted(r.path[-5:] for r in manifest.to_import(old, new).collect()) == ["a.zip", "c.zip"]
    assert manifest.file_manifest(spark, str(tmp_path), exclude=["b"]).count() == 2
    assert {r.status for r in manifest.manifest_diff(new, new.where("path like '%a.zip'")).collect()} == {"unchanged", "removed"}


def test_month_ranges(spark):
    df = spark.createDataFrame([(ym,) for ym in (201306, 201512, 202106, 202107, 202108, 202301)], "ym int")
    kept = df.where(months.in_month_ranges(F.col("ym"), [(202106, 202108), (None, 201401)]))
    assert rows(kept) == [(201306,), (202106,), (202107,)]


def test_calendar_fills_gaps(rides_of):
    rides = rides_of({"start_time": "2019-11-05 00:00:00"}, {}, {})
    assert rows(months.month_calendar(rides)) == [(0, 201912), (1, 201911), (2, 202001)]


def test_publishers(spark):
    known = spark.createDataFrame([(201508,), (201509,)], "ym int")
    assert rows(months.publisher_months(known)) == [(201508, "NYC"), (201509, "JC"), (201509, "NYC")]
    files = [(201508, "NYC"), (201509, "NYC"), (201509, "JC"), (201510, "NYC")]
    one = spark.createDataFrame(files, "ym int, publisher string")
    assert rows(months.latest_complete_month(one, strict=True)) == [(201509, 201510, 1)]
    two = one.unionByName(spark.createDataFrame([(201511, "JC")], "ym int, publisher string"))
    assert rows(months.latest_complete_month(two)) == [(201509, 201511, 2)]
    with pytest.raises(Exception, match="more than one month"):
        months.latest_complete_month(two, strict=True).collect()


def test_column_diff(spark):
    old, new = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(1, 2)], "b int, c int")
    assert headers.column_diff(old, new) == {"added": ["c"], "removed": ["a"], "both": ["b"]}
    stacked = tables.union_all([old, new])
    assert rows(stacked) == [(1, 2, None), (None, 1, 2)]
    assert headers.column_presence(old, 202001)["extra"] == ["a", "b"]


def test_published_json(spark, tmp_path):
    write(tmp_path / "s.json", '{"JC001":{"name":"A","lat":1.5,"lng":2.0,"ends":3},"72":{"name":null,"lat":null,"lng":null,"ends":0}}')
    assert rows(tables.read_station_json(spark, str(tmp_path / "s.json"))) == [("72", None, None, None, 0), ("JC001", "A", 1.5, 2.0, 3)]
    write(tmp_path / "p.json", '{"0":{"1":5,"2":6},"3":{"0":1}}')
    assert rows(tables.read_pair_json(spark, str(tmp_path / "p.json"))) == [(0, 1, 5), (0, 2, 6), (3, 0, 1)]
