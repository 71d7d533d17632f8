"""Small files of a port."""

import json

from fairlead.sources import geodata


def test_files(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
        return str(tmp_path / name)

    square = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}
    line = {"type": "Feature", "properties": {"name": "north"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1], [2, 1]]}}
    dot = {"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[0, 0]]}}
    assert len(geodata.load_polygons(spark, put("a.json", square), "", str(tmp_path / "missing.json"))) == 1
    channels = geodata.load_channels(spark, put("b.json", {"type": "FeatureCollection", "features": [line, dot]}))
    assert [(r["channel_id"], r["segment"]) for r in channels.orderBy("segment").collect()] == [("north", 0), ("north", 1)]
    assert geodata.load_channels(spark, put("c.json", "no json")).count() == 0
    junctions = geodata.load_junctions(spark, put("d.json", {"junctions": [{"id": "x", "lon": 1, "lat": 2}, {"id": "bad"}, 7]}))
    assert [(r["junction_id"], r["radius_m"]) for r in junctions.collect()] == [("x", 500.0)]
    counts = geodata.load_counts(spark, put("e.json", {"123": {"1": 4, "x": 2}, "no": {"1": 1}}))
    assert [tuple(r) for r in counts.collect()] == [(123, 1, 4)]


def test_folders_and_port_values():
    from fairlead import config

    plain, named = config.Domain(), config.Domain(enabled=True, raw_root=" /zips ", subset_root="/port/")
    assert config.raw_folder(plain, "/raw") == "/raw" and config.raw_folder(named, "/raw") == "/zips"
    assert [config.store_folder(d, "/out") for d in (plain, config.Domain(enabled=True), named)] == ["/out/all", "/out/subsets", "/port/raw_daily_filtered"]
    own = config.port_cleaning(config.Settings(), sog_max=30.0, gap_seconds=60.0, channel_knots=2.0)
    assert (own.cleaning.sog_max, own.voyages.gap_seconds, own.berth.channel_knots, own.cleaning.duplicate_seconds) == (30.0, 60.0, 2.0, 1.0)
