from pyspark.sql import functions as F

from gridclim.operators import accepted_observations
from gridclim.sources import (
    co2_series, parse_station_lines, read_co2, read_feature_collections, read_observations,
    read_stations, explode_features, year_mismatch_audit,
)

from helpers import rows

EDGE = "A # IN THE NAME UP TO ITS END!!"


def line(*fields):
    return "{:11}{:>9}{:>10}{:>7}{:>3}{:31}{:>4}{:>4}{:>6}".format(*fields)


LINES = [
    line("ACW00011604", "17.1167", "-61.7833", "10.1", "", " ST JOHNS COOLIDGE FLD", "", "", ""),
    line("AE000041196", "25.3330", "55.5170", "34.0", "", " SHARJAH INTER. AIRP", "GSN", "",
         "41196"),
    "",
    line("USC00000001", "-xx.x", "-65.0000", "-999.9", "AK", EDGE, "", "HCN", "70200"),
]


def test_stations_fixed_width(spark):
    lines = spark.createDataFrame([(line,) for line in LINES], "value STRING")
    found = {r["Id"]: r for r in parse_station_lines(lines).collect()}
    assert set(found) == {"ACW00011604", "AE000041196", "USC00000001"}
    sharjah = found["AE000041196"]
    assert (sharjah["Lat"], sharjah["Long"], sharjah["Elevation"]) == (25.333, 55.517, 34.0)
    assert (sharjah["Name"], sharjah["GSN"]) == ("SHARJAH INTER. AIRP", "GSN")
    assert (sharjah["WMO_Id"], sharjah["HCN_CRN"], sharjah["State"]) == ("41196", None, None)
    odd = found["USC00000001"]
    assert odd["Lat"] is None and odd["Long"] == -65.0
    assert odd["State"] == "AK" and odd["Name"] == EDGE


def test_station_file(spark, tmp_path):
    (tmp_path / "stations.txt").write_text("\n".join(LINES))
    read = read_stations(spark, str(tmp_path / "stations.txt"))
    assert read.columns == ["Id", "Lat", "Long"]
    assert read.count() == 3


def test_observation_files(spark, tmp_path):
    (tmp_path / "1917.csv").write_text(
        "A,19170101,PRCP,12,,,S,\n"
        'A,19170102,PRCP,x,,"",S,0700\n'
        "A,19170103,PRCP,5,,G,S,\n"
        "A,19170104,SNOW,5,,,S,\n"
        "A,19170105,WT01,1,,,S,\n"
        "A,19170106,WT02,1,,,S,\n"
        "A,19170107\n"
    )
    (tmp_path / "1918.csv").write_text("B,19180101,TMAX,-30,,,S,\nB,19191231,TMAX,4,,,S,\n")
    read = read_observations(spark, str(tmp_path))
    assert read.count() == 9
    assert rows(accepted_observations(read), "Station", "Date", "Element", "Value", "Year") == [
        ("A", "19170101", "PRCP", 12, 1917),
        ("A", "19170102", "PRCP", None, 1917),
        ("A", "19170106", "WT02", 1, 1917),
        ("B", "19180101", "TMAX", -30, 1918),
        ("B", "19191231", "TMAX", 4, 1919),
    ]
    audit = year_mismatch_audit(spark, str(tmp_path))
    assert rows(audit, "file_year", "Year", "n") == [(1918, 1919, 1)]


def test_only_used_columns_are_read(spark, tmp_path):
    (tmp_path / "1917.csv").write_text("A,19170101,PRCP,12,,,S,\n")
    read = accepted_observations(read_observations(spark, str(tmp_path)))
    text = read._jdf.queryExecution().executedPlan().toString()
    assert "SFlag" not in text and "Time" not in text and "MFlag" not in text
    assert "IsNull(QFlag)" in text and "In(Element" in text


def test_co2_file(spark, tmp_path):
    header = (
        'Year,"Total carbon emissions from fossil fuel consumption and cement production'
        ' (million metric tons of C)",Per capita\n'
    )
    (tmp_path / "global.csv").write_text(
        header + "Global CO2 emissions,,\n1751,3,.\n2014,9855,1.36\n2015,n/a,\n"
    )
    series = co2_series(read_co2(spark, str(tmp_path / "global.csv")))
    found = {r["Year"]: r["Total_in_mega_tons"] for r in series.collect()}
    assert set(found) == {1751, 2014, 2015}
    assert round(found[1751], 6) == 11.001 and round(found[2014], 6) == 36138.285
    assert found[2015] is None
    assert dict(series.dtypes) == {"Year": "int", "Total_in_mega_tons": "double"}


def test_co2_header_with_underscores(spark):
    name = "Total_carbon_emissions_from_fossil_fuel_consumption"
    raw = spark.createDataFrame([("1751", "3"), ("Year (*)", None)], f"Year STRING, {name} STRING")
    assert co2_series(raw).count() == 1


def test_feature_collection_files(spark, tmp_path):
    text = (
        '{"type":"FeatureCollection","features":['
        '{"type":"Feature","id":1,"properties":{"Lat":15,"Long":5,"Year":1917},"geometry":'
        '{"type":"Polygon","coordinates":[[[0,10],[0,20],[10,20],[10,10],[0,10]]]}}]}'
    )
    (tmp_path / "1917.geojson").write_text(text)
    features = explode_features(read_feature_collections(spark, str(tmp_path)))
    row = features.select("id", "Lat", "Long", "Year", F.to_json("geometry").alias("g")).first()
    assert tuple(row)[:4] == (1, 15, 5, 1917)
    assert row["g"] in text
