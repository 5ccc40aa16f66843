import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridclim.functions.grid import centre_of_tile_id
from gridclim.operators import tile_centres, tile_stations

from helpers import rows, stations


def test_tile_index_and_centre(spark):
    listed = stations(spark, [
        ("a", -0.1, -0.1), ("b", 0.0, 0.0), ("c", 9.99, 9.99), ("d", -90.0, -180.0),
        ("e", 89.9, 179.9), ("f", 90.0, 180.0), ("g", None, 5.0),
    ])
    assert rows(tile_stations(listed, 10), "Id", "Tile_Id", "Lat", "Long") == [
        ("a", "8-17", -5, -5), ("b", "9-18", 5, 5), ("c", "9-18", 5, 5),
        ("d", "0-0", -85, -175), ("e", "17-35", 85, 175), ("f", "18-36", 95, 185),
        ("g", None, None, 5),
    ]


def test_centres_are_unique(spark):
    listed = stations(spark, [("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", -1.0, 1.0)])
    centres = tile_centres(tile_stations(listed, 10))
    assert rows(centres, "Tile_Id", "Lat", "Long") == [("8-18", -5, 5), ("9-18", 5, 5)]


@pytest.mark.parametrize("tile_size", [7, 5])
def test_tile_size_is_checked(spark, tile_size):
    with pytest.raises(ValueError):
        tile_stations(stations(spark, []), tile_size)


@settings(max_examples=6, deadline=None)
@given(
    st.sampled_from([2, 6, 10, 18, 30, 90]),
    st.lists(
        st.tuples(st.floats(-90, 90).map(lambda v: round(v, 4)),
                  st.floats(-180, 180).map(lambda v: round(v, 4))),
        min_size=1, max_size=60,
    ),
)
def test_centre_lies_in_the_middle_of_the_tile(spark, tile_size, points):
    listed = stations(spark, [(str(i), lat, long) for i, (lat, long) in enumerate(points)])
    tiles = tile_stations(listed, tile_size)
    lat, long = centre_of_tile_id(F.col("Tile_Id"), tile_size)
    joined = tiles.withColumns({"lat2": lat, "long2": long}).join(
        listed.withColumnsRenamed({"Lat": "y", "Long": "x"}), "Id"
    )
    for r in joined.collect():
        assert (r["lat2"], r["long2"]) == (r["Lat"], r["Long"])
        assert -tile_size / 2 <= r["y"] - r["Lat"] < tile_size / 2
        assert -tile_size / 2 <= r["x"] - r["Long"] < tile_size / 2
