"""The same questions in SQL over the given tables, written out step by step."""

from __future__ import annotations

from .inputs import STRICT_CONFIG

ELEMENTS = (
    "'PRCP', 'TMAX', 'WT02', 'WT03', 'WT04', 'WT05', 'WT07',"
    " 'WT10', 'WT11', 'WT16', 'WT17', 'WT18'"
)
CELLS = [(e, s) for s in ("year", "summer", "winter") for e in ("PRCP", "TMAX", "WTXX")]
MEASURES = [f"{e}_{s}" for e, s in CELLS]
IN_SEGMENT = {
    "year": "TRUE",
    "summer": "MonthDay >= '0504' AND MonthDay < '1103'",
    "winter": "(MonthDay < '0504' OR MonthDay >= '1103')",
}


def r(expression: str, digits: int = 6) -> str:
    """Half up after noise in the last digits is gone; never a negative zero."""
    scale = f"1e{digits}"
    return f"floor(round({expression}, {digits + 3}) * {scale} + 0.5e0) / {scale}"


def rounded(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


def steps(days_divisor: int) -> list[tuple[str, str]]:
    """The computation as named subqueries, each using only those before it."""
    cells = ", ".join(
        f"avg(CASE WHEN Element = '{e}' AND {IN_SEGMENT[s]} THEN Value END) AS {e}_{s}"
        for e, s in CELLS
    )
    return [
        ("stations", """
            SELECT concat('P', p_partkey) AS Id,
                   ((p_partkey * 37) % 400) / 10.0e0 - 20 AS Lat,
                   ((p_partkey * 91) % 600) / 10.0e0 - 30 AS Long
            FROM part"""),
        ("tiled_stations", """
            SELECT Id,
                   concat(CAST(floor((Lat + 90) / 10) AS INTEGER), '-',
                          CAST(floor((Long + 180) / 10) AS INTEGER)) AS Tile_Id,
                   CAST(floor((Lat + 90) / 10) * 10 - 85 AS INTEGER) AS Lat,
                   CAST(floor((Long + 180) / 10) * 10 - 175 AS INTEGER) AS Long
            FROM stations"""),
        ("centres", "SELECT DISTINCT Tile_Id, Lat, Long FROM tiled_stations"),
        ("observations", """
            SELECT concat('P', l_partkey) AS Station,
                   strftime(l_shipdate, '%Y%m%d') AS Date,
                   CASE l_linenumber WHEN 1 THEN 'PRCP' WHEN 2 THEN 'TMAX' WHEN 3 THEN 'WT03'
                        WHEN 4 THEN 'WT05' ELSE 'SNOW' END AS Element,
                   CAST(l_quantity AS INTEGER) AS Value,
                   CASE WHEN l_returnflag = 'R' THEN 'G' END AS QFlag
            FROM lineitem"""),
        ("accepted", f"""
            SELECT Station, Date, Element, Value, CAST(substr(Date, 1, 4) AS INTEGER) AS Year
            FROM observations WHERE QFlag IS NULL AND Element IN ({ELEMENTS})"""),
        ("tiled", """
            SELECT a.Station, a.Date, a.Element, a.Value, a.Year, s.Tile_Id, s.Lat, s.Long
            FROM accepted a JOIN tiled_stations s ON a.Station = s.Id"""),
        ("active_days", """
            SELECT Tile_Id, Year, count(DISTINCT Date) AS n FROM tiled GROUP BY Tile_Id, Year"""),
        ("tile_years", f"""
            SELECT Tile_Id, Year FROM active_days WHERE n / {days_divisor}.0e0 >= 0.8e0"""),
        ("initial", """
            SELECT Tile_Id FROM tile_years
            WHERE Year BETWEEN 1995 AND 1997
              AND Tile_Id IN (SELECT Tile_Id FROM tile_years WHERE Year = 1995)
            GROUP BY Tile_Id HAVING count(*) / 3.0e0 >= 0.8e0"""),
        ("counts", """
            SELECT Year, Tile_Id, count(DISTINCT Station) AS Station_count
            FROM tiled GROUP BY Year, Tile_Id"""),
        ("storm", """
            SELECT t.Year, t.Date, 'WTXX' AS Element, t.Tile_Id,
                   count(*) / CAST(c.Station_count AS DOUBLE) AS Value
            FROM tiled t JOIN counts c ON t.Year = c.Year AND t.Tile_Id = c.Tile_Id
            WHERE t.Element NOT IN ('PRCP', 'TMAX')
            GROUP BY t.Year, t.Date, t.Tile_Id, c.Station_count"""),
        ("mean", """
            SELECT Year, Date, Element, Tile_Id, avg(Value) AS Value
            FROM tiled WHERE Element IN ('PRCP', 'TMAX')
            GROUP BY Year, Date, Element, Tile_Id"""),
        ("daily", "SELECT * FROM mean UNION ALL SELECT * FROM storm"),
        ("baseline", """
            SELECT substr(Date, 5, 4) AS MonthDay, Element, Tile_Id, avg(Value) AS Value_baseline
            FROM daily
            WHERE Year BETWEEN 1995 AND 1997 AND Tile_Id IN (SELECT Tile_Id FROM initial)
            GROUP BY MonthDay, Element, Tile_Id"""),
        ("anomaly", """
            SELECT d.Year, b.MonthDay, d.Element, d.Tile_Id, d.Value - b.Value_baseline AS Value
            FROM daily d JOIN baseline b
              ON substr(d.Date, 5, 4) = b.MonthDay AND d.Element = b.Element
             AND d.Tile_Id = b.Tile_Id
            WHERE d.Year BETWEEN 1995 AND 2001"""),
        ("segments", " UNION ALL ".join(f"""
            SELECT Year, Tile_Id, '{s}' AS segment, Element, avg(Value) AS Value
            FROM anomaly WHERE {IN_SEGMENT[s]} GROUP BY Year, Tile_Id, Element"""
            for s in IN_SEGMENT)),
        ("tile_values", f"SELECT Year, Tile_Id, {cells} FROM anomaly GROUP BY Year, Tile_Id"),
        ("wide", """
            SELECT w.*, c.Lat, c.Long FROM tile_values w LEFT JOIN centres c USING (Tile_Id)"""),
        ("co2", """
            SELECT CAST(year(l_shipdate) AS INTEGER) AS Year,
                   sum(CAST(l_quantity AS INTEGER)) * 3.667e0 AS Total_in_mega_tons
            FROM lineitem GROUP BY 1"""),
        ("global_means", "SELECT Year, " + ", ".join(
            f"avg({m}){'' if m.startswith('WTXX') else ' / 10.0e0'} AS {m}" for m in MEASURES
        ) + " FROM wide GROUP BY Year"),
        ("global", """
            SELECT g.*, c.Total_in_mega_tons
            FROM global_means g LEFT JOIN co2 c ON g.Year = c.Year"""),
        ("series", " UNION ALL ".join(
            f"SELECT Year, '{m}' AS series, {m} AS value FROM global"
            for m in MEASURES + ["Total_in_mega_tons"])),
        ("tile_series", " UNION ALL ".join(
            f"SELECT Tile_Id, Year, '{m}' AS series, {m} AS value FROM wide" for m in MEASURES)),
        ("numbered", """
            SELECT CAST(row_number() OVER (ORDER BY Year, Lat, Long) AS INTEGER) AS id,
                   Lat, Long, Year,
                   concat('[[[', Long - 5, ',', Lat - 5, '],[', Long - 5, ',', Lat + 5, '],[',
                          Long + 5, ',', Lat + 5, '],[', Long + 5, ',', Lat - 5, '],[',
                          Long - 5, ',', Lat - 5, ']]]') AS ring
            FROM wide"""),
    ]


def sql(select: str, days_divisor: int = 3) -> str:
    named = ",\n".join(f"{name} AS ({body})" for name, body in steps(days_divisor))
    return f"WITH {named}\n{select}"


def trend(source: str, keys: list[str], se: bool = False) -> str:
    """Local quadratic fit by joining each point with its series; with ``se`` its standard error,
    from each fit's weights on all points of the series."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    names = ", ".join(keys)
    prefixed = ", ".join(f"a.{k}" for k in keys)
    powers = ", ".join(
        [f"sum(w * u ** {i}) AS s{i}" for i in range(5)]
        + [f"sum(w * v * u ** {i}) AS t{i}" for i in range(3)]
    )
    minor = "(s2 * s4 - s3 * s3)"
    if se:
        determinant = f"(s0 * {minor} - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))"
        ending = f"""
        , solved AS (
          SELECT *, {minor} / {determinant} AS a, (s2 * s3 - s1 * s4) / {determinant} AS b,
                 (s1 * s3 - s2 * s2) / {determinant} AS c
          FROM moments WHERE k >= 3),
        rows_of_l AS (
          SELECT {", ".join(f"w.{k}" for k in keys)}, w.Year, w.u,
                 w.w * (s.a + s.b * w.u + s.c * w.u * w.u) AS l, w.v
          FROM weighted w
          JOIN solved s ON {" AND ".join(f"w.{k} = s.{k}" for k in keys)} AND w.Year = s.Year),
        fits AS (
          SELECT {names}, Year, sum(l * v) AS fit, sum(l * l) AS norm,
                 sum(CASE WHEN u = 0 THEN l END) AS own
          FROM rows_of_l GROUP BY {names}, Year),
        variance AS (
          SELECT {prefixed}, sum((a.value - f.fit) ** 2) / sum(1 - 2 * f.own + f.norm) AS s2
          FROM points a LEFT JOIN fits f ON {same.replace("b.", "f.")} AND a.Year = f.Year
          GROUP BY {prefixed}
          HAVING count(*) = count(f.fit) AND sum(1 - 2 * f.own + f.norm) > 1e-9)
        SELECT {prefixed}, a.Year, {r('a.value', 4)} AS value, {r('f.fit', 4)} AS trend,
               {r('sqrt(b.s2 * f.norm)', 4)} AS trend_se
        FROM points a
        LEFT JOIN fits f ON {same.replace("b.", "f.")} AND a.Year = f.Year
        LEFT JOIN variance b ON {same}"""
        shown = trend(source, keys)
        return shown[: shown.rindex("SELECT " + names + ", Year, floor")].rstrip() + ending
    return sql(f""", points AS (
          SELECT {names}, Year, value,
                 CAST(floor(count(*) OVER (PARTITION BY {names}) * 0.75e0) AS INTEGER) AS near
          FROM {source} WHERE value IS NOT NULL),
        pairs AS (
          SELECT {prefixed}, a.Year, a.value, a.near, b.Year - a.Year AS d, b.value AS v,
                 row_number() OVER (PARTITION BY {prefixed}, a.Year
                                    ORDER BY abs(b.Year - a.Year)) AS place
          FROM points a JOIN points b ON {same}),
        reach AS (
          SELECT {names}, Year, max(CASE WHEN place = near THEN abs(d) END) AS h
          FROM pairs GROUP BY {names}, Year),
        weighted AS (
          SELECT {prefixed}, a.Year, a.value, a.v, a.d / CAST(nullif(b.h, 0) AS DOUBLE) AS u,
                 CASE WHEN abs(a.d) < b.h
                      THEN (1 - abs(a.d / CAST(b.h AS DOUBLE)) ** 3) ** 3 ELSE 0.0e0 END AS w
          FROM pairs a JOIN reach b ON {same} AND a.Year = b.Year),
        moments AS (
          SELECT {names}, Year, value, count(*) FILTER (WHERE w > 0) AS k, {powers}
          FROM weighted GROUP BY {names}, Year, value)
        SELECT {names}, Year, {r('value', 4)} AS value,
               {r(f'''CASE WHEN k >= 3 THEN
                   (t0 * {minor} - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2))
                 / (s0 * {minor} - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))
               END''', 4)} AS trend
        FROM moments""").replace("\n, points AS", ",\npoints AS", 1)


def layers(year: int, segment: str, ring: bool) -> str:
    """Rows of the three map layers, as subquery ``layer``."""
    point = "concat('{\"type\":\"Point\",\"coordinates\":[', Long, ',', Lat, ']}')"
    square = "concat('{\"type\":\"Polygon\",\"coordinates\":', ring, '}')" if ring else "NULL"
    parts = [
        ("temp", f"TMAX_{segment} / 10", " &#176;C", square),
        ("prec", f"PRCP_{segment} / 10", "  mm", point),
        ("storm", f"WTXX_{segment} * 100", " Unwetter", point),
    ]
    return " UNION ALL ".join(
        f"""SELECT w.Year, w.Lat, w.Long, '{name}' AS layer, {value} AS value,
                   '{suffix}' AS suffix, {geometry} AS geometry
            FROM (SELECT wide.*, numbered.ring FROM wide JOIN numbered USING (Year, Lat, Long)) w
            WHERE w.Year = {year}""".replace("Long, ',', Lat", "w.Long, ',', w.Lat")
        for name, value, suffix, geometry in parts
    )


def text_cases(pairs: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs.items())
    return f"CASE series {whens} END"


def titles() -> tuple[str, str]:
    # Texts of the plots.
    spans = {
        "year": "Jahr",
        "summer": "Sommerliches Halbjahr (4. Mai - 3. Nov.)",
        "winter": "Winterliches Halbjahr (3. Nov. - 4. Mai)",
    }
    units = {
        "TMAX": "Differenz der maximalen Tagestemperaturen (°C)",
        "PRCP": "Niederschlagsdifferenz (mm)",
        "WTXX": "Differenz der normierten Unwetteranzahl",
    }
    detail = {"WTXX": " (Anz. Unwetter / Anz. Stationen)"}
    title = {
        f"{e}_{s}": f"'Entwicklung der globalen {units[e]}{detail.get(e, '')} pro {spans[s]}'"
        " || chr(10) || 'im Vergleich zur Baseline (Durchschnittswerte der Jahre 1995-1997)'"
        for e, s in CELLS
    }
    unit = {f"{e}_{s}": f"'{units[e]}'" for e, s in CELLS}
    title["Total_in_mega_tons"] = "'Entwicklung des globalen, geschätzten CO2-Ausstoßes (Mt)'"
    unit["Total_in_mega_tons"] = "'CO2-Ausstoß (Mt)'"
    return text_cases(title), text_cases(unit)


def color_sql() -> str:
    # The palettes, from low to high values.
    red_blue = (
        "['#053061', '#2166ac', '#4393c3', '#92c5de', '#d1e5f0', '#f7f7f7', '#fddbc7',"
        " '#f4a582', '#d6604d', '#b2182b', '#67001f']"
    )
    purple_green = (
        "['#00441b', '#1b7837', '#5aae61', '#a6dba0', '#d9f0d3', '#f7f7f7', '#e7d4e8',"
        " '#c2a5cf', '#9970ab', '#762a83', '#40004b']"
    )
    return sql(f""", layer AS ({layers(2000, 'winter', ring=False)}),
        placed AS (
          SELECT *, CASE layer WHEN 'temp' THEN 12 ELSE 20 END AS half FROM layer),
        scaled AS (
          SELECT *, CASE WHEN value BETWEEN -half AND half
                         THEN (value + half) / (2.0e0 * half) END AS position FROM placed)
        SELECT Lat, Long, layer, {r('value', 5)} AS value, {r('position', 5)} AS scale_position,
               CASE layer WHEN 'storm'
                    THEN {purple_green}[CAST(floor(position * 10 + 0.5e0) AS INTEGER) + 1]
                    ELSE {red_blue}[CAST(floor(position * 10 + 0.5e0) AS INTEGER) + 1]
               END AS color_class
        FROM scaled""").replace("\n, layer AS", ",\nlayer AS", 1)


def map_sql() -> str:
    return sql(f""", layer AS ({layers(1999, 'year', ring=True)}),
        sized AS (SELECT *, abs(round(value, 9)) AS size FROM layer),
        powers AS (
          SELECT *, CASE WHEN size > 0 THEN floor(log10(size)) END AS power FROM sized),
        tenths AS (SELECT *, round(size / 10 ** power * 10) AS tens FROM powers),
        needed AS (
          SELECT *, greatest(0, coalesce(CASE WHEN tens % 10 = 0 THEN 0 ELSE 1 END
                 - CASE WHEN tens >= 100 THEN power + 1 ELSE power END, 0)) AS decimals
          FROM tenths),
        shared AS (
          SELECT *, CAST(max(decimals) OVER (PARTITION BY layer) AS INTEGER) AS places
          FROM needed),
        texts AS (
          SELECT *, CASE
            WHEN value IS NULL THEN NULL
            WHEN layer = 'storm' THEN
              regexp_replace(regexp_replace(printf('%.9f', round(value, 9)), '0+$', ''), '[.]$', '')
            ELSE regexp_replace(printf('%.' || places || 'f', round(round(value, 9), places)),
                                '^-(0([.]0*)?)$', '\\1') END AS text
          FROM shared),
        widths AS (SELECT *, max(length(text)) OVER (PARTITION BY layer) AS width FROM texts)
        SELECT Year, Lat, Long, layer, {r('value', 5)} AS value, geometry,
               CASE WHEN layer = 'storm' THEN text
                    ELSE lpad(text, CAST(width AS INTEGER), ' ') END || suffix AS label
        FROM widths""").replace("\n, layer AS", ",\nlayer AS", 1)


def oracle_sql(strict_days: int = STRICT_CONFIG.coverage_days) -> dict[str, str]:
    """SQL for each query. ``strict_days`` is the day count of the queries with strict coverage."""
    measures = rounded(MEASURES)
    wide = f"SELECT Year, Tile_Id, Lat, Long, {measures} FROM wide"
    daily = f"SELECT Year, Date, Element, Tile_Id, {r('Value')} AS Value FROM "
    strict = {"days_divisor": strict_days}
    title, unit = titles()
    tile_list = "SELECT Id, Tile_Id, Lat, Long FROM tiled_stations"
    co2 = f"SELECT Year, {r('Total_in_mega_tons', 3)} AS Total_in_mega_tons FROM co2"
    queries = {
        "tile_stations": sql(tile_list),
        "station_file": sql(tile_list),
        "station_fixed_width": """
            SELECT concat('P', p_partkey) AS Id,
                   round(((p_partkey * 37) % 400) / 10.0e0 - 20, 4) AS Lat,
                   round(((p_partkey * 91) % 600) / 10.0e0 - 30, 4) AS Long,
                   CAST(p_size AS DOUBLE) AS Elevation, CAST(NULL AS VARCHAR) AS State,
                   trim(p_name) AS Name, 'GSN' AS GSN, CAST(NULL AS VARCHAR) AS HCN_CRN,
                   CAST(p_partkey % 100000 AS VARCHAR) AS WMO_Id
            FROM part""",
        "tile_centres": sql("SELECT Tile_Id, Lat, Long FROM centres"),
        "tiled_observations": sql("SELECT * FROM tiled"),
        "observation_files": sql(daily + "daily"),
        "year_mismatch_audit": """
            SELECT CAST(year(l_shipdate - INTERVAL 30 DAY) AS INTEGER) AS file_year,
                   CAST(year(l_shipdate) AS INTEGER) AS Year, count(*) AS n
            FROM lineitem WHERE year(l_shipdate - INTERVAL 30 DAY) <> year(l_shipdate)
            GROUP BY 1, 2""",
        "unknown_station_audit": sql("""
            SELECT Station, count(*) AS n FROM accepted
            WHERE Station NOT IN (SELECT concat('P', p_partkey) FROM part WHERE p_size > 10)
            GROUP BY Station"""),
        "active_days_per_year": sql('SELECT Tile_Id, Year, n AS "Count" FROM active_days'),
        "active_tiles_per_year": sql("SELECT Tile_Id, Year FROM tile_years", **strict),
        "tiles_active_in": sql("""
            SELECT a.Tile_Id, a.Year FROM tile_years a JOIN tile_years b USING (Tile_Id)
            WHERE b.Year = 1995""", **strict),
        "active_tiles": sql("""
            SELECT Tile_Id FROM tile_years GROUP BY Tile_Id
            HAVING count(*) / 7.0e0 >= 0.5e0""", **strict),
        "initial_tiles": sql("SELECT Tile_Id FROM initial", **strict),
        "saved_tiles": sql("SELECT Tile_Id FROM initial", **strict),
        "restrict_to_tiles": sql("SELECT t.* FROM tiled t JOIN initial USING (Tile_Id)", **strict),
        "station_count": sql("""
            SELECT t.Year, t.Tile_Id, t.Date, t.Element, t.Value, t.Lat, t.Long, c.Station_count
            FROM tiled t JOIN counts c ON t.Year = c.Year AND t.Tile_Id = c.Tile_Id"""),
        "daily_tile_mean": sql(daily + "mean"),
        "daily_storm_rate": sql(daily + "storm"),
        "daily_tile_values": sql(daily + "daily"),
        "daily_values_reread": sql(f"""
            SELECT substr(Date, 5, 4) AS MonthDay, Element, Tile_Id,
                   {r('avg(Value)')} AS Value_baseline
            FROM daily WHERE Year BETWEEN 1995 AND 1997 GROUP BY MonthDay, Element, Tile_Id"""),
        "baseline_year": sql(f"""
            SELECT MonthDay, Element, Tile_Id, {r('Value_baseline')} AS Value_baseline
            FROM baseline""", **strict),
        "baseline_tiles": sql("SELECT DISTINCT Tile_Id FROM baseline", **strict),
        "daily_anomaly": sql(
            f"SELECT Year, MonthDay, Element, Tile_Id, {r('Value')} AS Value FROM anomaly"
        ),
        "segment_means": sql(
            f"SELECT Year, Tile_Id, segment, Element, {r('Value')} AS Value FROM segments"
        ),
        "wide_pivot": sql(
            f"SELECT Year, Tile_Id, {rounded([m for m in MEASURES if 'summer' in m])}"
            " FROM tile_values WHERE coalesce(PRCP_summer, TMAX_summer, WTXX_summer) IS NOT NULL"
        ),
        "co2_series": sql(co2),
        "co2_file": sql(co2),
        "global_series": sql(
            f"SELECT Year, {measures}, {r('Total_in_mega_tons', 3)} AS Total_in_mega_tons"
            " FROM global ORDER BY Year"
        ),
        "series_long": sql(
            f"SELECT Year, series, {r('value', 4)} AS value, {title} AS title, {unit} AS unit"
            " FROM series"
        ),
        "local_trend": trend("series", ["series"]),
        "tile_trend": trend("tile_series", ["Tile_Id", "series"]),
        "trend_error": trend("series", ["series"], se=True),
        "daily_trend": "SELECT series, Year AS Day, value, trend, trend_se FROM ("
        + trend("""(SELECT Element AS series,
                           date_diff('day', DATE '1990-01-01',
                                     CAST(strptime(Date, '%Y%m%d') AS DATE)) AS Year,
                           avg(Value) AS value
                    FROM daily GROUP BY 1, 2)""", ["series"], se=True) + ")",
        "rejected_lines": """
            SELECT CAST(year(l_shipdate) AS INTEGER) AS Year, count(*) AS n_rows,
                   sum(CASE WHEN l_linenumber IN (6, 7)
                              OR l_linenumber = 5 AND l_partkey % 3 < 2
                              OR l_linenumber = 4 AND l_partkey % 5 = 0
                            THEN 1 ELSE 0 END)::BIGINT AS n_rejects,
                   sum(CASE WHEN l_linenumber IN (6, 7) THEN 1 ELSE 0 END)::BIGINT AS line,
                   sum(CASE WHEN l_linenumber = 5 AND l_partkey % 3 = 1
                            THEN 1 ELSE 0 END)::BIGINT AS station,
                   sum(CASE WHEN l_linenumber = 5 AND l_partkey % 3 = 0
                            THEN 1 ELSE 0 END)::BIGINT AS date,
                   sum(CASE WHEN l_linenumber = 4 AND l_partkey % 5 = 0
                            THEN 1 ELSE 0 END)::BIGINT AS element
            FROM lineitem GROUP BY 1""",
        "stored_day_bitmaps": sql('SELECT Tile_Id, Year, n AS "Count" FROM active_days'),
        "stored_station_bitmaps": sql("SELECT Year, Tile_Id, Station_count FROM counts"),
        "year_lookup": sql(
            f"SELECT Year, Lat, Long, {r('TMAX_summer')} AS TMAX, {r('PRCP_summer')} AS PRCP,"
            f" {r('WTXX_summer')} AS WTXX FROM wide WHERE Year = 1999"
        ),
        "exported_table": sql(f"SELECT {measures}, Lat, Long, Year FROM wide"),
        "tile_polygons": sql("SELECT Lat, Long, Year, ring FROM numbered"),
        "feature_ids": sql("SELECT id, Lat, Long, Year FROM numbered"),
        "geojson_rows": sql("SELECT id, Lat, Long, Year, ring FROM numbered"),
        "feature_collections": sql("""
            SELECT Year, concat('{"type":"FeatureCollection","features":[', string_agg(
                concat('{"type":"Feature","id":', id, ',"properties":{"Lat":', Lat, ',"Long":',
                       Long, ',"Year":', Year, '},"geometry":{"type":"Polygon","coordinates":',
                       ring, '}}'), ',' ORDER BY id), ']}') AS json
            FROM numbered GROUP BY Year"""),
        "point_features": sql(
            "SELECT Year, Lat, Long, 'Feature' AS type, 'Point' AS geometry_type, Long AS x,"
            f" Lat AS y, Tile_Id, {measures} FROM wide"
        ),
        "map_layer": map_sql(),
        "color_scale": color_sql(),
    }
    for name in (
        "yearly_anomalies", "wide_full_join", "restarted_anomalies", "streamed_increments",
        "generated_result", "generated_with_saved_baseline", "corrected_increment",
    ):
        queries[name] = sql(wide)
    queries["rerun_replaces_result"] = sql(f"{wide} WHERE Year <= 1999")
    queries["saved_baseline"] = queries["daily_anomaly"]
    queries["yearly_anomalies_strict"] = sql(wide, **strict)
    queries["late_baseline_year"] = queries["yearly_anomalies_strict"]
    # The last year keeps the values that were written first.
    kept = ", ".join(
        f"{r(f'CASE WHEN Year = 2001 THEN {m} + 1 ELSE {m} END')} AS {m}" for m in MEASURES
    )
    queries["yearly_increment"] = sql(f"SELECT Year, Tile_Id, Lat, Long, {kept} FROM wide")
    return queries
