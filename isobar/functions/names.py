"""Names and units of codes, as small dimension tables that are joined by broadcast.

The short tables are built in. The tables of parameters are long and change with every version, so they are read from a folder of WMO table files
(``4.2.<discipline>.<category>.table`` and others) that is given as a parameter; a few common parameters serve where there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the code tables, code and name.
TABLES: dict[str, str] = {
    "discipline": """
0 Meteorological products
1 Hydrological products
2 Land surface products
3 Satellite remote sensing products
4 Space weather products
10 Oceanographic products
20 Health and socioeconomic impacts
191 Computational parameters
255 Missing
""",
    "centre": """
0 WMO Secretariat
1 Melbourne (WMC)
4 Moscow (WMC)
7 US National Weather Service - NCEP
8 US National Weather Service - NWSTG
9 US National Weather Service - Other
28 New Delhi (IMD)
34 Japanese Meteorological Agency - Tokyo (RSMC)
38 Beijing (RSMC)
40 Seoul
46 Brazilian Space Agency - INPE
54 Canadian Meteorological Service - Montreal (RSMC)
58 US Navy - Fleet Numerical Oceanography Center
59 NOAA Forecast Systems Lab, Boulder CO
60 National Center for Atmospheric Research (NCAR)
74 U.K. Met Office - Exeter
78 Offenbach (DWD)
85 French Weather Service - Toulouse
86 Helsinki (FMI)
88 Oslo (NMI)
94 Copenhagen (DMI)
98 European Centre for Medium-Range Weather Forecasts (ECMWF)
99 DeBilt, Netherlands (KNMI)
215 Zurich (MeteoSwiss)
250 COSMO
254 EUMETSAT Operation Centre
""",
    "reference time significance": """
0 Analysis
1 Start of forecast
2 Verifying time of forecast
3 Observation time
4 Local time
255 Missing
""",
    "production status": """
0 Operational products
1 Operational test products
2 Research products
3 Re-analysis products
4 THORPEX Interactive Grand Global Ensemble (TIGGE)
5 THORPEX Interactive Grand Global Ensemble test (TIGGE)
6 S2S operational products
7 S2S test products
8 Uncertainties in Ensembles of Regional ReAnalyses (UERRA)
9 Uncertainties in Ensembles of Regional ReAnalyses test (UERRA)
10 Copernicus regional reanalysis (CARRA/CERRA)
11 Copernicus regional reanalysis test (CARRA/CERRA)
255 Missing
""",
    "data type": """
0 Analysis products
1 Forecast products
2 Analysis and forecast products
3 Control forecast products
4 Perturbed forecast products
5 Control and perturbed forecast products
6 Processed satellite observations
7 Processed radar observations
8 Event probability
255 Missing
""",
    "surface type": """
1 Ground or water surface
2 Cloud base level
3 Level of cloud tops
4 Level of 0 degree C isotherm
5 Level of adiabatic condensation lifted from the surface
6 Maximum wind level
7 Tropopause
8 Nominal top of the atmosphere
9 Sea bottom
10 Entire atmosphere
20 Isothermal level
100 Isobaric surface
101 Mean sea level
102 Specific altitude above mean sea level
103 Specified height level above ground
104 Sigma level
105 Hybrid level
106 Depth below land surface
107 Isentropic (theta) level
108 Level at specified pressure difference from ground to level
109 Potential vorticity surface
111 Eta level
160 Depth below sea level
200 Entire atmosphere (considered as a single layer)
255 Missing
""",
    "product definition template": """
0 Analysis or forecast at a horizontal level or in a horizontal layer at a point in time
1 Individual ensemble forecast, control and perturbed, at a horizontal level or in a horizontal layer at a point in time
2 Derived forecasts based on all ensemble members at a horizontal level or in a horizontal layer at a point in time
8 Average, accumulation, extreme values or other statistically processed values at a horizontal level or in a horizontal layer in a continuous or non-continuous time interval
11 Individual ensemble forecast, control and perturbed, at a horizontal level or in a horizontal layer, in a continuous or non-continuous time interval
12 Derived forecasts based on all ensemble members at a horizontal level or in a horizontal layer, in a continuous or non-continuous time interval
65535 Missing
""",
    "data representation template": """
0 Grid point data - simple packing
2 Grid point data - complex packing
3 Grid point data - complex packing and spatial differencing
4 Grid point data - IEEE floating point data
40 Grid point data - JPEG 2000 code stream format
41 Grid point data - Portable Network Graphics (PNG)
42 Grid point data - CCSDS recommended lossless compression
200 Run length packing with level values
65535 Missing
""",
    "grid definition template": """
0 Latitude/longitude (equidistant cylindrical, or Plate Carree)
1 Rotated latitude/longitude
10 Mercator
20 Polar stereographic projection
30 Lambert conformal
40 Gaussian latitude/longitude
90 Space view perspective or orthographic
65535 Missing
""",
}
#: Discipline, category, number, name and unit of common parameters.
PARAMETERS = """
0 0 0 Temperature|K
0 0 6 Dewpoint temperature|K
0 1 0 Specific humidity|kg kg-1
0 1 1 Relative humidity|%
0 1 8 Total precipitation|kg m-2
0 2 2 u-component of wind|m s-1
0 2 3 v-component of wind|m s-1
0 3 0 Pressure|Pa
0 3 5 Geopotential height|gpm
0 6 1 Total cloud cover|%
"""
#: Discipline, category and the category's name.
CATEGORIES = """
0 0 Temperature
0 1 Moisture
0 2 Momentum
0 3 Mass
0 4 Short-wave radiation
0 5 Long-wave radiation
0 6 Cloud
0 7 Thermodynamic stability indices
0 13 Aerosols
0 14 Trace gases
0 15 Radar
0 16 Forecast radar imagery
0 17 Electrodynamics
0 19 Physical atmospheric properties
1 0 Hydrology basic products
1 1 Hydrology probabilities
2 0 Vegetation/biomass
2 3 Soil products
10 0 Waves
10 1 Currents
10 2 Ice
10 3 Surface properties
"""
#: The same for parameters that centre 7 defines itself.
LOCAL_PARAMETERS = """
0 1 192 Categorical Rain|-
0 1 193 Categorical Freezing Rain|-
0 1 194 Categorical Ice Pellets|-
0 1 195 Categorical Snow|-
0 3 198 MSLP (MAPS System Reduction)|Pa
0 7 199 Hourly Maximum of Updraft Helicity|m^2/s^2
0 16 195 Reflectivity|dB
0 16 196 Composite reflectivity|dB
0 17 192 Lightning|non-dim
"""
LOCAL_CENTRE = 7


def code_table(spark: SparkSession, table: str) -> DataFrame:
    """(code, name) of a built-in table."""
    rows = [line.split(" ", 1) for line in TABLES[table].strip().splitlines()]
    return spark.createDataFrame([(int(c), n) for c, n in rows], "code int, name string")


def parameter_table(spark: SparkSession, text: str = PARAMETERS) -> DataFrame:
    """(discipline, category, number, name, unit) of parameters in plain text."""
    rows = []
    for line in text.strip().splitlines():
        d, c, n, rest = line.split(" ", 3)
        rows.append((int(d), int(c), int(n), *rest.split("|")))
    return spark.createDataFrame(rows, "discipline int, category int, number int, name string, unit string")


def wmo_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """The parameters of a folder of WMO table files; lines are code, code or abbreviation, description and unit in brackets."""
    lines = spark.read.text(f"{folder}/4.2.*.table").select("value", F.input_file_name().alias("file")).where("value rlike '^[0-9]+ '")
    key = lambda k: F.regexp_extract("file", r"4\.2\.(\d+)\.(\d+)\.table", k).cast("int")
    pattern = r"^(\d+) +\S+ +(.*?)(?: +\(([^()]*(?:\([^()]*\)[^()]*)*)\))?\s*$"
    return lines.select(key(1).alias("discipline"), key(2).alias("category"), F.regexp_extract("value", pattern, 1).cast("int").alias("number"), F.regexp_extract("value", pattern, 2).alias("name"), F.regexp_extract("value", pattern, 3).alias("unit"))


def wmo_codes(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """(code, name) of a table file of a folder of WMO tables, such as ``4.5``; lines are code, code or abbreviation, description. Ranges of codes have no name."""
    lines = spark.read.text(f"{folder}/{table}.table").where("value rlike '^[0-9]+ '")
    pattern = r"^(\d+) +\S+ +(.*?) *$"
    return lines.select(F.regexp_extract("value", pattern, 1).cast("int").alias("code"), F.regexp_extract("value", pattern, 2).alias("name"))


def category_table(spark: SparkSession, text: str = CATEGORIES) -> DataFrame:
    """(discipline, category, name) of parameter categories in plain text."""
    rows = [line.split(" ", 2) for line in text.strip().splitlines()]
    return spark.createDataFrame([(int(d), int(c), n) for d, c, n in rows], "discipline int, category int, name string")


def with_category(df: DataFrame, out: str = "category_name", categories: DataFrame | None = None) -> DataFrame:
    """Adds the name of the category for (discipline, category), or what says that it is unknown."""
    named = (categories if categories is not None else category_table(df.sparkSession)).toDF("_d", "_c", "_name")
    unknown = F.format_string("Unknown parameter category (%d, %d)", F.col("discipline"), F.col("category"))
    return df.join(F.broadcast(named), (F.col("discipline") == F.col("_d")) & (F.col("category") == F.col("_c")), "left").withColumn(out, F.coalesce("_name", unknown)).drop("_d", "_c", "_name")


def with_name(df: DataFrame, code: str, table: str, out: str, names: DataFrame | None = None) -> DataFrame:
    """Adds the name of a code, of a built-in table or of ``names`` (code, name), or what says that it is unknown."""
    names = (names if names is not None else code_table(df.sparkSession, table)).toDF("_code", "_name")
    return df.join(F.broadcast(names), F.col(code) == F.col("_code"), "left").withColumn(out, F.coalesce("_name", F.format_string(f"Unknown {table} (%d)", F.col(code)))).drop("_code", "_name")


def local_use(category: Column, number: Column) -> Column:
    """Whether a parameter is one of those that centres define themselves."""
    return category.between(192, 254) | number.between(192, 254)


def with_parameter(df: DataFrame, parameters: DataFrame | None = None, local: DataFrame | None = None, centre: str | None = "centre") -> DataFrame:
    """Adds ``parameter`` and ``unit`` for (discipline, category, number), of the centre's own table where it has one. Unknown parameters are named by their numbers, their unit is ``unknown``."""
    spark = df.sparkSession
    key = ["discipline", "category", "number"]
    world = (parameters if parameters is not None else parameter_table(spark)).toDF("_d", "_c", "_n", "_name", "_unit")
    on = lambda p: [F.col("discipline") == F.col(f"{p}d"), F.col("category") == F.col(f"{p}c"), F.col("number") == F.col(f"{p}n")]
    out = df.join(F.broadcast(world), on("_"), "left")
    name, unit = F.col("_name"), F.col("_unit")
    if centre:
        own = (local if local is not None else parameter_table(spark, LOCAL_PARAMETERS)).toDF("_ld", "_lc", "_ln", "_lname", "_lunit")
        out = out.join(F.broadcast(own), [*on("_l"), F.col(centre) == LOCAL_CENTRE, local_use(F.col("category"), F.col("number"))], "left")
        name, unit = F.coalesce("_lname", "_name"), F.coalesce("_lunit", "_unit")
    unknown = F.format_string("Unknown parameter (%d, %d, %d)", *map(F.col, key))
    return out.select(*df.columns, F.coalesce(name, unknown).alias("parameter"), F.coalesce(unit, F.lit("unknown")).alias("unit"))


def surface_value(scale: Column, value: Column) -> Column:
    """The level of a surface: the value by the power of ten of its scale. All ones in the scale mean none; a missing value is null."""
    v = value.cast("double")
    power = F.pow(F.lit(10.0), F.abs(scale))
    return F.when(value == 0xFFFFFFFF, None).when((scale == -127) | (scale == 0), v).when(scale > 0, v / power).otherwise(v * power)


def surface_value_hpa(kind: Column, scale: Column, value: Column) -> Column:
    """The level of a surface, that of an isobaric one (type 100) in hectopascals."""
    level = surface_value(scale, value)
    return F.when(kind == 100, level / 100).otherwise(level)


def reference_time(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """The time, with parts beyond their range carried over; null for no year."""
    start = F.make_timestamp(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return start + F.make_interval(months=mo - 1) + F.make_interval(days=d - 1, hours=h, mins=mi, secs=s)


def valid_time(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """The time if its parts make a real one, else null."""
    return F.when(s <= 59, F.try_make_timestamp(y, mo, d, h, mi, s))
