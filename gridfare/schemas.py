"""Column lists, domains and Spark schemas of both data models."""

from __future__ import annotations

from pyspark.sql import types as T

# The fare row, version 4, in file order. Version 3 is the first 29 columns.
FARE_COLUMNS = [
    "Schema_Version", "Scrape_Timestamp", "Days_to_Departure", "Departure_Date", "Day_of_Week",
    "Booking_Day_Of_Week", "Departure_Time", "Departure_ISO", "Departure_Hour", "Arrival_Time", "Arrival_ISO",
    "Is_Weekend_Departure", "Is_Overnight", "Source_City", "Destination_City", "Airline", "Flight_Number",
    "Aircraft", "Total_Duration_Mins", "Number_of_Stops", "Layover_City", "Layover_Duration_Mins",
    "Self_Transfer", "CO2_Emissions_Kg", "CO2_Delta_Pct", "Num_Results", "Data_Source", "Flight_Category",
    "Price_INR", "Carbon_Typical_g", "Currency", "Cabin_Class", "Run_Id",
]
FARE_COLUMNS_V3 = FARE_COLUMNS[:29]
SCHEMA_VERSION = 4

# Category domains, price band, booking horizons, gate.
PRICED_CATEGORIES = ["Best", "Cheapest", "Median"]
FLIGHT_CATEGORIES = PRICED_CATEGORIES + ["NoFlights"]
DATA_SOURCES = ["fast-flights", "fli", "playwright"]
MIN_PRICE, MAX_PRICE = 1000, 200000
HORIZONS = [1, 3, 7, 14, 30, 60]
BATCHES = 3
ROTATION_EPOCH = "2000-01-01"
MIN_SUCCESS_RATE = 0.60
EXIT_OK, EXIT_GATE = 0, 3
DISPLAY_ZONE = "Asia/Kolkata"
CURRENCY, CABIN, SOURCE = "INR", "economy", "fast-flights"
STALE_HOURS = 36

INTEGER_FARE_COLUMNS = {
    "Schema_Version", "Days_to_Departure", "Departure_Hour", "Is_Weekend_Departure", "Is_Overnight",
    "Total_Duration_Mins", "Number_of_Stops", "Layover_Duration_Mins", "Self_Transfer", "CO2_Emissions_Kg",
    "CO2_Delta_Pct", "Num_Results", "Price_INR", "Carbon_Typical_g",
}

FARE_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType() if c in INTEGER_FARE_COLUMNS else T.StringType()) for c in FARE_COLUMNS]
)

LEG_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("from_code", "from_name", "to_code", "to_name")]
    + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("dep_date", "dep_time", "arr_date", "arr_time")]
    + [T.StructField("duration", T.IntegerType()), T.StructField("plane_type", T.StringType())]
)
ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("price", T.DoubleType()),
        T.StructField("type", T.StringType()),
        T.StructField("airlines", T.ArrayType(T.StringType())),
        T.StructField("legs", T.ArrayType(LEG_SCHEMA)),
        T.StructField(
            "carbon",
            T.StructType(
                [T.StructField("typical_on_route", T.LongType()), T.StructField("emission", T.LongType())]
            ),
        ),
    ]
)

GRID = 8
CELLS = GRID * GRID
CELL_NAMES = [f"c{n:02d}" for n in range(1, CELLS + 1)]
CELL_WIDTH, CELL_HEIGHT = 100, 75
FOLD_LIMITS = [250, 500, 750]
NO_PLAYER_RANGE = (251, 287)

ANNOTATION_SCHEMA = T.StructType(
    [
        T.StructField("image", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("count", T.IntegerType()),
    ]
    + [T.StructField(c, T.IntegerType()) for c in CELL_NAMES]
)

# Team id to short name.
TEAMS = {
    0: "Empty", 1: "CSK", 2: "DC", 3: "GT", 4: "KKR", 5: "LSG", 6: "MI", 7: "PBKS", 8: "RR", 9: "RCB", 10: "SRH",
}
