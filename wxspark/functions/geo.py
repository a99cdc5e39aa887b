"""Distances and the built-in city list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_KM = 6371.0

# Popular cities in order (name, latitude, longitude, region).
CITY_COUNTRY = "India"
CITIES = [
    ("Mumbai", 19.0760, 72.8777, "Maharashtra"),
    ("Delhi", 28.7041, 77.1025, "Delhi"),
    ("Bangalore", 12.9716, 77.5946, "Karnataka"),
    ("Hyderabad", 17.3850, 78.4867, "Telangana"),
    ("Chennai", 13.0827, 80.2707, "Tamil Nadu"),
    ("Kolkata", 22.5726, 88.3639, "West Bengal"),
    ("Pune", 18.5204, 73.8567, "Maharashtra"),
    ("Ahmedabad", 23.0225, 72.5714, "Gujarat"),
    ("Jaipur", 26.9124, 75.7873, "Rajasthan"),
    ("Surat", 21.1702, 72.8311, "Gujarat"),
    ("Lucknow", 26.8467, 80.9462, "Uttar Pradesh"),
    ("Kanpur", 26.4499, 80.3319, "Uttar Pradesh"),
    ("Nagpur", 21.1458, 79.0882, "Maharashtra"),
    ("Indore", 22.7196, 75.8577, "Madhya Pradesh"),
    ("Bhopal", 23.2599, 77.4126, "Madhya Pradesh"),
    ("Visakhapatnam", 17.6868, 83.2185, "Andhra Pradesh"),
    ("Patna", 25.5941, 85.1376, "Bihar"),
    ("Vadodara", 22.3072, 73.1812, "Gujarat"),
    ("Ghaziabad", 28.6692, 77.4538, "Uttar Pradesh"),
    ("Ludhiana", 30.9010, 75.8573, "Punjab"),
]

_CITY_SCHEMA = T.StructType(
    [
        T.StructField("rank", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("lat", T.DoubleType(), False),
        T.StructField("lon", T.DoubleType(), False),
        T.StructField("region", T.StringType(), False),
        T.StructField("country", T.StringType(), False),
    ]
)


def cities(spark: SparkSession) -> DataFrame:
    """The fixed list as a frame: rank (1-based), name, lat, lon, region, country."""
    return spark.createDataFrame([(i, n, a, o, r, CITY_COUNTRY) for i, (n, a, o, r) in enumerate(CITIES, 1)], _CITY_SCHEMA)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
