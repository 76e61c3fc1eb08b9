"""Distances on the globe as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # Rounding may push the root beyond 1 at antipodes.
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
