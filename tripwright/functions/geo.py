"""Great-circle distance and geographic lookups."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: mean Earth radius in km.
EARTH_RADIUS_KM = 6371.0
# Month to season.
SEASONS = {
    "winter": (12, 1, 2),
    "spring": (3, 4, 5),
    "summer": (6, 7, 8),
    "fall": (9, 10, 11),
}
# Census regions and their states.
CENSUS_REGIONS = {
    "Northeast": ("Connecticut", "Maine", "Massachusetts", "New Hampshire", "Rhode Island", "Vermont",
                  "New Jersey", "New York", "Pennsylvania"),
    "Midwest": ("Illinois", "Indiana", "Michigan", "Ohio", "Wisconsin", "Iowa", "Kansas", "Minnesota",
                "Missouri", "Nebraska", "North Dakota", "South Dakota"),
    "South": ("Delaware", "District of Columbia", "Florida", "Georgia", "Maryland", "North Carolina",
              "South Carolina", "Virginia", "West Virginia", "Alabama", "Kentucky", "Mississippi",
              "Tennessee", "Arkansas", "Louisiana", "Oklahoma", "Texas"),
    "West": ("Arizona", "Colorado", "Idaho", "Montana", "Nevada", "New Mexico", "Utah", "Wyoming",
             "California", "Oregon", "Washington"),
    "Alaska": ("Alaska",),
    "Hawaii": ("Hawaii",),
}
TERRITORY = "Non-contiguous territory"


def census_region(state: Column, country: Column) -> Column:
    """Region of a US state; any other country is one bucket; unknown states stay 'Unknown'."""
    region = F.lit("Unknown")
    for name, states in CENSUS_REGIONS.items():
        region = F.when(state.isin(*states), name).otherwise(region)
    return F.when(F.coalesce(country, F.lit("")) != "US", TERRITORY).otherwise(region)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = (F.radians(lat2) - F.radians(lat1)) / 2
    half_lon = (F.radians(lon2) - F.radians(lon1)) / 2
    chord = (F.pow(F.sin(half_lat), 2)
             + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2))
    return F.asin(F.sqrt(chord)) * (2 * EARTH_RADIUS_KM)


def season(month: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        label = F.when(month.isin(*months), name).otherwise(label)
    return label


def zone_short_name(zone: Column) -> Column:
    return F.coalesce(F.substring_index(zone, "/", -1), F.lit("unknown"))


def region_zone_bucket(region: Column, zone: Column, own_bucket: tuple[str, ...] = ()) -> Column:
    """Region, with the zone's short name added unless the region stands by itself."""
    joined = F.concat_ws(":", region, zone_short_name(zone))
    return F.when(region.isin(*own_bucket), region).otherwise(joined) if own_bucket else joined


def lookup(key: Column, table: dict, default: str | None = None) -> Column:
    """Small literal map; for larger tables join a dimension instead."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))
