"""Distance on the globe as a Column expression."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371  # fixed value


def haversine(lat1, long1, lat2, long2, variant: str = "radians") -> Column:
    """Great-circle distance in km between two points given in degrees; NULL if a coordinate is NULL.

    ``variant="degrees"`` takes the cosine of the latitudes without converting them to radians, for
    comparison with tables computed that way. Its inner term can leave [0, 1]; the distance is then NULL.
    """
    lat1, long1, lat2, long2 = (F.col(c) if isinstance(c, str) else c for c in (lat1, long1, lat2, long2))
    angle = F.radians if variant == "radians" else (lambda c: c)
    if variant not in ("radians", "degrees"):
        raise ValueError(f"unknown variant {variant!r}")
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_long = F.sin((F.radians(long2) - F.radians(long1)) / 2)
    chord = half_lat * half_lat + F.cos(angle(lat1)) * F.cos(angle(lat2)) * half_long * half_long
    if variant == "radians":
        # Rounding can push the term of opposite points just above 1.
        return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(chord), F.sqrt(F.greatest(1 - chord, F.lit(0.0))))
    km = 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))
    return F.when(chord.between(0, 1), km)
