"""hazardframe: Spark-native analytics for large tables of dated, geolocated incidents."""

from hazardframe.roles import INCIDENT, Roles

__all__ = ["INCIDENT", "Roles"]
