"""Column names and schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw log file, in file order. Everything is read as text and cast afterwards,
# so that a bad value costs one field and not the row.
RAW_LOG = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("Date", "Time", "IP", "Node", "Port", "PID", "Username", "Tag", "Message")
    ]
)

# Value of one entry of the address lookup. Coordinates arrive as numbers or as
# text, so they are kept as text until ``safe_double``.
LOOKUP_ENTRY = T.StructType(
    [
        T.StructField("cntn", T.StringType()),
        T.StructField("cc", T.StringType()),
        T.StructField("cn", T.StringType()),
        T.StructField("lat", T.StringType()),
        T.StructField("lng", T.StringType()),
        T.StructField(
            "asn",
            T.StructType(
                [T.StructField(name, T.StringType()) for name in ("asn", "name", "domain", "type")]
            ),
        ),
    ]
)

ENRICHMENT = (
    "continent",
    "country_code",
    "country",
    "latitude",
    "longitude",
    "asn",
    "asn_name",
    "asn_domain",
    "asn_type",
)

# The enriched fact, in output order.
ATTACKS = T.StructType(
    [
        T.StructField("datetime", T.TimestampNTZType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("IP", T.StringType()),
        T.StructField("Time", T.LongType()),
        T.StructField("continent", T.StringType()),
        T.StructField("country_code", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("asn", T.StringType()),
        T.StructField("asn_name", T.StringType()),
        T.StructField("asn_domain", T.StringType()),
        T.StructField("asn_type", T.StringType()),
        T.StructField("Node", T.StringType()),
        T.StructField("Port", T.LongType()),
        T.StructField("PID", T.StringType()),
        T.StructField("Username", T.StringType()),
        T.StructField("Tag", T.StringType()),
        T.StructField("Message", T.StringType()),
    ]
)

# Name of the entity column for each dimension of the daily rollups.
ENTITY = {"country": "country", "asn": "asn_name", "ip": "ip", "username": "username"}
