"""Declared schemas of the production payload and facts."""

from __future__ import annotations

from pyspark.sql import types as T

# The field names of the delivered payload and of the stored
# and curated tables must stay as they are.

# One hourly entry of the API's nested list.
HOURLY_ENTRY = T.StructType([
    T.StructField("priceArea", T.StringType()),
    T.StructField("productionGroup", T.StringType()),
    T.StructField("startTime", T.StringType()),
    T.StructField("endTime", T.StringType()),
    T.StructField("lastUpdatedTime", T.StringType()),
    T.StructField("quantityKwh", T.DoubleType()),
])

# One record of the response envelope's ``data`` list.
PAYLOAD_RECORD = T.StructType([
    T.StructField("priceArea", T.StringType()),
    T.StructField("attributes", T.StructType([
        T.StructField("productionPerGroupMbaHour", T.ArrayType(HOURLY_ENTRY)),
    ])),
])

# A landed response: the envelope with its ``data`` list.
PAYLOAD_ENVELOPE = T.StructType([T.StructField("data", T.ArrayType(PAYLOAD_RECORD))])

# The production fact table; every field is required.
PRODUCTION = T.StructType([
    T.StructField("priceArea", T.StringType(), False),
    T.StructField("productionGroup", T.StringType(), False),
    T.StructField("startTime", T.StringType(), False),
    T.StructField("endTime", T.StringType(), False),
    T.StructField("lastUpdatedTime", T.StringType(), False),
    T.StructField("quantityKwh", T.DoubleType(), False),
])

# Stored table DDL (SNK-05): lower-case names plus a 64-bit row id.
STORED_TABLE_DDL = ("ind BIGINT, pricearea STRING, productiongroup STRING, starttime STRING, "
                    "endtime STRING, quantitykwh DOUBLE, lastupdatedtime STRING")

CURATED_COLUMNS = ["pricearea", "productiongroup", "starttime", "quantitykwh"]
