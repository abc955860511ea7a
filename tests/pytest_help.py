"""Small frames for tests."""

import datetime as dt

D = dt.date.fromisoformat
KEY = "security_id string, fiscal_year int, period string, end_date date, accepted_date date, filing_date date"


def versions(spark, fields, rows):
    """Rows (fiscal_year, period, end, accepted, *values) of security `s`."""
    schema = f"{KEY}, " + ", ".join(f"{f} double" for f in fields)
    data = [("s", r[0], r[1], D(r[2]), D(r[3]), D(r[3]), *[None if x is None else float(x) for x in r[4:]]) for r in rows]
    return spark.createDataFrame(data, schema)


def grid(spark, *days, security="s"):
    return spark.createDataFrame([(security, D(d)) for d in days], "security_id string, as_of_date date")


def securities(spark, **more):
    return spark.createDataFrame([("s", "SYM", "0000000001", more.get("sector"))], "security_id string, symbol string, cik string, sector string")
