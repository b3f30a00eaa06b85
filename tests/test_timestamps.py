from datetime import UTC, datetime
from zoneinfo import ZoneInfo

from gleanstone.operators.timestamps import untidy_instants, zone_intervals

MAPPINGS = [("utc", None, True, None), ("berlin", "dmy", False, "Europe/Berlin"), ("york", "mdy", False, "America/New_York"), ("none", None, False, None), ("kolkata", "dmy", False, "Asia/Kolkata")]
CASES = [
    ("utc", "2026-01-05T10:00:00.999Z", "2026-01-05T10:00:00Z"),
    ("utc", "2026-01-05 10:00:00", "2026-01-05T10:00:00Z"),
    ("none", "2026-01-05 10:00:00", None),
    ("none", "2026-01-05t10:00:00z", "2026-01-05T10:00:00Z"),
    ("none", " 2026-01-05T10:00:00Z\n", "2026-01-05T10:00:00Z"),
    ("none", "20260105T100000Z", "2026-01-05T10:00:00Z"),
    ("none", "1767607200", "2026-01-05T10:00:00Z"),
    ("none", "1767607200.98", "2026-01-05T10:00:00Z"),
    ("none", "1767607200123", "2026-01-05T10:00:00Z"),
    ("none", "1767607200123456", "2026-01-05T10:00:00Z"),
    ("none", "1767607200123456789", "2026-01-05T10:00:00Z"),
    ("none", "1767607199500", "2026-01-05T09:59:59Z"),
    ("none", "1767607199999", "2026-01-05T09:59:59Z"),
    ("none", "1767607199500000", "2026-01-05T09:59:59Z"),
    ("none", "1767607199999999", "2026-01-05T09:59:59Z"),
    ("none", "1767607199500000000", "2026-01-05T09:59:59Z"),
    ("none", "1767607199999999999", "2026-01-05T09:59:59Z"),
    ("none", "001767607199999.9", "2026-01-05T09:59:59Z"),
    ("none", "99999999999", "5138-11-16T09:46:39Z"),
    ("none", "100000000000", "1973-03-03T09:46:40Z"),
    ("none", "0", "1970-01-01T00:00:00Z"),
    ("none", "-5", None),
    ("berlin", "05.01.2026 10:00:00", "2026-01-05T09:00:00Z"),
    ("york", "01/05/2026 10:00:00 PM", "2026-01-06T03:00:00Z"),
    ("york", "01/05/2026 12:10:00 AM", "2026-01-05T05:10:00Z"),
    ("york", "01/05/2026 13:10:00 PM", None),
    ("york", "25/01/2026 10:00:00", None),
    ("utc", "25/01/2026 10:00:00", "2026-01-25T10:00:00Z"),
    ("utc", "05/01/2026 10:00:00", None),
    ("kolkata", "05 Jan 2026 10:00:00", "2026-01-05T04:30:00Z"),
    ("york", "Jan 05, 2026 10:00:00 AM", "2026-01-05T15:00:00Z"),
    ("none", "Mon, 05 Jan 2026 10:00:00 +0530", "2026-01-05T04:30:00Z"),
    ("none", "2026-01-05T10:00:00,5+01:00", "2026-01-05T09:00:00Z"),
    ("none", "2026-01-05T10:00:00+01:00[Europe/Berlin]", "2026-01-05T09:00:00Z"),
    ("none", "2026-07-05 10:00:00 Europe/Berlin", "2026-07-05T08:00:00Z"),
    ("none", "2026-01-05 10:00:00 Mars/Base", None),
    ("none", "2026-11-01 01:30:00 EDT", "2026-11-01T05:30:00Z"),
    ("none", "2026-11-01 01:30:00 EST", "2026-11-01T06:30:00Z"),
    ("none", "2026-01-05 10:00:00 IST", None),
    ("kolkata", "2026-01-05 10:00:00 IST", "2026-01-05T04:30:00Z"),
    ("york", "2026-11-01 01:30:00", None),  # twice
    ("york", "2026-03-08 02:30:00", None),  # never
    ("york", "2026-03-08 03:00:00", "2026-03-08T07:00:00Z"),
    ("berlin", "2026-10-25 03:00:00", "2026-10-25T02:00:00Z"),
    ("utc", "2026-02-30 10:00:00", None),
    ("utc", "2024-02-29 10:00:00", "2024-02-29T10:00:00Z"),
    ("utc", "0000-00-00 00:00:00", None),
    ("utc", "2026-01-05 24:00:00", None),
    ("utc", "yesterday", None),
    ("utc", "", None),
    ("utc", None, None),
    ("unknown mapping", "2026-01-05 10:00:00", None),
    ("utc", "9" * 40, None),
    ("utc", "2026-01-05T10:00:00Z", None),  # canonical already
]


def found(spark, rows):
    table = spark.createDataFrame([(f"k{i}", m, v, "x") for i, (m, v) in enumerate(rows)], "id string, mapping_name string, v string, value string")
    mappings = spark.createDataFrame(MAPPINGS, "mapping_name string, date_order string, naive_is_utc boolean, naive_zone string")
    out = untidy_instants([("t", table, "id", "v")], mappings).collect()
    assert len(out) == len({r["row_key"] for r in out})
    return {r["row_key"]: r["instant_utc"] for r in out}


def test_every_form(spark):
    got = found(spark, [(m, v) for m, v, _ in CASES])
    assert {f"k{i}": e for i, (_, _, e) in enumerate(CASES) if e} == got


def test_repeated_rows_and_empty_tables(spark):
    table = spark.createDataFrame([("a", "utc", "2026-01-05 10:00:00")] * 3, "id string, mapping_name string, v string")
    mappings = spark.createDataFrame(MAPPINGS, "mapping_name string, date_order string, naive_is_utc boolean, naive_zone string")
    assert untidy_instants([("t", table, "id", "v")], mappings).count() == 1
    assert untidy_instants([("t", table.limit(0), "id", "v")], mappings).count() == 0
    assert untidy_instants([("t", table, "id", "v")], mappings.limit(0)).count() == 0


def test_intervals_agree_with_the_time_zone_database(spark):
    zones = ["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Asia/Kolkata"]
    pairs = spark.createDataFrame([(z.lower(), 2026) for z in zones] + [("no/where", 2026), (None, None)], "zone string, year int")
    spans = zone_intervals(pairs).collect()
    assert {r["zone"] for r in spans} == {z.lower() for z in zones}
    for z in zones:
        mine = [r for r in spans if r["zone"] == z.lower()]
        for hour in range(0, 8760, 7):
            instant = 1767225600 + hour * 3600
            offset = int(datetime.fromtimestamp(instant, UTC).astimezone(ZoneInfo(z)).utcoffset().total_seconds())
            assert offset in [r["offset"] for r in mine if r["begins"] <= instant + offset < r["ends"]]
