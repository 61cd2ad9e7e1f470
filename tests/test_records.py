"""Nested records and dates against brute force."""

import json
import random
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from foliospark.operators import nested, timestamps


def outlines(spark, rows):
    return spark.createDataFrame(rows, "record_id bigint, payload string, doc_id bigint")


def test_flatten_notations():
    payload = {"doc": {"Outlines": [None, {"Title": "a", "Children": {"0": {"title": "b", "Kids": None}, "1": None, "10": {"Title": "c", "Dest": [3, "XYZ", 1, 2, None]}}, "Destination": ""}, {"Title": "d", "Children": json.dumps([{"Title": "e", "Destination": {"Name": "n", "Page": 0}}]), "destination": {"Page": 2}}]}}
    rows = nested.flatten(7, json.dumps(payload))
    assert [(r[1], r[2], r[3]) for r in sorted(rows, key=lambda r: (r[2], r[1]))] == [("outline", "0", ""), ("outline", "0.0", "0"), ("destination", "0.1", "0.1"), ("outline", "0.1", "0"), ("destination", "1", "1"), ("outline", "1", ""), ("destination", "1.0", "1.0"), ("outline", "1.0", "1")]
    for broken in (None, "", "  ", "{", '[{"Title": "a"', '{"Outlines": "[{"}', "nonsense"):
        try:
            nested.flatten(1, broken)
            raise AssertionError(broken)
        except nested.Malformed:
            pass
    assert nested.flatten(1, "null") == [] and nested.flatten(1, '{"Outlines": null}') == [] and nested.flatten(1, "[]") == []


def test_deep_payload_and_identities():
    deep = []
    for i in range(60):
        deep = [{"Title": "same", "Children": deep}, {"Title": "same", "Children": deep if i < 4 else []}]
    rows = nested.flatten(1, json.dumps(deep))
    assert max(r[4] for r in rows) == 59
    twins = nested.flatten(1, json.dumps([{"Title": "x", "Kids": [{"Title": "y"}]}, {"title": "x", "Children": {"Title": "y"}}]))
    by_path = {r[2]: r[6] for r in twins}
    assert by_path["0"] == by_path["1"] and by_path["0.0"] == by_path["1.0"] and by_path["0"] != by_path["0.0"]


def test_bridge_objects_and_edges(spark):
    tree = json.dumps([{"Title": "x", "Children": [{"Title": "y", "Destination": {"Page": 2}}]}])
    df = outlines(spark, [(1, tree, 5), (1, tree, 5), (2, tree, 6), (3, None, 7), (4, "", 8), (None, tree, 9)])
    bridge = nested.bridge_rows(df).cache()
    assert bridge.count() == 6
    objects = {r.node: r.occurrences for r in nested.object_rows(bridge).collect()}
    assert sorted(objects.values()) == [2, 2, 2]
    assert nested.edge_rows(bridge).count() == 2
    status = {r.record_id: (r.readable, r.n_outlines, r.n_destinations) for r in nested.payload_status(df).collect()}
    assert status == {1: (True, 2, 1), 2: (True, 2, 1), 3: (False, 0, 0), 4: (False, 0, 0)}
    assert nested.bridge_rows(df.limit(0)).count() == 0


def brute(y, mo, d, h, mi, s, zone):
    found = set()
    for fold in (0, 1):
        local = datetime(y, mo, d, h, mi, s, tzinfo=ZoneInfo(zone), fold=fold)
        at = local.astimezone(timezone.utc)
        if at.astimezone(ZoneInfo(zone)).replace(tzinfo=None, fold=0) == datetime(y, mo, d, h, mi, s):
            found.add(at.strftime("%Y-%m-%d %H:%M:%S"))
    return found.pop() if len(found) == 1 else "unresolved"


def utc(spark, values, zone="Europe/Berlin", order="DMY"):
    meta = spark.createDataFrame([(i, "c", v, None) for i, v in enumerate(values)], "doc_id bigint, collection string, creation_date string, modified_date string")
    collections = spark.createDataFrame([("c", zone, order)], "collection string, tz string, date_order string")
    rows = {r.doc_id: r.utc for r in timestamps.normalise_dates(meta, collections).collect()}
    return [rows.get(i) for i in range(len(values))]


def test_notations(spark):
    cases = {
        "D:20110327022707": "unresolved", "D:20121028023744": "unresolved", "D:20160624171145+10'00'": "2016-06-24 07:11:45", "D:2016": "2015-12-31 23:00:00", "D:201807": "2018-06-30 22:00:00", "D:20230102030405Z00'00'": "2023-01-02 03:04:05", "D:20230102030405-0330": "2023-01-02 06:34:05",
        "20130404074547+02'00'": "2013-04-04 05:45:47", "2017-12-16T18:34:21+11:00": "2017-12-16 07:34:21", "2011-11-03T11:59:28.0Z": "2011-11-03 11:59:28", "2013-05-16": "2013-05-15 22:00:00", "20140723T0248": "2014-07-23 00:48:00", "Wed, 25 Feb 2009 14:00:32 +0100": "2009-02-25 13:00:32",
        "Fri Sep  9 11:44:07 2014": "2014-09-09 09:44:07", "1269331506": "2010-03-23 08:05:06", "1279941822318": "2010-07-24 03:23:42", "27/03/2013 13:06": "2013-03-27 12:06:00", "9.9.22 1:06 PM": "2022-09-09 11:06:00", "November 16, 2013 12:58 AM": "2013-11-15 23:58:00", "26. Juni 2010, 04:05 Uhr": "2010-06-26 02:05:00",
        "30 octobre 2019 à 4h05": "2019-10-30 03:05:00", "2019-07-04 17:47:53 CET": "2019-07-04 16:47:53", "2014-10-26 02:30:00 CEST": "2014-10-26 00:30:00", "2014-10-26 02:30:00": "unresolved", "0000-00-00 00:00:00": "unresolved", "D:20231345256199Z": "unresolved", "31/02/2020 10:00": "unresolved", "29.02.2019": "unresolved",
        "29.02.2020": "2020-02-28 23:00:00", "": "unresolved", "n/a": "unresolved", "D:": "unresolved", "13:00 PM": "unresolved", "1.1.2020 13:00 PM": "unresolved", "x" * 5000: "unresolved", "2020-01-01 00:00:00 XYZ": "unresolved",
    }
    assert dict(zip(cases, utc(spark, list(cases)))) == cases
    assert utc(spark, ["08/18/19 18:18", "18/08/19 18:18"], "America/New_York", "MDY") == ["2019-08-18 22:18:00", "unresolved"]
    assert utc(spark, ["2020-01-01 00:00:00", "2020-01-01 00:00:00Z"], None) == ["unresolved", "2020-01-01 00:00:00"]


def test_local_times_against_zoneinfo(spark):
    hours = [(2023, 3, 26, h, 30, 0) for h in range(5)] + [(2023, 10, 29, h, 15, 0) for h in range(5)] + [(2011, 12, 30, 12, 0, 0), (2020, 2, 29, 23, 59, 59), (1999, 12, 31, 0, 0, 0)]
    for zone in ("Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "Pacific/Apia", "Australia/Lord_Howe"):
        got = utc(spark, [f"{y}-{mo:02}-{d:02} {h:02}:{mi:02}:{s:02}" for y, mo, d, h, mi, s in hours], zone)
        assert got == [brute(*t, zone) for t in hours], zone


def test_calendar_arithmetic(spark):
    df = spark.range(0, 40_000, 13).withColumn("d", F.date_from_unix_date((F.col("id") - 20_000).cast("int")))
    back = timestamps.days_from_civil(F.year("d").cast("bigint"), F.month("d").cast("bigint"), F.dayofmonth("d").cast("bigint"))
    assert df.where(back != F.col("id") - 20_000).count() == 0


def test_deliveries_and_unknown_collections(spark):
    meta = spark.createDataFrame([(1, "c", "D:2016", None, "2020-01-01 00:00:00"), (1, "c", "D:2017", None, "2021-01-01 00:00:00"), (2, "zz", "D:2016", "D:20160101Z", "2020-01-01 00:00:00"), (None, "c", "D:2016", None, "2020-01-01 00:00:00")], "doc_id bigint, collection string, creation_date string, modified_date string, ingested_at string").withColumn("tz", F.lit("clash"))
    collections = spark.createDataFrame([("c", "UTC", "DMY"), ("c", "UTC", "DMY")], "collection string, tz string, date_order string")
    rows = {(r.doc_id, r.field): r.utc for r in timestamps.normalise_dates(meta, collections).collect()}
    assert rows == {(1, "creation_date"): "2017-01-01 00:00:00", (2, "creation_date"): "unresolved", (2, "modified_date"): "2016-01-01 00:00:00"}
    assert timestamps.normalise_dates(meta.limit(0), collections).count() == 0


def test_nesting_has_no_bound():
    levels = 20_000
    deep = '[{"Title": "t", "Children": ' * levels + "[]" + "}]" * levels
    tree = nested.Tree(deep)
    assert len(tree.parent) == levels and tree.depth[-1] == levels - 1
    last = None
    for last in tree.rows(1):  # paths are written one at a time
        pass
    assert last[2].count(".") == levels - 1 and len(last[2]) == 2 * levels - 1
    wrapped = '{"doc": ' * 3000 + '{"Outlines": [{"Title": "in"}]}' + "}" * 3000
    assert [r[8] for r in nested.flatten(1, wrapped)] == ["in"]
    inside = '{"Outlines": [{"Title": "x", "Extra": ' + '{"k": [' * 3000 + "1" + "]}" * 3000 + "}]}"
    assert nested.flatten(1, inside)[0][15] == [("extra", '{"k":[' * 3000 + "1" + "]}" * 3000)]
    for broken in (deep[:-1], deep + "x", deep.replace("[]", "[,]"), deep.replace("[]", "NaN"), deep.replace("[]", '{"a" 1}')):
        try:
            nested.Tree(broken)
            raise AssertionError(broken[-20:])
        except nested.Malformed:
            pass


def test_deep_parser_reads_what_the_library_reads():
    rng = random.Random(8)

    def some(depth):
        kind = rng.randrange(8 if depth < 5 else 5)
        if kind < 5:
            return (None, True, rng.randint(-99, 99), rng.random() * 1e9, 'ö\n"\\' * rng.randint(0, 3))[kind]
        return [some(depth + 1) for _ in range(rng.randint(0, 3))] if kind == 5 else {f"k{i}": some(depth + 1) for i in range(rng.randint(0, 3))}

    for _ in range(300):
        value = some(0)
        text = json.dumps(value, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        assert nested._loads_deep(f" {text}\n") == value
        at = rng.randrange(len(text))
        broken = text[:at] + rng.choice('[]{},:"x1 ') + text[at + 1 :]
        try:
            want = nested._DECODER.decode(broken)
        except ValueError:
            want = nested.Malformed
        try:
            got = nested._loads_deep(broken)
        except nested.Malformed:
            got = nested.Malformed
        assert got == want, broken


def test_attributes_are_part_of_identity_and_have_rows(spark):
    a = '{"pageCount": 3, "Outlines": [{"Title": "x", "Count": 4, "Dest": {"Page": 2, "Fit": "XYZ"}}, {"title": "x", "count": 4, "dest": {"page": 2, "fit": "XYZ"}}, {"title": "x", "count": 5, "dest": {"page": 2, "fit": "XYZ"}}]}'
    nodes = [r[6] for r in nested.flatten(1, a) if r[1] == "outline"]
    assert nodes[0] == nodes[1] != nodes[2]
    df = outlines(spark, [(1, a, 5), (1, a, 5), (2, a.replace("3", "7"), 5), (3, "[", 5)])
    rows = {(r.entity, r.name, r.value, r.occurrences) for r in nested.attribute_rows(nested.bridge_rows(df)).collect()}
    assert rows == {("outline", "count", "4", 4), ("outline", "count", "5", 2), ("destination", "fit", '"XYZ"', 6)}
    records = {r.record_id: (r.node, r.n_top, [(x.name, x.value) for x in r.attributes]) for r in nested.record_rows(df).collect()}
    assert records[1][1:] == (3, [("pagecount", "3")]) and records[2][1:] == (3, [("pagecount", "7")]) and records[1][0] != records[2][0] and len(records) == 2
