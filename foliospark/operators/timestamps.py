"""Mixed date notations to one UTC instant, inside the JVM.

All notations are compiled into one regular expression: an alternation with
named groups.  One ``regexp_replace`` per value pulls every component out at
once, the calendar ranges are checked, and the instant is assembled by integer
day arithmetic; nothing leaves whole-stage code generation.

Defined results: NULL stays NULL; an empty, unreadable or impossible value, and
a local time that occurred twice or never in its zone, has no instant.  Missing
smaller parts take their lowest value.  A value without zone is local time of
the given zone, an abbreviation is looked up among those of that zone, and
two-digit years are 20xx.  A missing or unknown zone leaves only values with an
explicit offset resolvable.
"""

from __future__ import annotations

import functools
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names as written in the languages of the collections.
MONTHS = {
    1: "jan january januar janvier enero gennaio janeiro января jänner janv ene genn gen",
    2: "feb february februar février fevrier febrero febbraio fevereiro февраля févr febr fev",
    3: "mar march märz maerz mars marzo março marco марта mär mrz",
    4: "apr april avril abril aprile апреля avr abr",
    5: "may mai mayo maggio maio мая mag",
    6: "jun june juni juin junio giugno junho июня giu",
    7: "jul july juli juillet julio luglio julho июля juil lug",
    8: "aug august août aout agosto августа ago",
    9: "sep sept september septembre septiembre settembre setembro сентября set",
    10: "oct october oktober octobre octubre ottobre outubro октября okt ott out",
    11: "nov november novembre noviembre novembro ноября",
    12: "dec december dezember décembre decembre diciembre dicembre dezembro декабря dez déc dic",
}

ZONE = r"Z(?:00'?00'?)?|[+-]\d\d(?:'\d\d'?|:?\d\d)?'?|(?:UTC|GMT)[+-]\d\d?(?::?\d\d)?|[A-Za-z]{1,5}"
OFFSET = r"Z(?:00'?00'?)?|[+-]\d\d(?:'\d\d'?|:?\d\d)?'?"
CLOCK = r"(?<h>\d{1,2}):(?<mi>\d\d)(?::(?<s>\d\d)(?:[.,]\d+)?)?"
NAME = r"\p{L}{3,}"

#: One pattern per notation; the names of groups get the pattern's number when compiled.
NOTATIONS = [
    # D:YYYYMMDDHHmmSS with any smaller parts missing, then an offset
    rf"D:(?<y>\d{{4}})(?:(?<mo>\d\d)(?:(?<d>\d\d)(?:(?<h>\d\d)(?:(?<mi>\d\d)(?<s>\d\d)?)?)?)?)?(?<z>{OFFSET})?",
    # the same without prefix, from minutes on (ten and thirteen digits are epochs)
    rf"(?<y>\d{{4}})(?<mo>\d\d)(?<d>\d\d)(?<h>\d\d)(?<mi>\d\d)(?<s>\d\d)?(?<z>{OFFSET})?",
    rf"(?<y>\d{{4}})(?<mo>\d\d)(?<d>\d\d)(?:T(?<h>\d\d)(?::?(?<mi>\d\d)(?::?(?<s>\d\d)(?:[.,]\d+)?)?)?(?<z>{OFFSET})?)?",
    rf"(?<y>\d{{4}})(?<sep>[-/.])(?<mo>\d{{1,2}})(?:\k<sep>(?<d>\d{{1,2}})(?:(?:T|t| +){CLOCK} ?(?<z>{ZONE})?)?)?",
    rf"(?:\p{{L}}{{2,}}\.?,? +)?(?<d>\d{{1,2}})(?:\.|er|º|st|nd|rd|th)?[ -](?:de )?(?<mn>{NAME})\.?[ -](?:de )?(?<y>\d{{4}})"
    rf"(?:,? +(?:(?:à|at|um|a las|alle) +)?(?<h>\d{{1,2}})(?::|h)(?<mi>\d\d)(?::(?<s>\d\d)(?:[.,]\d+)?)?(?: Uhr)?(?: (?<ap>[AaPp][Mm]))?(?: (?<z>{ZONE}))?)?",
    rf"\p{{L}}{{3}},? +(?<mn>{NAME}) +(?<d>\d{{1,2}}) +{CLOCK} +(?:(?<z>{ZONE}) +)?(?<y>\d{{4}})",
    r"(?<es>\d{9,10})",
    r"(?<em>\d{13})",
    rf"(?<a>\d{{1,2}})(?<sep>[./-])(?<b>\d{{1,2}})\k<sep>(?<y>\d{{4}}|\d\d)(?:,? +{CLOCK}(?: ?(?<ap>[AaPp][Mm]))?(?: (?<z>{ZONE}))?)?",
    rf"(?<mn>{NAME})\.? (?<d>\d{{1,2}})(?:st|nd|rd|th)?,? (?<y>\d{{4}})(?:,? +(?:at )?{CLOCK}(?: ?(?<ap>[AaPp][Mm]))?(?: (?<z>{ZONE}))?)?",
]
PARTS = ("y", "mo", "mn", "d", "a", "b", "h", "mi", "s", "ap", "z", "es", "em")
SEP = "\x1f"


@functools.cache
def compiled() -> tuple[str, str]:
    """(pattern, replacement): the alternation, and all parts in the order of PARTS."""
    import re

    arms, groups = [], {p: [] for p in PARTS}
    for k, arm in enumerate(NOTATIONS):
        names = dict.fromkeys(re.findall(r"\(\?<([a-z]+)>", arm))
        arms.append(re.sub(r"(\(\?|\\k)<([a-z]+)>", rf"\1<\g<2>{k}>", arm))
        for n in names:
            if n in groups:
                groups[n].append(f"${{{n}{k}}}")
    return rf"^\s*(?:{'|'.join(arms)})\s*$", SEP.join("".join(groups[p]) for p in PARTS)


@functools.cache
def zone_abbreviations() -> list[tuple[str, dict[str, int]]]:
    """(zone, abbreviation -> offset in seconds) of every zone since 1995.

    Bounded by the zone database (about 600 zones).  Where one abbreviation had
    several offsets the latest holds.
    """
    out = []
    for name in sorted(available_timezones()):
        if name in ("localtime", "Factory", "posixrules") or name.startswith(("posix/", "right/")):
            continue
        zone, seen = ZoneInfo(name), {"UTC": 0, "GMT": 0, "Z": 0, "UT": 0}
        for year in range(1995, 2036):
            for month in (1, 4, 7, 10):
                local = datetime(year, month, 15, tzinfo=timezone.utc).astimezone(zone)
                if (abbreviation := local.tzname()) and abbreviation.isalpha():
                    seen[abbreviation.upper()] = int(local.utcoffset() / timedelta(seconds=1))
        out.append((name, seen))
    return out


def zone_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(zone_abbreviations(), "zone string, abbreviations map<string,int>")


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar, integers only."""
    y = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(y / F.lit(400))
    yoe = y - era * 400
    doy = F.floor((F.lit(153) * (m + F.when(m > 2, -3).otherwise(9)) + 2) / F.lit(5)) + d - 1
    doe = yoe * 365 + F.floor(yoe / F.lit(4)) - F.floor(yoe / F.lit(100)) + doy
    return (era * 146097 + doe - 719468).cast("bigint")


def utc_text(seconds: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of epoch seconds, whatever the session's zone."""
    days = F.floor(seconds / F.lit(86400)).cast("int")
    rest = F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(days).cast("string"), F.lit(" "), two(rest / 3600), F.lit(":"), two(F.pmod(rest, F.lit(3600)) / 60), F.lit(":"), two(F.pmod(rest, F.lit(60))))


def _offset_at(seconds: Column, zone: Column) -> Column:
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone)) - seconds


def with_instant(df: DataFrame, value: str, zone: str, day_first: Column, out: str = "epoch_s") -> DataFrame:
    """Add ``out`` BIGINT: epoch seconds of the instant that ``value`` names, or NULL."""
    t = "__ts_"
    pattern, replacement = compiled()
    zones = zone_table(df.sparkSession).select(F.col("zone").alias(t + "zone"), F.col("abbreviations").alias(t + "abbr"))
    raw = F.split(F.regexp_replace(F.col(value), pattern, replacement), SEP, -1)
    df = df.join(F.broadcast(zones), F.col(zone) == F.col(t + "zone"), "left").withColumn(t + "p", raw)
    part = {p: F.when(F.size(t + "p") == len(PARTS), F.nullif(F.get(t + "p", F.lit(i)), F.lit(""))) for i, p in enumerate(PARTS)}
    number = {p: F.try_to_number(part[p], F.lit("9999999999999")).cast("bigint") for p in ("y", "mo", "d", "a", "b", "h", "mi", "s", "es", "em")}
    months = F.create_map(*(F.lit(x) for m, names in MONTHS.items() for n in names.split() for x in (n, m)))
    named = F.try_element_at(months, F.lower(part["mn"])).cast("bigint")
    year = F.when(F.length(part["y"]) == 2, number["y"] + 2000).otherwise(number["y"])
    numeric = part["a"].isNotNull()
    month = F.when(numeric, F.when(day_first, number["b"]).otherwise(number["a"])).when(part["mn"].isNotNull(), named).otherwise(F.coalesce(number["mo"], F.when(part["y"].isNotNull(), 1)))
    day = F.when(numeric, F.when(day_first, number["a"]).otherwise(number["b"])).otherwise(F.coalesce(number["d"], F.when(part["y"].isNotNull(), 1)))
    half = F.lower(part["ap"])
    df = df.withColumns({t + "y": year, t + "m": month, t + "d": day, t + "h": F.coalesce(number["h"], F.lit(0)), t + "mi": F.coalesce(number["mi"], F.lit(0)), t + "s": F.coalesce(number["s"], F.lit(0)), t + "half": half, t + "z": F.upper(part["z"]), t + "e": F.coalesce(number["es"], F.floor(number["em"] / F.lit(1000)))})
    y, m, d, h, mi, s, z = (F.col(t + k) for k in ("y", "m", "d", "h", "mi", "s", "z"))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    hour_ok = F.when(F.col(t + "half").isNull(), h <= 23).otherwise((h >= 1) & (h <= 12))
    valid = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= last) & hour_ok & (mi <= 59) & (s <= 59)
    hour = F.when(F.col(t + "half") == "pm", h % 12 + 12).when(F.col(t + "half") == "am", h % 12).otherwise(h)
    local = F.when(valid, days_from_civil(y, m, d) * 86400 + hour * 3600 + mi * 60 + s)
    signed = F.regexp_extract(z, r"^(?:UTC|GMT)?([+-])", 1)
    digits = F.regexp_replace(z, r"[^0-9]", "")
    oh, om = F.substring(digits, 1, 2).cast("int"), F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).cast("int"), F.lit(0))
    offset = (
        F.when(z.rlike(r"^Z(00'?00'?)?$"), F.lit(0))
        .when(signed != "", F.when((oh <= 18) & (om <= 59), F.when(signed == "-", -1).otherwise(1) * (oh * 3600 + om * 60)))
        .otherwise(F.coalesce(F.try_element_at(F.col(t + "abbr"), z), F.when(z.isin("UTC", "GMT", "UT"), 0)))
    )
    df = df.withColumns({t + "l": local, t + "o": offset.cast("bigint")})
    known = F.when(z.isNull(), F.col(t + "zone"))
    # Two offsets in force around the local time; each gives a candidate that must map back.
    df = df.withColumns({t + "o1": _offset_at(F.col(t + "l") - 86400, known), t + "o2": _offset_at(F.col(t + "l") + 86400, known)})
    u1, u2 = F.col(t + "l") - F.col(t + "o1"), F.col(t + "l") - F.col(t + "o2")
    ok1, ok2 = _offset_at(u1, known) == F.col(t + "o1"), _offset_at(u2, known) == F.col(t + "o2")
    wall = F.when(F.col(t + "o1") == F.col(t + "o2"), F.when(ok1, u1)).when(ok1 & ~ok2, u1).when(ok2 & ~ok1, u2)
    instant = F.when(F.col(t + "e").isNotNull(), F.col(t + "e")).when(z.isNotNull(), F.col(t + "l") - F.col(t + "o")).otherwise(wall)
    df = df.withColumn(out, instant.cast("bigint"))
    return df.drop(*(c for c in df.columns if c.startswith(t)))


def normalise_dates(metadata: DataFrame, collections: DataFrame, columns: tuple[str, ...] = ("creation_date", "modified_date"), key: str = "doc_id") -> DataFrame:
    """(doc_id, field, raw, epoch_s, utc): each raw date once, ``unresolved`` where it has no instant.

    A document delivered again counts once, by its latest delivery.  Documents
    without a known collection keep only values with an explicit offset.
    """
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("raw")) for c in columns))
    order = [F.col("ingested_at")] if "ingested_at" in metadata.columns else []
    latest = F.max(F.struct(*order, F.col("collection").alias("c"), fields.alias("v"))).alias("r")
    docs = metadata.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("doc_id")).agg(latest)
    rows = docs.select("doc_id", F.col("r.c").alias("collection"), F.explode("r.v").alias("v")).where(F.col("v.raw").isNotNull())
    rows = rows.select("doc_id", "collection", "v.field", "v.raw")
    known = collections.where(F.col("collection").isNotNull()).groupBy("collection").agg(F.min(F.struct("tz", "date_order")).alias("c"))
    known = known.select("collection", F.col("c.tz").alias("tz"), F.col("c.date_order").alias("date_order"))
    rows = rows.join(known, "collection", "left")
    rows = with_instant(rows, "raw", "tz", F.coalesce(F.col("date_order"), F.lit("DMY")) != "MDY")
    return rows.select("doc_id", "field", "raw", "epoch_s", F.coalesce(utc_text(F.col("epoch_s")), F.lit("unresolved")).alias("utc"))
