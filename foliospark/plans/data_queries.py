"""Queries of the general data problems (nested records, dates)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.operators import nested, timestamps
from foliospark.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.bridge_rows(table(spark, sf_dir, "pdf_outlines")).select("record_id", "entity", "path", "parent_path")


def p3_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.object_rows(nested.bridge_rows(table(spark, sf_dir, "pdf_outlines")))


def p3_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.edge_rows(nested.bridge_rows(table(spark, sf_dir, "pdf_outlines")))


def p3_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    bridge = nested.bridge_rows(table(spark, sf_dir, "pdf_outlines"))
    return bridge.select("record_id", "entity", "path", "parent_path", "depth", "ordinal", "node", "parent_node")


def p3_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.attribute_rows(nested.bridge_rows(table(spark, sf_dir, "pdf_outlines")))


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.record_rows(table(spark, sf_dir, "pdf_outlines"))


def p3_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.payload_status(table(spark, sf_dir, "pdf_outlines"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = timestamps.normalise_dates(table(spark, sf_dir, "pdf_metadata"), table(spark, sf_dir, "pdf_collections"))
    return dates.select("doc_id", "field", "utc")


QUERIES = {"p3_found": p3_found, "p3_bridge": p3_bridge, "p3_objects": p3_objects, "p3_edges": p3_edges, "p3_attributes": p3_attributes, "p3_records": p3_records, "p3_status": p3_status, "p6_found": p6_found}

# Trees by recursion over what is still to be opened: wrappers, lists (or what stands for one), bookmarks.
_KEY = "list_filter(json_keys(j), lambda k: lower(k) IN ({names}) AND json_type(json_extract(j, '/' || k)) <> 'NULL')[1]"
_ROOT, _KIDS, _DEST = (_KEY.format(names=names) for names in ("'outlines', 'outline', 'bookmarks'", "'children', 'kids'", "'destination', 'dest'"))
_TREES = f"""
WITH RECURSIVE r AS (SELECT record_id, min(payload) AS p FROM pdf_outlines WHERE record_id IS NOT NULL GROUP BY 1),
node(record_id, path, parent_path, kind, j) AS (
  SELECT record_id, '', '', CASE WHEN json_valid(p) THEN 'top' ELSE 'bad' END, CASE WHEN json_valid(p) THEN p::JSON END FROM r WHERE trim(p) <> ''
  UNION ALL
  SELECT record_id, e.path, e.parent_path, e.kind, e.j FROM (
    SELECT record_id, unnest(CASE
      WHEN kind IN ('top', 'kids') AND json_type(j) = 'VARCHAR' THEN
        CASE WHEN trim(j->>'$') = '' THEN [] WHEN json_valid(j->>'$') THEN [{{'path': path, 'parent_path': '', 'kind': kind, 'j': (j->>'$')::JSON}}] ELSE [{{'path': path, 'parent_path': '', 'kind': 'bad', 'j': NULL}}] END
      WHEN kind = 'top' AND json_type(j) = 'OBJECT' AND {_ROOT} IS NOT NULL THEN [{{'path': '', 'parent_path': '', 'kind': 'top', 'j': json_extract(j, '/' || {_ROOT})}}]
      WHEN kind = 'top' AND json_type(j) = 'OBJECT' AND len(list_filter(json_keys(j), lambda k: lower(k) IN ('outlines', 'outline', 'bookmarks'))) > 0 THEN []
      WHEN kind = 'top' AND json_type(j) = 'OBJECT' AND len(list_filter(json_keys(j), lambda k: lower(k) IN ('title', 'destination', 'dest', 'children', 'kids') OR regexp_full_match(k, '[0-9]+'))) = 0 THEN
        list_transform(list_filter(json_keys(j), lambda k: json_type(json_extract(j, '/' || k)) = 'OBJECT')[1:1], lambda k: {{'path': '', 'parent_path': '', 'kind': 'top', 'j': json_extract(j, '/' || k)}})
      WHEN kind = 'top' THEN [{{'path': '', 'parent_path': '', 'kind': 'kids', 'j': j}}]
      WHEN kind = 'kids' THEN list_transform(range(len(xs)), lambda i: {{'path': CASE WHEN path = '' THEN '' ELSE path || '.' END || i, 'parent_path': path, 'kind': 'item', 'j': xs[i + 1]}})
      WHEN kind = 'item' AND {_KIDS} IS NOT NULL THEN [{{'path': path, 'parent_path': '', 'kind': 'kids', 'j': json_extract(j, '/' || {_KIDS})}}]
      ELSE [] END) AS e
    FROM (SELECT *, list_filter(CASE
        WHEN kind <> 'kids' THEN [] WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') WHEN json_type(j) <> 'OBJECT' OR len(json_keys(j)) = 0 THEN []
        WHEN len(list_filter(json_keys(j), lambda k: NOT regexp_full_match(k, '[0-9]+'))) = 0 THEN list_transform(list_sort(list_transform(json_keys(j), lambda k: k::BIGINT)), lambda k: json_extract(j, '/' || k))
        ELSE [j] END, lambda x: json_type(x) = 'OBJECT') AS xs FROM node)
  )
),
bad AS (SELECT DISTINCT record_id FROM node WHERE kind = 'bad'),
item AS (SELECT * FROM node WHERE kind = 'item' AND record_id NOT IN (SELECT record_id FROM bad)),
place AS (SELECT record_id, path, CASE WHEN json_type(d) = 'VARCHAR' AND regexp_matches(trim(d->>'$'), '^[{{\\[]') AND json_valid(d->>'$') THEN (d->>'$')::JSON ELSE d END AS d
          FROM (SELECT record_id, path, json_extract(j, '/' || {_DEST}) AS d FROM item)),
named AS (SELECT record_id, path,
            CASE json_type(d) WHEN 'VARCHAR' THEN d->>'$' WHEN 'OBJECT' THEN json_extract_string(d, '/' || list_filter(json_keys(d), lambda k: lower(k) = 'name')[1])
              WHEN 'ARRAY' THEN CASE WHEN json_type(d->0) = 'VARCHAR' AND try_cast(d->>0 AS DOUBLE) IS NULL THEN d->>0 END END AS name,
            try_cast(CASE json_type(d) WHEN 'OBJECT' THEN json_extract_string(d, '/' || list_filter(json_keys(d), lambda k: lower(k) = 'page')[1]) WHEN 'ARRAY' THEN d->>0 WHEN 'VARCHAR' THEN NULL ELSE d->>'$' END AS DOUBLE) AS page
          FROM place WHERE d IS NOT NULL)
"""

SQL = {
    "p3_found": _TREES + "SELECT record_id, 'outline' AS entity, path, parent_path FROM item UNION ALL SELECT record_id, 'destination', path, path FROM named WHERE trim(coalesce(name, '')) <> '' OR page >= 1",
    "p3_status": _TREES
    + """SELECT r.record_id, r.p IS NOT NULL AND trim(r.p) <> '' AND r.record_id NOT IN (SELECT record_id FROM bad) AS readable,
       coalesce(i.n, 0)::INTEGER AS n_outlines, coalesce(d.n, 0)::INTEGER AS n_destinations
FROM r LEFT JOIN (SELECT record_id, count(*) AS n FROM item GROUP BY 1) i USING (record_id)
       LEFT JOIN (SELECT record_id, count(*) AS n FROM named WHERE trim(coalesce(name, '')) <> '' OR page >= 1 GROUP BY 1) d USING (record_id)""",
}

# Dates: one expression for each notation gives the local parts, then the zone's offset by trial of the two in force around.
_CLOCK = r"(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,]\d+)?)?"
_ZONE = r"(Z(?:00'?00'?)?|[+-]\d\d(?:'\d\d'?|:?\d\d)?'?|(?:UTC|GMT)[+-]\d\d?(?::?\d\d)?|[A-Za-z]{1,5})"
_OFF = r"(Z(?:00'?00'?)?|[+-]\d\d(?:'\d\d'?|:?\d\d)?'?)"
#: Pattern, and the numbers of its groups for y mo mn d a b h mi s ap z es em (0: none).
_DATES = (
    (rf"D:(\d{{4}})(?:(\d\d)(?:(\d\d)(?:(\d\d)(?:(\d\d)(\d\d)?)?)?)?)?{_OFF}?", "1 2 0 3 0 0 4 5 6 0 7 0 0"),
    (rf"(\d{{4}})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)?{_OFF}?", "1 2 0 3 0 0 4 5 6 0 7 0 0"),
    (rf"(\d{{4}})(\d\d)(\d\d)(?:T(\d\d)(?::?(\d\d)(?::?(\d\d)(?:[.,]\d+)?)?)?{_OFF}?)?", "1 2 0 3 0 0 4 5 6 0 7 0 0"),
    *((rf"(\d{{4}}){sep}(\d{{1,2}})(?:{sep}(\d{{1,2}})(?:(?:T|t| +){_CLOCK} ?{_ZONE}?)?)?", "1 2 0 3 0 0 4 5 6 0 7 0 0") for sep in ("-", "/", r"\.")),
    (rf"(?:\p{{L}}{{2,}}\.?,? +)?(\d{{1,2}})(?:\.|er|º|st|nd|rd|th)?[ -](?:de )?(\p{{L}}{{3,}})\.?[ -](?:de )?(\d{{4}})(?:,? +(?:(?:à|at|um|a las|alle) +)?(\d{{1,2}})(?::|h)(\d\d)(?::(\d\d)(?:[.,]\d+)?)?(?: Uhr)?(?: ([AaPp][Mm]))?(?: {_ZONE})?)?", "3 0 2 1 0 0 4 5 6 7 8 0 0"),
    (rf"\p{{L}}{{3}},? +(\p{{L}}{{3,}}) +(\d{{1,2}}) +{_CLOCK} +(?:{_ZONE} +)?(\d{{4}})", "7 0 1 2 0 0 3 4 5 0 6 0 0"),
    (r"(\d{9,10})", "0 0 0 0 0 0 0 0 0 0 0 1 0"),
    (r"(\d{13})", "0 0 0 0 0 0 0 0 0 0 0 0 1"),
    *((rf"(\d{{1,2}}){sep}(\d{{1,2}}){sep}(\d{{4}}|\d\d)(?:,? +{_CLOCK}(?: ?([AaPp][Mm]))?(?: {_ZONE})?)?", "3 0 0 0 1 2 4 5 6 7 8 0 0") for sep in ("-", "/", r"\.")),
    (rf"(\p{{L}}{{3,}})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:,? +(?:at )?{_CLOCK}(?: ?([AaPp][Mm]))?(?: {_ZONE})?)?", "3 0 1 2 0 0 4 5 6 7 8 0 0"),
)


def dates_sql() -> str:
    """SQL of p6_found; written out on demand, as it lists the abbreviations of every zone."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    arms = []
    for pattern, groups in _DATES:
        whole = quote(rf"^\s*(?:{pattern})\s*$")
        parts = ", ".join(f"nullif(regexp_extract(raw, {whole}, {g}), '')" if g != "0" else "NULL" for g in groups.split())
        arms.append(f"WHEN regexp_matches(raw, {whole}) THEN [{parts}]")
    months = ", ".join(f"('{n}', {m})" for m, names in timestamps.MONTHS.items() for n in names.split())
    abbreviations = ", ".join(f"({quote(zone)}, {quote(a)}, {o})" for zone, seen in timestamps.zone_abbreviations() for a, o in seen.items())
    offset = lambda at: f"(epoch(timezone(tz, to_timestamp({at}))) - ({at}))"
    return f"""
WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC NULLS LAST, collection DESC NULLS LAST) AS k FROM pdf_metadata) WHERE k = 1),
v AS (SELECT doc_id, collection, 'creation_date' AS field, creation_date AS raw FROM latest UNION ALL SELECT doc_id, collection, 'modified_date', modified_date FROM latest),
r AS (SELECT v.*, tz, date_order FROM v LEFT JOIN pdf_collections USING (collection) WHERE raw IS NOT NULL),
months(name, m) AS (VALUES {months}), abbreviations(zone, abbreviation, seconds) AS (VALUES {abbreviations}),
p AS (SELECT *, CASE {' '.join(arms)} END AS g FROM r),
n AS (SELECT doc_id, field, tz, g[1] IS NOT NULL AS dated, CASE WHEN length(g[1]) = 2 THEN 2000 ELSE 0 END + g[1]::INT AS y,
        CASE WHEN g[5] IS NOT NULL THEN CASE WHEN date_order = 'MDY' THEN g[5]::INT ELSE g[6]::INT END WHEN g[3] IS NOT NULL THEN months.m ELSE coalesce(g[2]::INT, 1) END AS mo,
        CASE WHEN g[5] IS NOT NULL THEN CASE WHEN date_order = 'MDY' THEN g[6]::INT ELSE g[5]::INT END ELSE coalesce(g[4]::INT, 1) END AS d,
        coalesce(g[7]::INT, 0) AS h, coalesce(g[8]::INT, 0) AS mi, coalesce(g[9]::INT, 0) AS s, lower(g[10]) AS ap, upper(g[11]) AS z, coalesce(g[12]::BIGINT, g[13]::BIGINT // 1000) AS given
      FROM p LEFT JOIN months ON months.name = lower(g[3])),
l AS (SELECT *, CASE WHEN mi <= 59 AND s <= 59 AND CASE WHEN ap IS NULL THEN h <= 23 ELSE h BETWEEN 1 AND 12 END
        THEN epoch(try_cast(printf('%04d-%02d-%02d', y, mo, d) AS DATE)) + CASE ap WHEN 'pm' THEN h % 12 + 12 WHEN 'am' THEN h % 12 ELSE h END * 3600 + mi * 60 + s END AS wall,
        regexp_replace(z, '[^0-9]', '', 'g') AS digits, regexp_extract(z, '^(?:UTC|GMT)?([+-])', 1) AS sign FROM n),
o AS (SELECT l.*, CASE WHEN regexp_matches(z, '^Z(00''?00''?)?$') THEN 0
          WHEN sign <> '' THEN CASE WHEN substring(digits, 1, 2)::INT <= 18 AND coalesce(nullif(substring(digits, 3, 2), '')::INT, 0) <= 59 THEN CASE sign WHEN '-' THEN -1 ELSE 1 END * (substring(digits, 1, 2)::INT * 3600 + coalesce(nullif(substring(digits, 3, 2), '')::INT, 0) * 60) END
          ELSE coalesce(seconds, CASE WHEN z IN ('UTC', 'GMT', 'UT') THEN 0 END) END AS stated
      FROM l LEFT JOIN abbreviations ON zone = tz AND abbreviation = z),
w AS (SELECT *, CASE WHEN z IS NULL AND wall IS NOT NULL AND tz IS NOT NULL THEN {offset('wall - 86400')} END AS o1, CASE WHEN z IS NULL AND wall IS NOT NULL AND tz IS NOT NULL THEN {offset('wall + 86400')} END AS o2 FROM o),
c AS (SELECT *, o1 IS NOT NULL AND {offset('wall - coalesce(o1, 0)')} = o1 AS ok1, o2 IS NOT NULL AND {offset('wall - coalesce(o2, 0)')} = o2 AS ok2 FROM w),
e AS (SELECT doc_id, field, CASE WHEN given IS NOT NULL THEN given WHEN z IS NOT NULL THEN wall - stated WHEN o1 = o2 THEN CASE WHEN ok1 THEN wall - o1 END WHEN ok1 AND NOT ok2 THEN wall - o1 WHEN ok2 AND NOT ok1 THEN wall - o2 END AS instant FROM c)
SELECT doc_id, field, coalesce(strftime(timezone('UTC', to_timestamp(instant)), '%Y-%m-%d %H:%M:%S'), 'unresolved') AS utc FROM e"""

