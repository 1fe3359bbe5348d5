"""As-of, interval and address queries (survey ids ADR, JON-01, WIN-01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import addresses
from cairn.operators.asof import asof_join, extents
from cairn.plans.registry import query
from cairn.session import table

WEEK = 7 * 86_400


@query(
    "asof_site_to_function",
    """
    SELECT e.event_id AS event_id, p.event_id AS function_id, p.value AS function_value
    FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
      ON e.user_id = p.user_id AND e.ts >= p.ts
    """,
)
def asof_site_to_function(spark, sf_dir):
    """ADR-10, JON-01, WIN-02: every event with its user's latest purchase at or before it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    starts = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("function_id"), F.col("value").alias("function_value"))
    return asof_join(events.select("user_id", "ts", "event_id"), starts, ["user_id"], "ts", ["function_id", "function_value"], width=WEEK).select("event_id", "function_id", "function_value")


@query(
    "interval_section_lookup",
    """
    WITH s AS (SELECT user_id, event_id AS va, event_id + 1 + CAST(floor(value) AS BIGINT) AS va_end FROM events WHERE event_type = 'purchase'),
         p AS (SELECT user_id, event_id, event_id + 7 AS point FROM events)
    SELECT p.event_id AS event_id, CASE WHEN p.point < s.va_end THEN s.va END AS section
    FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.point >= s.va
    """,
)
def interval_section_lookup(spark, sf_dir):
    """ADR-01, ADR-06: nearest section start at or before the point, then containment."""
    events = table(spark, sf_dir, "events")
    sections = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("va"), (F.col("event_id") + 1 + F.floor("value")).alias("va_end"), F.col("event_id").alias("section"))
    points = events.select("user_id", (F.col("event_id") + 7).alias("point"), "event_id")
    return addresses.locate(points, sections, ["user_id"], "point", "va", "va_end", ["section"]).select("event_id", "section")


@query(
    "function_extents",
    """
    SELECT event_id AS start_va, least(coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), event_id + 500), event_id + 500) AS extent_end
    FROM events
    """,
)
def function_extents(spark, sf_dir):
    """ADR-11, WIN-01: a function ends where the next of its image starts, at most 500 on."""
    starts = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("start_va"))
    return extents(starts, ["user_id"], "start_va", 500).select("start_va", "extent_end")


@query(
    "address_translate",
    """
    WITH s AS (SELECT s_nationkey AS k, s_name AS name, s_suppkey * 1000 AS va, 700 AS vsize, s_suppkey * 500 AS fileoff, 400 AS filesize FROM supplier),
         p AS (SELECT c_custkey AS id, c_nationkey AS k, c_custkey * 37 AS address, c_nationkey * 10 AS base FROM customer),
         f AS (SELECT p.*, s.va AS sva, s.fileoff, s.filesize FROM p ASOF LEFT JOIN s ON p.k = s.k AND p.address >= s.fileoff),
         e AS (SELECT id, k, base, 'va' AS space, address AS va FROM p
               UNION ALL SELECT id, k, base, 'rva', address + base FROM p
               UNION ALL SELECT id, k, base, 'file', CASE WHEN address < fileoff + filesize THEN sva + address - fileoff END FROM f),
         g AS (SELECT e.*, s.name, s.va AS sva, s.fileoff, s.filesize, s.vsize FROM e ASOF LEFT JOIN s ON e.k = s.k AND e.va >= s.va)
    SELECT id, space, CAST(va AS BIGINT) AS va, CAST(va - base AS BIGINT) AS rva,
           CASE WHEN va < sva + greatest(vsize, filesize) THEN name END AS section,
           CAST(CASE WHEN va < sva + greatest(vsize, filesize) AND va - sva < filesize THEN fileoff + va - sva END AS BIGINT) AS file_offset,
           coalesce(va < sva + greatest(vsize, filesize), false) AS mapped
    FROM g
    """,
)
def address_translate(spark, sf_dir):
    """ADR-02..05, ADR-08: three readings of every address; images are nations, sections suppliers."""
    key = F.col("s_suppkey")
    sections = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), (key * 1000).cast(addresses.ADDRESS).alias("va"), F.lit(700).cast("long").alias("vsize"), (key * 500).alias("fileoff"), F.lit(400).cast("long").alias("filesize")
    )
    images = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 10).alias("image_base"))
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"), (F.col("c_custkey") * 37).alias("address"))
    got = addresses.translate(points, sections, images, ["k"])
    return got.select("id", "space", F.col("va").cast("long").alias("va"), F.col("rva").cast("long").alias("rva"), "section", F.col("offset").alias("file_offset"), "mapped")


@query(
    "address_literals",
    """
    SELECT o_orderkey AS id, '0x' || lower(to_hex(o_orderkey * 65521)) AS hex, o_orderkey * 65521 AS from_hex,
           o_orderkey AS from_decimal, o_orderkey * 16 + 10 AS from_bare
    FROM orders
    """,
)
def address_literals(spark, sf_dir):
    """ADR-09: rendering and parsing of address literals, with separators and bare hexadecimal."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(key.alias("id"), addresses.hex_text(key * 65521).alias("hex"), F.concat(F.lower(F.hex(key)), F.lit("a")).alias("bare"), F.concat(F.lit(" "), key.cast("string"), F.lit("_ ")).alias("plain"))
    whole = lambda c: addresses.parse_address(F.col(c)).cast("long")
    return orders.select("id", "hex", whole("hex").alias("from_hex"), whole("plain").alias("from_decimal"), whole("bare").alias("from_bare"))
