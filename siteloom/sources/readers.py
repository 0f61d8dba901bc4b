"""Readers for the sources a screening run takes in, each with a declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAST_SCHEMA = "name string, state string, lat string, lon string, height string, commissioned string, complete string"
GEOMETRY = "struct<type: string, coordinates: string>"
FEATURE = f"struct<type: string, properties: map<string, string>, geometry: {GEOMETRY}>"


def day_month_year(raw: Column) -> Column:
    """A date from d/m/y text; two-digit years up to 30 are of this century. Impossible dates are null."""
    part = lambda i: F.regexp_extract(F.trim(raw), r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})$", i).try_cast("int")
    year = F.when(part(3) >= 100, part(3)).when(part(3) <= 30, part(3) + 2000).otherwise(part(3) + 1900)
    return F.format_string("%04d-%02d-%02d", year, part(2), part(1)).try_cast("date")


def yes_no(raw: Column) -> Column:
    word = F.lower(F.trim(raw))
    return F.when(word.isin("yes", "y", "true", "1"), True).when(word.isin("no", "n", "false", "0"), False)


def read_masts(spark: SparkSession, path: str) -> DataFrame:
    """Masts from CSV with a header; rows without a finite position are dropped."""
    raw = spark.read.csv(path, schema=MAST_SCHEMA, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    number = lambda c: F.col(c).try_cast("double")
    rows = raw.select("name", "state", number("lat").alias("lat"), number("lon").alias("lon"), number("height").alias("height"), day_month_year(F.col("commissioned")).alias("commissioned"), yes_no(F.col("complete")).alias("complete"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.where(finite("lat") & finite("lon"))


def read_feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """properties and geometry of each feature of GeoJSON files; coordinates stay JSON text."""
    files = spark.read.text(path, wholetext=True)
    features = F.from_json("value", f"struct<features: array<{FEATURE}>>")["features"]
    return files.select(F.explode(features).alias("f")).select("f.properties", "f.geometry")


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features from one-a-line files; brackets, trailing commas and record separators are let pass.

    ``skipped`` marks lines that hold no feature, so a caller can count them.
    """
    line = F.trim(F.regexp_replace("value", "\\x1e", ""))
    line = F.regexp_replace(line, ",$", "")
    rows = spark.read.text(path).select(line.alias("line")).where(~F.col("line").isin("", "[", "]"))
    parsed = rows.select(F.from_json("line", FEATURE, {"mode": "PERMISSIVE"}).alias("f"))
    return parsed.select("f.properties", "f.geometry", (F.col("f.geometry.type").isNull()).alias("skipped"))


def points(features: DataFrame) -> DataFrame:
    """lon and lat of the point features, besides their properties."""
    at = F.from_json("geometry.coordinates", "array<double>")
    return features.where("geometry.type = 'Point'").select("properties", F.get(at, F.lit(0)).alias("lon"), F.get(at, F.lit(1)).alias("lat"))


def first_property(properties: Column, *names: str) -> Column:
    """The first non-blank value under any of the names, in lower case."""
    lowered = F.map_from_entries(F.transform(F.map_entries(properties), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    return F.coalesce(*[F.lower(F.nullif(F.trim(F.element_at(lowered, F.lit(n))), F.lit(""))) for n in names], F.lit(""))


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    """site, ts, speed and direction from archives of parallel arrays; arrays of unequal length are an error."""
    schema = "site string, hourly struct<time: array<string>, speed: array<double>, direction: array<double>>"
    rows = spark.read.json(path, schema=schema, multiLine=True)
    even = (F.size("hourly.time") == F.size("hourly.speed")) & (F.size("hourly.time") == F.size("hourly.direction"))
    checked = rows.where(F.when(even, True).otherwise(F.raise_error(F.concat(F.lit("arrays of unequal length at "), "site")).cast("boolean")))
    each = checked.select("site", F.explode(F.arrays_zip("hourly.time", "hourly.speed", "hourly.direction")).alias("h"))
    return each.select("site", F.col("h.time").cast("timestamp_ntz").alias("ts"), "h.speed", "h.direction")


def rss_items(text: DataFrame, column: str = "value") -> DataFrame:
    """title, link, published and summary (300 characters at most) of the items in feed text."""
    tag = lambda n: F.regexp_replace(F.regexp_extract("item", rf"(?s)<{n}[^>]*>(.*?)</{n}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
    items = text.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<item[^>]*>(.*?)</item>"), F.lit(1))).alias("item"))
    link = F.coalesce(F.nullif(F.trim(tag("link")), F.lit("")), F.trim(tag("guid")))
    return items.select(F.trim(tag("title")).alias("title"), link.alias("link"), tag("pubDate").alias("published"), F.substring(F.trim(F.regexp_replace(tag("description"), "<[^>]*>", "")), 1, 300).alias("summary"))


def grid_cells(spark: SparkSession, west: float, south: float, east: float, north: float, degrees: float) -> DataFrame:
    """The cells that tile a box, the last of each row and column clipped to it."""
    steps = lambda low, high: int(-(-(high - low) // degrees))
    nx, ny = steps(west, east), steps(south, north)
    cell = spark.range(nx * ny).select(F.pmod("id", F.lit(nx)).alias("i"), F.floor(F.col("id") / nx).alias("j"))
    return cell.select((F.lit(west) + F.col("i") * degrees).alias("west"), (F.lit(south) + F.col("j") * degrees).alias("south"), F.least(F.lit(east), F.lit(west) + (F.col("i") + 1) * degrees).alias("east"), F.least(F.lit(north), F.lit(south) + (F.col("j") + 1) * degrees).alias("north"))


def table_cells(html: Column) -> Column:
    """The rows of the tables in a page, each an array of its cells' text; comments are taken out first."""
    plain = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    rows = F.regexp_extract_all(plain, F.lit(r"(?si)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " "))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?si)<td[^>]*>(.*?)</td>"), F.lit(1)), text))


def tenders(pages: DataFrame, html: str = "html") -> DataFrame:
    """Tender rows of listing pages: title, megawatts, category.

    A row counts if it has six cells or more; its title is the longest cell
    over 30 characters, and only titles about wind or hybrids are kept.
    """
    cells = pages.select(F.explode(table_cells(F.col(html))).alias("cells")).where(F.size("cells") >= 6)
    title = F.aggregate(F.filter("cells", lambda c: F.length(c) > 30), F.lit(""), lambda a, c: F.when(F.length(c) > F.length(a), c).otherwise(a))
    rows = cells.select(title.alias("title")).withColumn("low", F.lower("title")).where(F.col("low").rlike(r"\bwind\b|\b(hybrid|fdre|rtc|round[- ]the[- ]clock)\b"))
    megawatts = F.regexp_replace(F.regexp_extract("title", r"(?i)(\d[\d,]*)\s*MW", 1), ",", "").try_cast("int")
    kinds = [("offshore", "offshore"), ("repower", "repowering"), ("fdre", "fdre"), ("rtc|round[- ]the[- ]clock", "rtc"), ("hybrid", "hybrid")]
    category = F.lit("wind")
    for pattern, name in reversed(kinds):
        category = F.when(F.col("low").rlike(pattern), name).otherwise(category)
    return rows.select("title", F.coalesce(megawatts, F.lit(0)).alias("mw"), category.alias("category"))


def kml_rings(files: DataFrame, column: str = "value") -> DataFrame:
    """(name, ring): the coordinate lists of the placemarks in KML text, as arrays of (x, y)."""
    marks = files.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<Placemark[^>]*>(.*?)</Placemark>"), F.lit(1))).alias("mark"))
    lists = marks.select(F.trim(F.regexp_extract("mark", r"(?s)<name>(.*?)</name>", 1)).alias("name"), F.explode(F.regexp_extract_all("mark", F.lit(r"(?s)<coordinates>(.*?)</coordinates>"), F.lit(1))).alias("c"))
    points = F.transform(F.filter(F.split(F.trim("c"), r"\s+"), lambda p: p != ""), lambda p: F.split(p, ","))
    ring = F.transform(points, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y")))
    return lists.select("name", F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull()).alias("ring"))


def state_capacity(text: Column, states: list[str]) -> Column:
    """The second number of each state's line in a report's text, as a map; lines with under two numbers are let pass."""
    lines = F.split(text, "\\r?\\n")
    entry = lambda s: F.struct(F.lit(s).alias("state"), F.get(F.transform(F.regexp_extract_all(F.get(F.filter(lines, lambda x: F.trim(x).startswith(s)), F.lit(0)), F.lit(r"(\d[\d,]*\.?\d*)"), F.lit(1)), lambda n: F.regexp_replace(n, ",", "").try_cast("double")), F.lit(1)).alias("mw"))
    return F.map_from_entries(F.filter(F.array(*[entry(s) for s in states]), lambda e: e["mw"].isNotNull()))
