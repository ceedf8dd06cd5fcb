"""File sources: feeds, sitemaps, robots files, documentation trees, repository listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def feed_items(spark: SparkSession, path: str, feed: str, guids: bool = False) -> DataFrame:
    """(feed, title, url, posttime) of an RSS file, with ``guids`` also the items' own ids
    (guid); titles are cut to 100 characters."""
    raw = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, guid string, pubDate string").load(path)
    time = F.try_to_timestamp(F.regexp_extract("pubDate", r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    return raw.select(F.lit(feed).alias("feed"), F.left("title", F.lit(100)).alias("title"), F.trim("link").alias("url"), time.alias("posttime"), *[F.trim("guid").alias("guid")][: int(guids)])


def new_items(items: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """Items whose (feed, url) is not known yet, each once. Where several items of a feed share
    a url, ``key`` names the column that tells them apart."""
    return items.dropDuplicates(["feed", key]).join(known.select("feed", key), ["feed", key], "left_anti")


def sitemap_entries(spark: SparkSession, path: str, internal: bool = False) -> DataFrame:
    """(url, priority, lastmod, internal); priority 0 and no date where they are missing."""
    raw = spark.read.format("xml").option("rowTag", "url").schema("loc string, priority double, lastmod string").load(path)
    return raw.select(
        F.trim("loc").alias("url"), F.coalesce("priority", F.lit(0.0)).alias("priority"), F.col("lastmod").try_cast("timestamp").alias("lastmod"), F.lit(internal).alias("internal")
    )


def rules_of(lines: DataFrame, agent: str) -> DataFrame:
    """(file, n, prefix) of the disallow lines that hold for ``agent``, from (file, n, line).
    A rule belongs to the last agent line above it; an empty prefix blocks nothing."""
    low = F.lower("line")
    who = F.when(F.startswith(low, F.lit("user-agent: ")), F.trim(F.substring("line", 13, 1 << 20)))
    above = F.last(who, ignorenulls=True).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    mine = (F.col("agent") == "*") | F.startswith("agent", F.lit(agent))
    rules = lines.withColumn("agent", above).where(F.startswith(low, F.lit("disallow: ")) & mine)
    return rules.select("file", "n", F.trim(F.substring("line", 11, 1 << 20)).alias("prefix")).where("prefix <> ''")


def robots_rules(spark: SparkSession, path: str, agent: str) -> DataFrame:
    """Disallowed prefixes of robots files that hold for ``agent``. Files are read whole, so
    lines keep their order."""
    whole = spark.read.text(path, wholetext=True)
    return rules_of(whole.select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("n", "line")), agent)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 if they start with an XML prolog, else Latin-1."""
    prolog = F.startswith(F.decode(F.substring(content, 1, 5), "ISO-8859-1"), F.lit("<?xml"))
    return F.when(prolog, F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def doc_pages(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """(file, version, title, content) of the .html and .svg files under a folder; a drawing
    has no title and is UTF-8."""
    from millrace.functions.texts import page_title

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{html,svg}").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    drawing = F.endswith(name, F.lit(".svg"))
    text = F.when(drawing, F.decode("content", "UTF-8")).otherwise(decoded(F.col("content")))
    return files.select(name.alias("file"), F.lit(version).cast("decimal(3,1)").alias("version"), text.alias("content"), drawing.alias("drawing")).select(
        "file", "version", F.when(F.col("drawing"), "").otherwise(page_title(F.col("content"))).alias("title"), "content"
    )


def file_tree(spark: SparkSession, folder: str, excluded: tuple[str, ...] = ("old", "timestamp")) -> DataFrame:
    """(parent, name, size, mtime) of the files under a folder without excluded names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    below = F.substring_index("path", folder.rstrip("/") + "/", -1)
    parts = F.split(below, "/")
    keep = ~F.exists(parts, lambda p: p.isin(*excluded) | F.startswith(p, F.lit(".")))
    parent = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    return files.where(keep).select(parent.alias("parent"), F.element_at(parts, -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def repository_platforms(names: DataFrame) -> DataFrame:
    """(platform, arches) from folder names (column ``name``) like ``redhat-9-x86_64`` and the
    versions found in them (column ``versions``)."""
    part = lambda n: F.regexp_extract("name", r"^(\w+)-(\d+)-(\w+)$", n)
    rows = names.where(part(1) != "").select(F.concat_ws("-", part(1), part(2)).alias("platform"), part(3).alias("arch"), "versions")
    return rows.groupBy("platform").agg(F.array_sort(F.collect_list(F.struct("arch", "versions"))).alias("arches"))


def json_in_script(scripts: Column, variable: str, schema: str) -> Column:
    """The JSON value that a script assigns to a variable."""
    return F.from_json(F.regexp_extract(scripts, rf"(?s)var\s+{variable}\s*=\s*(\{{.*?\}}|\[.*?\])\s*;", 1), schema)


def nested_features(spark: SparkSession, path: str) -> DataFrame:
    """(grp, feature, version, state) from a JSON file of groups, features and version maps."""
    raw = spark.read.schema("grp string, features array<struct<name: string, versions: map<string,string>>>").json(path, multiLine=True)
    f = raw.select("grp", F.explode("features").alias("f"))
    return f.select("grp", F.col("f.name").alias("feature"), F.explode("f.versions").alias("version", "state"))


def synonyms(spark: SparkSession, path: str) -> dict[str, str]:
    """A synonym file: a word and what it stands for on each line. Meant for short files."""
    pairs = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") == 2)
    return {r[0]: r[1] for r in pairs.select(F.lower(F.col("p")[0]), F.lower(F.col("p")[1])).collect()}


def staged_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a semicolon-separated load file."""
    return spark.read.schema(schema).csv(path, sep=";", quote='"', escape='"', multiLine=True)


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """(model, pk, field, value) of fixture files: JSON lists of rows with a model, a key and
    fields. A row without a key has a null one; null fields stay; values are texts. A file is
    read whole, once, by one task."""
    rows = F.from_json("value", "array<struct<model: string, pk: string, fields: map<string,string>>>")
    raw = spark.read.text(path, wholetext=True).select(F.explode_outer(rows).alias("r")).select("r.model", "r.pk", "r.fields")
    return raw.select("model", "pk", F.explode_outer("fields").alias("field", "value"))


def fixture_rows(rows: DataFrame, model: str, schema: str) -> DataFrame:
    """The rows of one model as a table: ``pk`` and the schema's columns, cast to their types.
    Fields that a row lacks are null, fields that the schema lacks are left."""
    columns = T.StructType.fromDDL(schema)
    own = rows.where(F.col("model") == model).groupBy("pk").agg(*[F.max(F.when(F.col("field") == c.name, F.col("value"))).cast(c.dataType).alias(c.name) for c in columns])
    return own.select("pk", *columns.names)


def list_info(spark: SparkSession, path: str) -> DataFrame:
    """(groupname, sortkey, listname, shortdesc, active) of a JSON file of groups with lists; a
    list that does not say so is active, a group without lists has no row."""
    raw = spark.read.schema("name string, sortkey int, lists array<struct<name: string, shortdesc: string, active: boolean>>").json(path, multiLine=True)
    each = raw.select(F.col("name").alias("groupname"), "sortkey", F.explode("lists").alias("l"))
    return each.select("groupname", "sortkey", F.col("l.name").alias("listname"), F.col("l.shortdesc").alias("shortdesc"), F.coalesce("l.active", F.lit(True)).alias("active"))


def concatenated(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(content, version): the named files of a folder, one behind another in the order of the
    names, and the newest modification time. Meant for a few short files; a name that the
    folder lacks is an error."""
    files = spark.read.format("binaryFile").load([f"{folder.rstrip('/')}/{n}" for n in names])
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.element_at(F.split("path", "/"), -1))
    parts = files.select(order.alias("n"), F.decode("content", "UTF-8").alias("text"), "modificationTime")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda p: p["text"]), "")
    return parts.agg(whole.alias("content"), F.max("modificationTime").alias("version"))
