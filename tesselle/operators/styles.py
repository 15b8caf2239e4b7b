"""Map styles: themes over base flavours, one document for each theme."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.maps import merged

#: Colours that themes set over their base flavour (flat keys; landcover is nested by a dot).
OVERRIDES = {
    "light": {"water": "rgba(148, 209, 236, 0.66)"},
    "dark": {
        "landcover.grassland": "#1F231F",
        "landcover.barren": "#231F1F",
        "landcover.urban_area": "#1C1C20",
        "landcover.farmland": "#21231D",
        "landcover.glacier": "#1D2123",
        "landcover.scrub": "#1F1F1F",
        "landcover.forest": "#1B211B",
        "water": "#02050F",
    },
    "black": {},
}
#: Icons of each theme, and keys that a theme takes from another base flavour.
ICONS = {"light": "light", "dark": "dark", "black": "dark"}
BORROWED = {"dark": ("black", ("background", "earth"))}
STYLE_VERSION = 8


def themes(spark: SparkSession, flavours: DataFrame) -> DataFrame:
    """theme, colours (map) from flavours (flavour, key, value).

    Icons come first, then the base, then what is borrowed, then overrides; later ones win.
    """
    base = flavours.groupBy("flavour").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("base"))
    rows = [(t, ICONS[t], list(o.items()), BORROWED.get(t, (None, ()))[0], list(BORROWED.get(t, (None, ()))[1])) for t, o in OVERRIDES.items()]
    own = spark.createDataFrame(rows, "theme string, icon string, overrides array<struct<k string, v string>>, lender string, borrowed array<string>")
    lent = base.select(F.col("flavour").alias("lender"), F.col("base").alias("lent"))
    joined = own.join(base, own["theme"] == base["flavour"], "left").join(lent, "lender", "left")
    nothing = F.create_map().cast("map<string,string>")
    borrowed = F.coalesce(F.map_filter("lent", lambda k, v: F.array_contains("borrowed", k)), nothing)
    layers = [F.create_map(F.lit("iconStyle"), F.col("icon")), F.coalesce("base", nothing), borrowed, F.map_from_entries("overrides")]
    return joined.select("theme", merged(*layers).alias("colours"))


def documents(theme_rows: DataFrame, layers: DataFrame, name: str, site: str, tiles_url: str, source: str = "vector") -> DataFrame:
    """theme, style (JSON text) for each theme and the layer list (JSON text) of (theme, layers)."""
    slug = name.lower().replace(" ", "-")
    joined = theme_rows.join(layers, "theme", "left")
    head = F.struct(
        F.lit(STYLE_VERSION).alias("version"),
        F.lit(name).alias("name"),
        F.concat(F.lit(f"{slug}-"), "theme").alias("id"),
        F.create_map(F.lit(source), F.struct(F.lit("vector").alias("type"), F.lit(tiles_url).alias("url"))).alias("sources"),
        F.parse_json(F.coalesce("layers", F.lit("[]"))).alias("layers"),
        F.concat(F.lit(f"{site}/tiles/sprites/v2/"), F.col("colours")["iconStyle"]).alias("sprite"),
        F.lit(f"{site}/tiles/fonts/{{fontstack}}/{{range}}.pbf").alias("glyphs"),
    )
    return joined.select("theme", F.to_json(head, {"pretty": "true"}).alias("style"))


def write(styles: DataFrame, path: str) -> None:
    """One text file below theme=<theme>/ for each style."""
    styles.select("theme", F.col("style").alias("value")).repartition("theme").write.mode("overwrite").partitionBy("theme").text(path)


def matrix(theme_rows: DataFrame, template: DataFrame) -> DataFrame:
    """Every theme with every row of a template."""
    return template.withColumn("_all", F.lit(1)).join(theme_rows.withColumn("_all", F.lit(1)), "_all").drop("_all")
