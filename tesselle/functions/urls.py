"""Request paths and origins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value, the language of paths. Groups: version, style, json suffix, z, x, y. The dot before ``mvt`` stands for any character.
PATH = r"^/v([0-9]+)(?:/style/(\w+)(?:\.json)?|(\.json)|/(\d+)/(\d+)/(\d+).mvt)?\z"
PATH_DOTTED = PATH.replace(".mvt", r"\.mvt")

#: Origin of a request that names none.
MISSING_ORIGIN = "http://missing.url"

#: Second-level labels that registries keep to themselves below a country's code.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "gv", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")


def path_of(url: Column) -> Column:
    """Path of an absolute URL; the text itself, up to a query or fragment, where there is no scheme."""
    parsed = F.try_parse_url(url, F.lit("PATH"))
    absolute = F.when(parsed == "", F.lit("/")).otherwise(parsed)
    return F.when(url.startswith("/"), F.regexp_extract(url, r"^[^?#]*", 0)).otherwise(absolute)


def parse_request(url: Column, strict_dot: bool = False) -> Column:
    """struct<request_type, version, style, z, x, y>; the numbers stay text, what is missing is null."""
    path = path_of(url)
    group = lambda i: F.nullif(F.regexp_extract(path, PATH_DOTTED if strict_dot else PATH, i), F.lit(""))
    kind = F.when(group(4).isNotNull(), "tile").when(group(2).isNotNull(), "style").when(group(1).isNotNull(), "json")
    return F.struct(kind.alias("request_type"), *(group(i).alias(name) for i, name in ((1, "version"), (2, "style"), (4, "z"), (5, "x"), (6, "y"))))


def protocol(origin: Column) -> Column:
    """Scheme with its colon."""
    return F.concat(F.try_parse_url(F.coalesce(origin, F.lit(MISSING_ORIGIN)), F.lit("PROTOCOL")), F.lit(":"))


def host(origin: Column) -> Column:
    return F.try_parse_url(F.coalesce(origin, F.lit(MISSING_ORIGIN)), F.lit("HOST"))


def apex_domain(origin: Column, second_level: tuple[str, ...] = SECOND_LEVEL) -> Column:
    """Registrable domain of an origin; the host itself where it has one label or is an address.

    A suffix has one label, or two where the last is a country's code of two letters and the one
    before it is among ``second_level``.
    """
    name = F.lower(host(origin))
    two = rf"(?:{'|'.join(second_level)})\.[a-z]{{2}}"
    found = F.regexp_extract(name, r"([^.]+\.[^.]+)\z", 1)
    deep = F.regexp_extract(name, rf"([^.]+\.{two})\z", 1)
    best = F.when(deep != "", deep).otherwise(found)
    return F.when(name.rlike(r"^[0-9.]+\z") | name.startswith("[") | (best == ""), name).otherwise(best)


def tile_url(scheme_and_host: Column, version: Column) -> Column:
    """Template under which a client finds the tiles of a version."""
    return F.concat(scheme_and_host, F.lit("/v"), version, F.lit("/{z}/{x}/{y}.mvt"))
