"""Resource manifests from catalog pages, and competence discovery.

Pages are rows of a table (url, html); extraction is built-in JSON and
regex functions, so thousands of crawled pages parse in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import COMPETENCE_RE

RESOURCE_SCHEMA = ("array<struct<id:string,name:string,format:string,state:string,"
                   "url:string,last_modified:string>>")
YEAR_RE = r"(?:19|20)[0-9]{2}"
# Release archive names carry the competence.
ARCHIVE_RE = r"(?i)^BASE_DE_DADOS_CNES_([0-9]{6})\.ZIP$"


def _allowed(url: Column, host: str, path_prefix: str) -> Column:
    return ((F.parse_url(url, F.lit("PROTOCOL")) == "https")
            & (F.parse_url(url, F.lit("HOST")) == host)
            & F.coalesce(F.parse_url(url, F.lit("PATH")).startswith(path_prefix), F.lit(False)))


def resource_manifest(pages: DataFrame, host: str, path_prefix: str,
                      html: str = "html", page_key: str = "page_id") -> DataFrame:
    """Active CSV resources on allowed URLs with a 19xx/20xx year; per
    (year, id) the last occurrence in page order wins.

    Every ``"resources":`` marker starts a candidate JSON array; ``from_json``
    parses the leading array and ignores the text after it.
    """
    pieces = pages.select(page_key, F.posexplode(F.split(F.col(html), r'"resources"\s*:')).alias("_piece", "_text"))
    pieces = pieces.where(F.col("_piece") > 0)
    parsed = pieces.select(page_key, "_piece",
                           F.posexplode_outer(F.from_json(F.ltrim("_text"), RESOURCE_SCHEMA))
                           .alias("_item", "r"))
    r = F.col("r")
    url = F.coalesce(r["url"], F.lit(""))
    year = F.regexp_extract(F.concat_ws(" ", F.coalesce(r["name"], F.lit("")), url), YEAR_RE, 0)
    cand = parsed.where(r.isNotNull()).select(
        page_key, "_piece", "_item",
        year.alias("_year"),
        F.coalesce(r["id"], F.lit("")).alias("resource_id"),
        r["name"].alias("_name"), url.alias("url"), r["last_modified"].alias("last_modified"),
        F.coalesce(r["state"], F.lit("active")).alias("_state"), r["format"].alias("_format"))
    cand = cand.where((F.col("_state") == "active") & (F.upper(F.coalesce("_format", F.lit(""))) == "CSV")
                      & _allowed(F.col("url"), host, path_prefix) & (F.col("_year") != ""))
    cand = cand.withColumn("year", F.col("_year").cast("int")).withColumn(
        "name", F.coalesce("_name", F.concat(F.lit("Leitos "), F.col("_year"))))
    order = F.struct(page_key, "_piece", "_item")
    last = cand.groupBy("year", "resource_id").agg(
        F.max_by(F.struct("name", "url", "last_modified"), order).alias("_r"))
    return last.select("year", "resource_id", "_r.name", F.lit("CSV").alias("format"),
                       "_r.url", "_r.last_modified")


def latest_resource(resources: DataFrame) -> DataFrame:
    """Per year the most recently modified resource (NULL = oldest; ties -> name order)."""
    w = Window.partitionBy("year").orderBy(
        F.desc(F.coalesce("last_modified", F.lit(""))), F.asc("name"), F.asc("resource_id"))
    return resources.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def competences_in_file(rows: DataFrame, column: str = "COMP", year: int | None = None) -> DataFrame:
    """Distinct valid ``YYYYMM`` values of a column, sorted (optionally one year)."""
    c = F.trim(F.col(column))
    out = rows.select(c.alias("competencia")).where(F.col("competencia").rlike(COMPETENCE_RE))
    if year is not None:
        out = out.where(F.col("competencia").startswith(str(year)))
    return out.distinct().orderBy("competencia")


def competences_in_names(names: DataFrame, column: str = "name", year: int | None = None) -> DataFrame:
    """Competences parsed from archive names; default year = the newest one present."""
    comp = F.regexp_extract(F.col(column), ARCHIVE_RE, 1)
    found = names.select(comp.alias("competencia")).where(F.col("competencia").rlike(COMPETENCE_RE)) \
                 .distinct()
    if year is None:
        newest = found.agg(F.max(F.substring("competencia", 1, 4)).alias("_y"))
        found = found.join(F.broadcast(newest), F.substring("competencia", 1, 4) == F.col("_y")).drop("_y")
    else:
        found = found.where(F.col("competencia").startswith(str(year)))
    return found.orderBy("competencia")
