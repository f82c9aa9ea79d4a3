"""Queries registered with the driver: (spark, sf_dir) -> DataFrame.

Each reads the driver tables (through the release binding) so its work
grows with them; each has a DuckDB twin in ``oracle_queries.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as AG
from ..operators.filters import apply_filters, match_collector
from ..sources.driver_tables import registry_lake
from ..sources.lookups import PRIVATE_NATURE_CODES

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _agg(group_by: str, metric: str, filters=None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lake = apply_filters(registry_lake(spark, sf_dir), filters)
        return AG.aggregate_by(lake, group_by, metric)
    return run


for _metric_name, _suffix in (("estabelecimentos", "count"), ("leitos_existentes", "beds"),
                              ("leitos_sus", "sus"), ("media_leitos", "avg")):
    register(f"agg_by_uf_{_suffix}")(_agg("uf", _metric_name))
    register(f"agg_by_tipo_{_suffix}")(_agg("tipo", _metric_name))
register("agg_by_natureza_filtered")(_agg(
    "natureza", "leitos_existentes",
    {"convenio_sus": True, "min_leitos": 50, "max_leitos": 400, "tipo_estabelecimento": "Hospital"}))
register("agg_by_gestao_municipio_filter")(_agg("gestao", "estabelecimentos", {"municipio": "  Nátion_1 "}))


@register("statistics_totals")
def statistics_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AG.statistics(registry_lake(spark, sf_dir))


@register("statistics_uf")
def statistics_uf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AG.statistics_by_uf(registry_lake(spark, sf_dir))


# --- search -----------------------------------------------------------------
from ..operators import history as H  # noqa: E402
from ..operators import network as NW  # noqa: E402
from ..operators import quality as QA  # noqa: E402
from ..operators import scoring as SC  # noqa: E402
from ..operators import search as SE  # noqa: E402
from ..operators.filters import for_batch  # noqa: E402
from ..sources import release as RL  # noqa: E402
from ..sources.driver_tables import both_imports, release_tables  # noqa: E402

PAIR_A, PAIR_B = "R199612", "R199712"
SCORE_WEIGHTS = {"porte": 0.4, "complexidade": 0.3, "mix_pagador": 0.2, "tendencia": 0.1}


@register("search_page_cnes")
def search_page_cnes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = for_batch(registry_lake(spark, sf_dir), PAIR_A)
    page, total = SE.search(rows, None, "cnes", offset=100, limit=100)
    return SE.page_with_total(page, total)


@register("search_page_beds")
def search_page_beds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = for_batch(registry_lake(spark, sf_dir), PAIR_A)
    page, total = SE.search(rows, {"min_leitos": 100}, "leitos_existentes", offset=20, limit=50)
    return SE.page_with_total(page, total)


@register("search_page_municipio_v2")
def search_page_municipio_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = for_batch(registry_lake(spark, sf_dir), PAIR_B)
    page, total = SE.search(rows, {"gestao": "m", "convenio_sus": False}, "municipio",
                            offset=0, limit=500, v2=True)
    page = page.withColumn("habilitacoes", F.array_join("habilitacoes", ",")) \
               .withColumn("campos_ausentes", F.array_join("campos_ausentes", ","))
    return SE.page_with_total(page, total)


@register("search_city")
def search_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The city tool with its defaults: largest units first."""
    rows = for_batch(registry_lake(spark, sf_dir), PAIR_B)
    page, total = SE.by_municipality(rows, "natíon_1", {"gestao": "e", "max_leitos": 400, "tipo_estabelecimento": "HOSPITAL"})
    return SE.page_with_total(page, total)


@register("search_state")
def search_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = for_batch(registry_lake(spark, sf_dir), PAIR_B)
    page, total = SE.by_uf(rows, "go", {"natureza_juridica": "sociedade", "convenio_sus": True})
    return SE.page_with_total(page, total)


@register("search_codes")
def search_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of 500 codes (the tool's limit) in every batch."""
    codes = [f"{i:07d}" for i in range(3, 1503, 3)]
    rows = apply_filters(registry_lake(spark, sf_dir), {"cnes_list": codes})
    return rows.select("batch_id", "cnes", "municipio", "leitos_existentes", "leitos_sus")


@register("agg_by_city")
def agg_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AG.aggregate_by(apply_filters(registry_lake(spark, sf_dir), {"uf": "am"}), "municipio", "leitos_sus")


@register("collector_match")
def collector_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collector's rule over raw release rows: city, bed range and private legal nature codes."""
    t = release_tables(spark, sf_dir)
    beds = RL.bed_totals(t["leitos"], t["leito"], t["tipo_leito"])
    units = RL.first_unit_per_code(t["estabelecimento"]).withColumn("co_unidade", F.trim("co_unidade")) \
        .join(beds, ["competencia", "co_unidade"]).join(t["municipio"].select(F.col("codigo").alias("municipio"), "nome"), "municipio")
    rows = units.select("competencia", "cnes", F.col("nome").alias("municipio"), F.col("natureza").alias("natureza_juridica"),
                        F.coalesce("total_exist", F.lit(0)).cast("bigint").alias("leitos_existentes"))
    return match_collector(rows, "Nátion_2", 20, 300, PRIVATE_NATURE_CODES)


@register("by_code")
def by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SE.by_code(both_imports(spark, sf_dir, {"cnes_list": ["0000010"]}), "0000010").select(
        "cnes", "competencia", "batch_id", "leitos_existentes", "leitos_sus")


# --- quality ------------------------------------------------------------------
@register("validate_batches")
def validate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QA.validate(both_imports(spark, sf_dir), rollup="ALL")


@register("bed_pivot_poison")
def bed_pivot_poison(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = release_tables(spark, sf_dir)
    return RL.bed_totals(t["leitos"], t["leito"], t["tipo_leito"])


@register("active_qualifications")
def active_qualifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = release_tables(spark, sf_dir)
    rows = RL.qualification_rows(t["habilitacoes"], t["habilitacao"],
                                 t["estabelecimento"].select("competencia"))
    sets = RL.qualification_sets(rows)
    return sets.withColumn("habilitacoes", F.array_join("habilitacoes", ","))


# --- history ------------------------------------------------------------------
@register("timeseries_unit")
def timeseries_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.timeseries(both_imports(spark, sf_dir, {"cnes_list": ["0000010"]}), "0000010", "cnes", "199512", "200112")


@register("timeseries_city")
def timeseries_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.timeseries(both_imports(spark, sf_dir, {"municipio": " Nation_13"}), " Nation_13", "municipio", "199612", "200012")


@register("timeseries_all_cities")
def timeseries_all_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.timeseries(both_imports(spark, sf_dir), None, "municipio", "000000", "999999")


def _diff_status(status: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = H.diff(registry_lake(spark, sf_dir), PAIR_A, PAIR_B)
        return d.where(F.col("status") == status)
    return run


register("diff_entered")(_diff_status("entrou"))
register("diff_left")(_diff_status("saiu"))
register("diff_changed")(_diff_status("mudou"))


@register("diff_mixed")
def diff_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two multi-competence batches: keys become code@competence."""
    lake = registry_lake(spark, sf_dir)
    x = lake.where(F.col("competencia").isin("199512", "199612")).withColumn("batch_id", F.lit("X"))
    y = lake.where(F.col("competencia").isin("199612", "199712")).withColumn("batch_id", F.lit("Y"))
    return H.diff(x.unionByName(y), "X", "Y")


@register("lead_triggers")
def lead_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = H.lead_triggers(registry_lake(spark, sf_dir), PAIR_A, PAIR_B, 20)
    return t.where(F.col("motivo").isNotNull()).drop("leitos_ausentes")


@register("lead_triggers_omitted")
def lead_triggers_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = H.lead_triggers(registry_lake(spark, sf_dir), PAIR_A, PAIR_B, 20)
    return t.agg(F.count_if("leitos_ausentes").alias("omitidos"),
                 F.count_if(F.col("motivo").isNotNull()).alias("gatilhos"))


@register("lead_triggers_hospital")
def lead_triggers_hospital(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = H.lead_triggers(registry_lake(spark, sf_dir), PAIR_A, PAIR_B, 5, "Hospital")
    return t.where(F.col("motivo").isNotNull()).drop("leitos_ausentes")


@register("lead_triggers_history")
def lead_triggers_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = H.lead_triggers_history(registry_lake(spark, sf_dir), 20)
    return t.where(F.col("motivo").isNotNull()).drop("leitos_ausentes")


# --- networks and scores ----------------------------------------------------------
def _groups(spark: SparkSession, sf_dir: str):
    return NW.maintainer_groups(for_batch(registry_lake(spark, sf_dir), PAIR_B), None, limit=25)


@register("maintainer_groups")
def maintainer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)[0]


@register("maintainer_uf")
def maintainer_uf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)[1]


@register("maintainer_missing")
def maintainer_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)[2]


def _scores(spark: SparkSession, sf_dir: str, filters=None) -> DataFrame:
    lake = registry_lake(spark, sf_dir)
    scored = SC.score_leads(for_batch(lake, PAIR_B), for_batch(lake, PAIR_A),
                            SCORE_WEIGHTS, filters)
    return scored.withColumn("campos_ausentes", F.array_join("campos_ausentes", ","))


@register("score_leads")
def score_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.top_leads(_scores(spark, sf_dir), 100)


@register("score_leads_all")
def score_leads_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


@register("score_leads_filtered")
def score_leads_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, {"convenio_sus": True, "tipo_estabelecimento": "hospital"})


# --- ingest -----------------------------------------------------------------------
from ..operators import ingest as IG  # noqa: E402
from ..sources.driver_tables import event_rows, read_table  # noqa: E402
from ..schema import V1_COLUMNS  # noqa: E402

EVENT_CONTENT = ("cnes", "competencia", "nome_fantasia", "municipio", "uf",
                 "tipo_estabelecimento", "natureza_juridica", "gestao",
                 "leitos_existentes", "leitos_sus", "convenio_sus")


def _event_load(spark: SparkSession, sf_dir: str):
    raw = event_rows(spark, sf_dir)
    deduped = IG.exact_dedupe(raw, EVENT_CONTENT)
    validated = IG.validate_rows(deduped)
    accepted = validated.where(F.col("reject_reason").isNull())
    consolidated = IG.consolidate(accepted)
    return raw, deduped, validated, consolidated


@register("consolidate_events")
def consolidate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_load(spark, sf_dir)[3].select(*V1_COLUMNS)


@register("load_summary_events")
def load_summary_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, validated, consolidated = _event_load(spark, sf_dir)
    return IG.load_summary(validated, consolidated)


@register("content_digest_events")
def content_digest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IG.content_digest(_event_load(spark, sf_dir)[3], V1_COLUMNS)


@register("exact_dedupe_documents")
def exact_dedupe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("_ord"), "text", "lang", "source")
    kept = IG.exact_dedupe(docs, ("text", "lang", "source"))
    return kept.select(F.col("_ord").alias("doc_id"), F.col("_copies").alias("copias"))


# --- text, rollups, exports, catalog ---------------------------------------------------
from ..functions import text as TX  # noqa: E402
from ..operators.rollup import top_bucket_rollup  # noqa: E402
from ..session import checkpoint_dir  # noqa: E402
from ..sources import lake as LK  # noqa: E402
from . import export as EX  # noqa: E402
from .release_ingest import ingest_binding  # noqa: E402
from ..sources.driver_tables import NATURE_CODES  # noqa: E402
from ..functions.rules import prefix_any  # noqa: E402


@register("norm_text_documents")
def norm_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", TX.norm_text("text").alias("texto_normalizado"),
                       TX.upper_unaccent("text").alias("texto_maiusculo"))


@register("top_bucket_rollup")
def top_bucket_rollup_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bed rows of 1997 for private-nature units: sums + most frequent attributes."""
    li = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    rows = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
              .where((F.col("o_orderdate") >= F.lit("1997-01-01").cast(o.schema["o_orderdate"].dataType))
                     & (F.col("o_orderdate") < F.lit("1998-01-01").cast(o.schema["o_orderdate"].dataType)))
              .join(c, F.col("o_custkey") == F.col("c_custkey")))
    k = F.col("c_custkey")
    nature = F.element_at(F.array(*[F.lit(x) for x in NATURE_CODES]), (k % 5 + 1).cast("int"))
    rows = rows.select(
        TX.pad_code(k.cast("string")).alias("cnes"), F.col("l_quantity").cast("bigint").alias("qt"),
        F.when(F.col("l_returnflag") == "R", F.lit(0)).otherwise(F.col("l_quantity").cast("bigint"))
         .alias("qt_sus"),
        F.col("l_returnflag").alias("gestao"), F.col("l_linestatus").alias("situacao"),
        nature.alias("natureza"), F.col("c_mktsegment").alias("tipo"))
    rows = rows.where(prefix_any("natureza", PRIVATE_NATURE_CODES))
    return top_bucket_rollup(rows, "cnes", {"total_leitos": "qt", "total_leitos_sus": "qt_sus"},
                             ["gestao", "situacao", "natureza", "tipo"])


@register("crm_projection")
def crm_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = EX.crm_projection(for_batch(registry_lake(spark, sf_dir), PAIR_B))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("habilitacoes", "campos_ausentes")})


def _catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LK.list_batches(both_imports(spark, sf_dir))


@register("batches_listing")
def batches_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog_rows(spark, sf_dir)


@register("retention_victims")
def retention_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LK.retention_victims(_catalog_rows(spark, sf_dir), keep=4, current="R199912")


@register("missing_profile_batches")
def missing_profile_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    prof = AG.missing_profile(both_imports(spark, sf_dir),
                              ("nome_fantasia", "municipio", "uf", "tipo_estabelecimento",
                               "natureza_juridica", "gestao", "complemento", "telefone", "email"),
                              keys=["batch_id"])
    return prof.withColumn("campos_vazios", F.array_join("campos_vazios", ","))


@register("union_missing_batches")
def union_missing_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = AG.union_absent(both_imports(spark, sf_dir), keys=["batch_id"])
    return u.withColumn("campos_ausentes", F.array_join("campos_ausentes", ","))


# --- sources on the driver tables ----------------------------------------------------------
from ..sources.annual import AnnualRequest, normalize_annual  # noqa: E402
from ..sources.driver_tables import annual_rows, catalog_pages  # noqa: E402
from ..sources.manifest import competences_in_file, latest_resource, resource_manifest  # noqa: E402

ANNUAL_REQUEST = AnnualRequest("199712", establishment_type="hospital", legal_nature="sociedade",
                               sus_agreement=True, min_beds=1000)


@register("annual_normalize")
def annual_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_annual(annual_rows(spark, sf_dir), ANNUAL_REQUEST)[0]


@register("annual_rejected")
def annual_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_annual(annual_rows(spark, sf_dir), AnnualRequest("199712"))[1]


@register("competences_orders")
def competences_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyyMM").alias("COMP"))
    return competences_in_file(orders, "COMP", year=1998)


@register("resource_manifest_pages")
def resource_manifest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog resources embedded in the crawled pages (latest per year)."""
    return latest_resource(resource_manifest(catalog_pages(spark, sf_dir), "dados.example.org", "/dataset/"))


@register("resource_manifest_all")
def resource_manifest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resource_manifest(catalog_pages(spark, sf_dir), "dados.example.org", "/dataset/")


@register("score_leads_history")
def score_leads_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every competence against its previous one, one plan."""
    lake = registry_lake(spark, sf_dir)
    pairs = F.broadcast(H.consecutive_pairs(lake))
    current = lake.join(pairs.select(F.col("competencia_b").alias("competencia")), "competencia")
    prior = lake.join(pairs.select(F.col("competencia_a").alias("competencia"),
                                   F.col("competencia_b").alias("_next")), "competencia") \
                .drop("competencia").withColumnRenamed("_next", "competencia")
    scored = SC.score_leads(current, prior, SCORE_WEIGHTS, keys=("competencia",))
    return scored.withColumn("campos_ausentes", F.array_join("campos_ausentes", ","))


# --- the written lake ------------------------------------------------------------------------
FETCH_FILTERS = {"uf": "go", "tipo_estabelecimento": "Hospital", "min_leitos": 20, "max_leitos": 5000}


@register("fetch_filtered")
def fetch_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fetch with filters publishes: the clauses work on the raw release tables."""
    rows = registry_lake(spark, sf_dir, FETCH_FILTERS)
    return rows.select("batch_id", "cnes", "uf", "tipo_estabelecimento", "leitos_existentes", "leitos_sus", "leitos_clinicos",
                       F.array_join("habilitacoes", ",").alias("habilitacoes"), "total_habilitacoes",
                       F.array_join("campos_ausentes", ",").alias("campos_ausentes"))


@register("fetch_filtered_beds")
def fetch_filtered_beds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters on bed totals alone still spare other units' qualifications."""
    rows = registry_lake(spark, sf_dir, {"convenio_sus": False, "max_leitos": 60})
    return rows.select("batch_id", "cnes", "leitos_existentes", "leitos_sus", "convenio_sus", "total_habilitacoes")


def written_lake(spark: SparkSession, sf_dir: str) -> str:
    """Both imports written as a lake of their own in the shared folder; its root."""
    import uuid
    root = f"{checkpoint_dir(spark).rstrip('/')}/lakes/{uuid.uuid4().hex}"
    ingest_binding(spark, sf_dir, root)
    return root


def _by_state(lake: DataFrame) -> DataFrame:
    return lake.groupBy("batch_id", "imported_at", "uf").agg(
        F.count("*").alias("estabelecimentos"), F.sum("leitos_existentes").alias("leitos_existentes"))


@register("written_lake_by_state")
def written_lake_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lake as users have it: written, then read through the catalog, whose choice of batches prunes partitions."""
    root = written_lake(spark, sf_dir)
    return _by_state(LK.read_lake(spark, root, LK.read_catalog(spark, root).where(F.col("imported_at") < "1997")))


@register("written_lake_batches")
def written_lake_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing from the catalog alone."""
    return LK.list_catalogued(LK.read_catalog(spark, written_lake(spark, sf_dir))).drop("filters_json")


@register("written_lake_retained")
def written_lake_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lake after one batch was purged and retention kept the current one and the three newest others."""
    root = written_lake(spark, sf_dir)
    LK.remove_batches(spark, root, ["V199812"])
    LK.retain(spark, root, 4, "R199912")
    default = LK.default_batch(spark, root)["batch_id"]
    return _by_state(LK.read_lake(spark, root)).withColumn("padrao", F.col("batch_id") == default)
