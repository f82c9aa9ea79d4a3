"""Hand-computed operator results (multi-batch, network, triggers, scores, search)."""

from pyspark.sql import functions as F

from conftest import lake_rows
from regilake.operators import aggregate as AG
from regilake.operators import history as H
from regilake.operators import network as NW
from regilake.operators import quality as QA
from regilake.operators import scoring as SC
from regilake.operators import search as SE


def _two_batches(spark):
    jan = lake_rows(spark, [
        dict(cnes="0000001", municipio="Manaus", uf="AM", leitos_existentes=50, leitos_sus=40,
             competencia="202601"),
        dict(cnes="0000002", municipio="Belém", uf="PA", leitos_existentes=80, leitos_sus=40,
             competencia="202601"),
    ], batch_id="jan", imported_at="2026-02-01")
    feb = lake_rows(spark, [
        dict(cnes="0000001", municipio="Manaus", uf="AM", leitos_existentes=60, leitos_sus=40,
             competencia="202602"),
        dict(cnes="0000003", municipio="Manaus", uf="AM", leitos_existentes=100, leitos_sus=0,
             competencia="202602"),
    ], batch_id="feb", imported_at="2026-03-01")
    return jan.unionByName(feb)


def test_multibatch_diff_series_aggregate(spark):
    lake = _two_batches(spark)
    d = {(r["status"], r["chave"]) for r in H.diff(lake, "jan", "feb").collect()}
    assert d == {("entrou", "0000003"), ("saiu", "0000002"), ("mudou", "0000001")}
    series = H.timeseries(lake, "0000001", "cnes", "202601", "202602").orderBy("competencia")
    assert [r["leitos_existentes"] for r in series.collect()] == [50, 60]
    agg = AG.aggregate_by(lake.where("batch_id = 'feb'"), "uf", "leitos_existentes").collect()
    assert [(r["grupo"], r["valor"]) for r in agg] == [("AM", 160)]


def test_mixed_competence_diff_uses_code_at_competence(spark):
    lake = _two_batches(spark)
    mixed = lake.withColumn("batch_id", F.when(F.col("cnes") == "0000002", F.lit("feb"))
                            .otherwise(F.col("batch_id")))
    keys = {r["chave"] for r in H.diff(mixed, "jan", "feb").collect()}
    assert all("@" in k for k in keys)


def _commercial(spark):
    a = lake_rows(spark, [
        dict(cnes="0000001", uf="AM", leitos_existentes=100, leitos_sus=70, leitos_uti_adulto=10,
             leitos_uti_pediatrica=0, leitos_uti_neonatal=0, cnpj_mantenedora="11111111000100",
             competencia="202501"),
        dict(cnes="0000002", uf="AM", leitos_existentes=50, leitos_sus=50, leitos_uti_adulto=0,
             leitos_uti_pediatrica=0, leitos_uti_neonatal=0, cnpj_mantenedora="22222222000100",
             competencia="202501"),
    ], batch_id="A")
    b = lake_rows(spark, [
        dict(cnes="0000001", uf="AM", leitos_existentes=130, leitos_sus=60, leitos_uti_adulto=30,
             leitos_uti_pediatrica=0, leitos_uti_neonatal=0, cnpj_mantenedora="11111111000100",
             total_habilitacoes=1, competencia="202502"),
        dict(cnes="0000003", uf="PA", leitos_existentes=80, leitos_sus=0, leitos_uti_adulto=5,
             leitos_uti_pediatrica=0, leitos_uti_neonatal=0, cnpj_mantenedora="11111111000100",
             total_habilitacoes=3, competencia="202502"),
    ], batch_id="B")
    return a, b


def test_maintainer_network(spark):
    _, b = _commercial(spark)
    groups, dist, missing = NW.maintainer_groups(b, None, limit=10)
    g = groups.collect()
    assert len(g) == 1
    r = g[0]
    assert (r["unidades"], r["leitos_existentes"], r["leitos_sus"]) == (2, 210, 60)
    assert r["mix_sus"] == round(60 / 210, 6)
    assert {(x["uf"], x["unidades_uf"]) for x in dist.collect()} == {("AM", 1), ("PA", 1)}
    assert missing.first()["unidades_sem_cnpj_mantenedora"] == 0


def test_maintainer_alert_and_absent(spark):
    b = lake_rows(spark, [dict(cnes="0000009", leitos_existentes=10, leitos_sus=20,
                               cnpj_mantenedora="3"),
                          dict(cnes="0000008", leitos_existentes=0, leitos_sus=5, cnpj_mantenedora="4",
                               campos_ausentes=["leitos_existentes"])])
    groups = {r["cnpj_mantenedora"]: r for r in NW.maintainer_groups(b, None, 10)[0].collect()}
    assert groups["3"]["alerta"] == "leitos_sus_maior_que_leitos_existentes"
    assert groups["3"]["mix_sus"] is None
    assert groups["4"]["leitos_existentes"] is None
    assert "leitos_existentes" in groups["4"]["campos_ausentes"]


def test_lead_triggers(spark):
    a, b = _commercial(spark)
    lake = a.unionByName(b)
    t20 = {(r["cnes"], r["motivo"]) for r in H.lead_triggers(lake, "A", "B", 20).collect()}
    assert t20 == {("0000001", "expansao"), ("0000003", "entrada"), ("0000002", "saida")}
    assert H.lead_triggers(lake, "A", "B", 100).count() == 0


def test_absent_beds_are_omitted_not_triggered(spark):
    a, b = _commercial(spark)
    b = b.withColumn("campos_ausentes", F.when(F.col("cnes") == "0000001",
                                               F.array(F.lit("leitos_existentes")))
                     .otherwise(F.col("campos_ausentes")))
    rows = H.lead_triggers(a.unionByName(b), "A", "B", 20).collect()
    omitted = [r for r in rows if r["leitos_ausentes"]]
    assert [r["cnes"] for r in omitted] == ["0000001"] and omitted[0]["motivo"] is None


def test_score_leaders(spark):
    a, b = _commercial(spark)
    size_only = {"porte": 1, "complexidade": 0, "mix_pagador": 0, "tendencia": 0}
    payer_only = {"porte": 0, "complexidade": 0, "mix_pagador": 1, "tendencia": 0}
    top = SC.top_leads(SC.score_leads(b, a, size_only), 1).first()
    assert top["cnes"] == "0000001"
    top = SC.top_leads(SC.score_leads(b, a, payer_only), 1).first()
    assert top["cnes"] == "0000003" and top["score_mix_pagador"] == 100.0


def _search_set(spark):
    return lake_rows(spark, [dict(cnes=f"{i:07d}", municipio="São Paulo", uf="SP",
                                  leitos_existentes=10 * i, convenio_sus=(i % 2 == 0),
                                  leitos_sus=5 * i if i % 2 == 0 else 0) for i in range(1, 13)])


def test_search_orders_and_pages(spark):
    rows = _search_set(spark)
    page, total = SE.search(rows, None, "leitos_existentes", 0, 10)
    assert [r["leitos_existentes"] for r in page.collect()] == list(range(120, 20, -10))
    assert total.first()["total"] == 12
    page, total = SE.search(rows, {"convenio_sus": True}, "leitos_existentes", 0, 10)
    assert [r["leitos_existentes"] for r in page.collect()] == [120, 100, 80, 60, 40, 20]
    page, _ = SE.search(rows, None, "cnes", 2, 3)
    assert [r["cnes"] for r in page.collect()] == ["0000003", "0000004", "0000005"]
    page, total = SE.search(rows, {"municipio": "sao paulo", "min_leitos": 50, "max_leitos": 70},
                            "cnes", 0, 10)
    assert [r["leitos_existentes"] for r in page.collect()] == [50, 60, 70]


def test_search_page_is_top_k_not_full_sort(spark):
    page, _ = SE.search(_search_set(spark), None, "leitos_existentes", 2, 5)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_validate_counts(spark):
    rows = lake_rows(spark, [
        dict(cnes="0000001", competencia="202501", leitos_existentes=10, leitos_sus=20),
        dict(cnes="0000001", competencia="202501", leitos_existentes=1, leitos_sus=0),
        dict(cnes="0000002", competencia="202502", nome_fantasia="",
             campos_ausentes=["leitos_sus"]),
    ])
    r = QA.validate(rows).first()
    assert r["cnes_duplicados"] == 1 and r["leitos_invalidos"] == 1 and r["leitos_ausentes"] == 1
    assert r["competencias"] == "202501,202502" and r["competencias_mistas"] is True
    assert r["vazios_nome_fantasia"] == 3 and r["valido"] is False


def test_match_collector_and_uf_map(spark):
    from regilake.operators.filters import match_collector
    rows = lake_rows(spark, [
        dict(cnes="1", municipio="São Paulo", uf="SP", leitos_existentes=80, natureza_juridica="2062-1",
             cnpj_mantenedora="9"),
        dict(cnes="2", municipio="São Paulo", uf="SP", leitos_existentes=80, natureza_juridica="1023-8",
             cnpj_mantenedora="9"),
        dict(cnes="3", municipio="Santos", uf="RJ", leitos_existentes=300, natureza_juridica="2062-1",
             cnpj_mantenedora="9"),
    ])
    got = match_collector(rows, "sao paulo", 50, 150, ["2062"]).collect()
    assert [r["cnes"] for r in got] == ["1"]
    long = AG.uf_distribution(rows, "cnpj_mantenedora")
    m = AG.as_map(long, "cnpj_mantenedora", "uf", "unidades_uf").first()["distribuicao"]
    assert m == {"RJ": 1, "SP": 2}


def test_series_of_all_keys_equals_each_key_when_a_unit_moves(spark):
    rows = spark.createDataFrame(
        [("1", "202401", "a", 10, 5, "2024-01-01", "x"), ("1", "202401", "b", 12, 6, "2024-02-01", "y"),
         ("2", "202401", "a", 1, 1, "2024-02-01", "y"), ("1", "202402", "b", 3, 2, "2024-03-01", "z")],
        "cnes string, competencia string, municipio_normalizado string, leitos_existentes long, "
        "leitos_sus long, imported_at string, batch_id string")
    every = H.timeseries(rows, None, "municipio", "202401", "202412").collect()
    for city in ("a", "b"):
        one = [tuple(r) for r in H.timeseries(rows, city, "municipio", "202401", "202412").collect()]
        assert one == [tuple(r)[1:] for r in every if r["chave"] == city]


def test_total_is_kept_on_an_empty_page(spark):
    page = spark.createDataFrame([("1",), ("2",)], "cnes string")
    total = page.groupBy().count().withColumnRenamed("count", "total")
    assert [(r["cnes"], r["total"]) for r in SE.page_with_total(page.offset(5).limit(2), total).collect()] \
        == [(None, 2)]
    assert [(r["cnes"], r["total"]) for r in SE.page_with_total(page.orderBy("cnes").limit(2), total).collect()] \
        == [("1", 2), ("2", 2)]
