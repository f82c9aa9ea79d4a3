"""Manifest, payload buckets, annual file, competences, exports."""

import json
import os

import pytest

from pyspark.sql import functions as F

from conftest import lake_rows
from regilake.plans.export import export
from regilake.sources.annual import AnnualRequest, normalize_annual
from regilake.sources.buckets import flatten_buckets
from regilake.sources.lookups import PRIVATE_NATURE_CODES
from regilake.sources.manifest import (competences_in_file, competences_in_names,
                                       latest_resource, resource_manifest)

HOST, PREFIX = "dados.example.org", "/dataset/"


def test_resource_manifest_and_latest(spark):
    res = [
        {"id": "a", "name": "Leitos 2024", "format": "CSV", "state": "active",
         "url": f"https://{HOST}{PREFIX}a.csv", "last_modified": "2024-05-01"},
        {"id": "b", "name": "Leitos 2024 revisado", "format": "csv",
         "url": f"https://{HOST}{PREFIX}b.csv", "last_modified": "2024-09-01"},
        {"id": "c", "name": "Leitos 2023", "format": "CSV", "state": "deleted",
         "url": f"https://{HOST}{PREFIX}c.csv"},
        {"id": "d", "name": "Leitos 2022", "format": "CSV", "url": "http://other.org/d.csv"},
        {"id": "e", "name": "Leitos", "format": "CSV", "url": f"https://{HOST}{PREFIX}e.csv"},
        {"id": "f", "name": "Leitos 2021", "format": "XLSX", "url": f"https://{HOST}{PREFIX}f.xlsx"},
    ]
    html = ('<html><script>var x = {"resources": ' + json.dumps(res[:3]) + ', "more": 1};'
            '</script><p>"resources": ' + json.dumps(res[3:]) + '</p> trailing</html>')
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    found = resource_manifest(pages, HOST, PREFIX)
    assert sorted(r["resource_id"] for r in found.collect()) == ["a", "b"]
    latest = latest_resource(found).collect()
    assert [(r["year"], r["resource_id"]) for r in latest] == [(2024, "b")]


def test_bucket_payload_flatten(spark):
    def bucket(code, beds, nature):
        return {"key": code, "total_leitos": {"value": beds}, "total_leitos_sus": {"value": 5},
                "nome_fantasia": {"buckets": [{"key": f"H{code}"}]}, "gestao": {"buckets": [{"key": "M"}]},
                "natureza": {"buckets": [{"key": nature}]}, "uf": {"buckets": [{"key": "SP"}]}}
    payload = [{"result": {"rawResponse": {"aggregations": {"por_cnes": {"buckets": [
        bucket("1", 100, "2062-1"), bucket("2", 200, "2062-1"), bucket("3", 90, "1023-8")]}}}}}]
    df = spark.createDataFrame([(json.dumps(payload),)], "p string")
    rows = flatten_buckets(df, "p", "SAO PAULO", "202501", PRIVATE_NATURE_CODES, 50, 150).collect()
    assert [(r["cnes"], r["nome_fantasia"], r["leitos_existentes"]) for r in rows] == [("1", "H1", 100)]


def test_annual_normalize_filters(spark):
    header = ["COMP", "UF", "MUNICIPIO", "CNES", "NOME_ESTABELECIMENTO", "TP_GESTAO",
              "CO_TIPO_UNIDADE", "DS_TIPO_UNIDADE", "NATUREZA_JURIDICA", "DESC_NATUREZA_JURIDICA",
              "LEITOS_EXISTENTES", "LEITOS_SUS"]
    rows = [
        ("202501", "SP", "São Paulo", "1", "H1", "M", "05", "Hospital Geral", "2062",
         "Sociedade Empresária", "80", "10"),
        ("202501", "SP", "Santos", "2", "H2", "E", "05", "Hospital Geral", "2062",
         "Sociedade Empresária", "x", "10"),
        ("202502", "SP", "São Paulo", "3", "H3", "M", "05", "Hospital Geral", "2062",
         "Sociedade Empresária", "80", "10"),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{h} string" for h in header))
    req = AnnualRequest("202501", uf="sp", municipality="sao", establishment_type="geral",
                        legal_nature="sociedade", management="m", sus_agreement=True,
                        min_beds=50, max_beds=100)
    out, rejected = normalize_annual(df, req)
    r = out.collect()
    assert len(r) == 1 and r[0]["CONVENIO_SUS"] == "Sim"
    assert r[0]["TIPO_ESTABELECIMENTO"] == "05 - Hospital Geral"
    assert r[0]["NATUREZA_JURIDICA"] == "2062 - Sociedade Empresária"
    assert rejected.first()["rejeitadas"] == 0
    _, rej_all = normalize_annual(df, AnnualRequest("202501"))
    assert rej_all.first()["rejeitadas"] == 1
    comps = [r["competencia"] for r in competences_in_file(df).collect()]
    assert comps == ["202501", "202502"]


def test_competences_in_names(spark):
    names = spark.createDataFrame([("BASE_DE_DADOS_CNES_202401.ZIP",), ("BASE_DE_DADOS_CNES_202502.zip",),
                                   ("BASE_DE_DADOS_CNES_202503.ZIP",), ("other.zip",)], "name string")
    assert [r["competencia"] for r in competences_in_names(names).collect()] == ["202502", "202503"]
    assert [r["competencia"] for r in competences_in_names(names, year=2024).collect()] == ["202401"]


def test_exports_with_provenance(spark, tmpdir_path):
    lake = lake_rows(spark, [dict(cnes=f"{i:07d}", uf="SP", leitos_existentes=i, cnpj=f"{i}",
                                  habilitacoes=["A"]) for i in range(1, 6)], batch_id="B1")
    res = export(lake, "B1", "csv", os.path.join(tmpdir_path, "out_csv"), filters={"min_leitos": 2},
                 order_by="leitos_existentes", limit=3)
    assert res["registros"] == 3
    csv_df = spark.read.option("header", True).csv(os.path.join(tmpdir_path, "out_csv"))
    assert "CNES" in csv_df.columns and "_lote_id" in csv_df.columns
    assert {r["_lote_id"] for r in csv_df.collect()} == {"B1"}
    res = export(lake, "B1", "jsonl", os.path.join(tmpdir_path, "out_jsonl"), codes=["0000001"],
                 profile="crm_generico")
    js = spark.read.json(os.path.join(tmpdir_path, "out_jsonl")).collect()
    assert res["registros"] == 1 and js[0]["chave_deduplicacao"] == "0000001:1"
    assert js[0]["_metadados"]["perfil_saida"] == "crm_generico"


def test_annual_files_are_read_once_and_nothing_found_is_an_error(spark, tmpdir_path):
    import zipfile

    from regilake.plans.normalize import NothingFound, normalize_annual_files
    head = "COMP;UF;MUNICÍPIO;CNES;NOME_ESTABELECIMENTO;TP_GESTAO;CO_TIPO_UNIDADE;DS_TIPO_UNIDADE;NATUREZA_JURIDICA;DESC_NATUREZA_JURIDICA;LEITOS_EXISTENTES;LEITOS_SUS"
    lines = [head, "202501;AM;MANAUS;1;A;M;05;HOSPITAL;2062;LTDA;10;0", "202501;AM;MANAUS;2;B;M;05;HOSPITAL;2062;LTDA;x;0",
             "202501;PA;BELÉM;3;C;M;05;HOSPITAL;2062;LTDA;9;9", "202412;AM;MANAUS;4;D;M;05;HOSPITAL;2062;LTDA;1;1"]
    plain = os.path.join(tmpdir_path, "a.csv")
    with open(plain, "wb") as f:
        f.write("\n".join(lines).encode("latin-1"))
    packed = os.path.join(tmpdir_path, "b.zip")
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("Leitos.csv", "\n".join([head, "202501;AM;MANAUS;5;E;M;05;HOSPITAL;2062;LTDA;7;1"]).encode("latin-1"))
    dest = os.path.join(tmpdir_path, "out")
    got = normalize_annual_files(spark, [plain, packed], AnnualRequest("202501", uf="am", min_beds=5), dest)
    assert (got["registros"], got["rejeitadas"]) == (2, 1)
    assert got["filtros_locais"] == ["competencia", "uf", "min_leitos"] and got["campos_derivados"] == ["convenio_sus"]
    rows = {r.CNES: (r.CONVENIO_SUS, r.TIPO_ESTABELECIMENTO) for r in spark.read.option("header", True).csv(dest).collect()}
    assert rows == {"1": ("Não", "05 - HOSPITAL"), "5": ("Sim", "05 - HOSPITAL")}
    with pytest.raises(NothingFound):
        normalize_annual_files(spark, [plain], AnnualRequest("202501", uf="SP"), os.path.join(tmpdir_path, "none"))
    assert not os.path.exists(os.path.join(tmpdir_path, "none")) and not os.path.exists(os.path.join(tmpdir_path, "none.part"))
