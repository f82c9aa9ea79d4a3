"""CSV load, release archive normalisation, streaming autoload."""

import io
import os
import shutil
import zipfile

import pytest

from regilake.plans.load import load_csv
from regilake.sources import archives as AR
from regilake.sources import lake as LK
from regilake.sources.release import normalize_release

FIX = os.path.join(os.path.dirname(__file__), "fixtures")


def test_csv_load_fixtures(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "lake")
    first = load_csv(spark, [os.path.join(FIX, "valid.csv")], root)
    assert first["accepted_count"] == 1 and first["rows_read"] == 1
    again = load_csv(spark, [os.path.join(FIX, "valid.csv")], root)
    assert again["batch_id"] == first["batch_id"] and again["reused"]
    dup = load_csv(spark, [os.path.join(FIX, "granular_duplicate.csv")], root)
    assert (dup["rows_read"], dup["rows_ignored"], dup["accepted_count"]) == (3, 1, 1)
    bad = load_csv(spark, [os.path.join(FIX, "invalid_rows.csv")], root)
    assert bad["rows_rejected"] == 1 and bad["rejection_reasons"] == '{"valor_invalido":1}'
    rows = LK.read_lake(spark, root)
    g = rows.where(f"batch_id = '{dup['batch_id']}'").first()
    assert (g["leitos_existentes"], g["leitos_sus"]) == (50, 30)
    v = rows.where(f"batch_id = '{first['batch_id']}'").first()
    assert v["competencia"] == "202607" and v["convenio_sus"] is True
    assert "leitos_uti_adulto" in v["campos_ausentes"]


def test_csv_without_code_column_fails(spark, tmpdir_path):
    import pytest
    from regilake.sources.csv_files import CsvLoadError
    with pytest.raises(CsvLoadError):
        load_csv(spark, [os.path.join(FIX, "invalid.csv")], os.path.join(tmpdir_path, "lake"))


def test_semicolon_latin1_and_labels(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "annual.csv")
    with open(path, "wb") as fh:
        fh.write("CNES;NOME_ESTABELECIMENTO;CO_TIPO_UNIDADE;DS_TIPO_UNIDADE;NATUREZA_JURIDICA;"
                 "DESC_NATUREZA_JURIDICA;LEITOS_EXISTENTES;LEITOS_SUS;COMP\n"
                 "7777777;Hospital São João;05;Hospital Geral;2062;Sociedade Empresária;60;0;202501\n"
                 .encode("latin-1"))
    res = load_csv(spark, [path], os.path.join(tmpdir_path, "lake"))
    row = LK.read_lake(spark, os.path.join(tmpdir_path, "lake")).first()
    assert res["accepted_count"] == 1
    assert row["nome_fantasia"] == "Hospital São João"
    assert row["tipo_estabelecimento"] == "05 - Hospital Geral"
    assert row["natureza_juridica"] == "2062 - Sociedade Empresária"
    assert row["convenio_sus"] is False


RELEASE = {
    "tbEstabelecimento": [
        "CO_UNIDADE;CO_CNES;CO_MUNICIPIO_GESTOR;NO_RAZAO_SOCIAL;NO_FANTASIA;NU_CNPJ;"
        "NU_CNPJ_MANTENEDORA;TP_PFPJ;NIVEL_DEP;NO_LOGRADOURO;NU_ENDERECO;NO_COMPLEMENTO;NO_BAIRRO;"
        "CO_CEP;NU_LATITUDE;NU_LONGITUDE;NU_TELEFONE;NO_EMAIL;CO_TIPO_UNIDADE;CO_NATUREZA_JUR;"
        "TP_GESTAO;NU_CPF",
        "U1;1234567;130260;HOSPITAL X LTDA;HOSPITAL X;12.345.678/0001-90;;3;3;RUA A;10;;CENTRO;"
        "69000-000;-3,1;-60,0;;Contato@X.COM;05;2062;M;",
        "U2;7654321;130260;FULANO;;;;1;1;;;;;;;;;;05;2062;M;11111111111",
    ],
    "tbMunicipio": ["CO_MUNICIPIO;NO_MUNICIPIO;CO_SIGLA_ESTADO", "130260;MANAUS;AM"],
    "rlEstabComplementar": ["CO_UNIDADE;CO_LEITO;QT_EXIST;QT_SUS", "U1;L1;30;20", "U1;L2;40;30",
                            "U1;L3;30;10"],
    "tbLeito": ["CO_LEITO;DS_LEITO;CO_TIPO_LEITO", "L1;UTI ADULTO TIPO II;3", "L2;CLÍNICO GERAL;2",
                "L3;CIRURGIA GERAL;1"],
    "tbTipoLeito": ["CO_TIPO_LEITO;DS_TIPO_LEITO", "1;CIRÚRGICO", "2;CLÍNICO", "3;COMPLEMENTAR"],
    "tbTipoUnidade": ["CO_TIPO_UNIDADE;DS_TIPO_UNIDADE", "05;HOSPITAL GERAL"],
    "tbNaturezaJuridica": ["CO_NATUREZA_JUR;DS_NATUREZA_JUR", "2062;SOCIEDADE EMPRESARIA LIMITADA"],
    "rlEstabSipac": ["CO_UNIDADE;COD_SUB_GRUPO_HABILITACAO;CMTP_INICIO;CMTP_FIM",
                     "U1;0101;012024;999999", "U1;0202;012024;122030", "U1;0303;012020;122020"],
    "tbSubGruposHabilitacao": ["CO_CODIGO_GRUPO;NO_DESCRICAO_GRUPO", "0101;UTI ADULTO",
                               "0202;ONCOLOGIA"],
}


def _write_release(folder, competence="202501", overrides=None):
    tables = dict(RELEASE)
    tables.update(overrides or {})
    path = os.path.join(folder, f"BASE_DE_DADOS_CNES_{competence}.ZIP")
    with zipfile.ZipFile(path, "w") as zf:
        for name, lines in tables.items():
            zf.writestr(f"{name}{competence}.csv", ("\n".join(lines) + "\n").encode("latin-1"))
        zf.writestr("../evil.csv", b"x")
    return path


def _normalize(spark, tmp, overrides=None):
    archive = _write_release(tmp, overrides=overrides)
    statuses = {r["status"] for r in AR.manifest(spark, [archive]).collect()}
    assert "unsafe_name" in statuses and "ok" in statuses
    return normalize_release(AR.land_releases(spark, [archive], os.path.join(tmp, "landing"))).collect()


def test_release_archive_normalization(spark, tmpdir_path):
    rows = _normalize(spark, tmpdir_path)
    assert len(rows) == 1
    r = rows[0]
    assert r["cnes"] == "1234567" and r["competencia"] == "202501"
    assert (r["leitos_existentes"], r["leitos_sus"]) == (100, 60)
    assert r["leitos_uti_adulto"] == 30 and r["leitos_complementares"] == 30
    assert r["leitos_clinicos"] == 40 and r["leitos_cirurgicos"] == 30
    assert r["habilitacoes"] == ["ONCOLOGIA", "UTI ADULTO"] and r["total_habilitacoes"] == 2
    assert r["geo_confiavel"] is True and r["campos_ausentes"] == []
    assert r["cnpj"] == "12345678000190" and r["email"] == "contato@x.com"
    assert r["nivel_dependencia"] == "MANTIDO" and r["municipio_normalizado"] == "manaus"
    assert r["tipo_estabelecimento"] == "HOSPITAL GERAL"


def test_release_absent_beds_and_bad_geo(spark, tmpdir_path):
    est = list(RELEASE["tbEstabelecimento"])
    est[1] = est[1].replace("-3,1;-60,0", "-30,0;-60,0")
    beds = ["CO_UNIDADE;CO_LEITO;QT_EXIST;QT_SUS", "U1;L1;;20", "U1;L2;40;30"]
    r = _normalize(spark, tmpdir_path, {"tbEstabelecimento": est, "rlEstabComplementar": beds})[0]
    assert r["latitude"] == -30.0 and r["geo_confiavel"] is False
    assert r["leitos_existentes"] == 0 and r["leitos_uti_adulto"] is None
    assert "leitos_existentes" in r["campos_ausentes"] and "leitos_uti_adulto" in r["campos_ausentes"]
    assert r["leitos_sus"] == 50


def test_release_without_optional_bed_type_table(spark, tmpdir_path):
    archive = _write_release(tmpdir_path)
    # Rebuild the archive without the optional table.
    clean = os.path.join(tmpdir_path, "clean")
    os.makedirs(clean)
    target = os.path.join(clean, os.path.basename(archive))
    with zipfile.ZipFile(archive) as src, zipfile.ZipFile(target, "w") as dst:
        for info in src.infolist():
            if not info.filename.startswith("tbTipoLeito"):
                dst.writestr(info, src.read(info))
    landing = os.path.join(tmpdir_path, "landing2")
    r = normalize_release(AR.land_releases(spark, [target], landing)).first()
    # Default bed types: 1 = CIRURGICO, 2 = CLINICO, 3 = COMPLEMENTAR.
    assert r["leitos_cirurgicos"] == 30 and r["leitos_complementares"] == 30


def test_autoload_stream_is_idempotent(spark, tmpdir_path):
    from regilake.streaming.autoload import autoload
    landing = os.path.join(tmpdir_path, "in")
    os.makedirs(landing)
    root = os.path.join(tmpdir_path, "lake")
    shutil.copy(os.path.join(FIX, "valid.csv"), landing)
    q = autoload(spark, landing, root, checkpoint=os.path.join(tmpdir_path, "ck"))
    q.awaitTermination()
    shutil.copy(os.path.join(FIX, "valid.csv"), os.path.join(landing, "again.csv"))
    q2 = autoload(spark, landing, root, checkpoint=os.path.join(tmpdir_path, "ck"))
    q2.awaitTermination()
    assert len(q.results) == 1 and len(q2.results) == 1 and q2.results[0]["reused"]
    assert LK.read_catalog(spark, root).count() == 1


def test_fetch_releases_skips_known_archives(spark, tmpdir_path):
    from regilake.plans.release_ingest import fetch_releases
    folder = os.path.join(tmpdir_path, "arch")
    os.makedirs(folder)
    a1 = _write_release(folder, "202501")
    root = os.path.join(tmpdir_path, "lake")
    first = fetch_releases(spark, [a1], root, os.path.join(tmpdir_path, "landing"))
    assert len(first) == 1 and first[0]["accepted_count"] == 1
    again = fetch_releases(spark, [a1], root, os.path.join(tmpdir_path, "landing"))
    assert again == []
    lake = LK.read_lake(spark, root)
    assert lake.count() == 1 and lake.first()["competencia"] == "202501"


def test_register_parquet_contract(spark, tmpdir_path):
    from pyspark.sql import functions as F

    from conftest import lake_rows
    path = os.path.join(tmpdir_path, "v2.parquet")
    rows = lake_rows(spark, [dict(cnes="0000001", competencia="202501"), dict(cnes="0000002", competencia="202502")]) \
        .drop("batch_id", "imported_at")
    rows.repartition(2).write.parquet(path)
    root = os.path.join(tmpdir_path, "lake")
    e = LK.register_parquet(spark, path, root, "s1")
    assert e["accepted_count"] == 2 and e["competence"] == "202501,202502"
    copy = os.path.join(tmpdir_path, "copy.parquet")
    shutil.copytree(path, copy)
    e2 = LK.register_parquet(spark, copy, root, "s1", etag="t")  # the same bytes under another name
    assert e2["batch_id"] == e["batch_id"]
    cat = LK.read_catalog(spark, root).collect()
    assert len(cat) == 1 and cat[0]["etag"] == "t" and cat[0]["imported_at"] == e["imported_at"]
    assert LK.register_parquet(spark, path, root, "s2")["batch_id"] != e["batch_id"]
    assert LK.register_parquet(spark, path, root, "s1", filters={"uf": "am"})["filters_json"] == '{"uf": "AM"}'
    same = LK.register_parquet(spark, path, root, resource_version="v7")
    assert LK.register_parquet(spark, copy, root, resource_version="v7")["batch_id"] == same["batch_id"]
    bad = os.path.join(tmpdir_path, "bad.parquet")
    spark.createDataFrame([("1", "x")], "cnes string, nu_cpf string").write.parquet(bad)
    with pytest.raises(LK.ContractError, match="nu_cpf"):
        LK.register_parquet(spark, bad, root)
    typed = os.path.join(tmpdir_path, "typed.parquet")
    rows.withColumn("leitos_sus", F.col("leitos_sus").cast("string")).write.parquet(typed)
    with pytest.raises(LK.ContractError, match="leitos_sus: string instead of bigint"):
        LK.register_parquet(spark, typed, root)


def _zip(folder, competence, members):
    path = os.path.join(folder, f"base_de_dados_cnes_{competence}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for name, lines in members:
            zf.writestr(name, ("\r\n".join(lines) + "\r\n").encode("latin-1"))
    return path


def test_members_with_odd_names_breaks_in_quotes_and_other_columns(spark, tmpdir_path):
    tables = {**RELEASE, "tbMunicipio": ["NO_MUNICIPIO;CO_SIGLA_ESTADO;CO_MUNICIPIO;X", '"SÃO ""JOÃO"";\nDO SUL";AM;130260;z']}
    odd = [(f"dir/{'_'.join(n)}_v2-{'202501'}.CSV", lines) for n, lines in tables.items()]
    archive = _zip(tmpdir_path, "202501", [*odd, ("readme.txt", ["x"]), ("/abs/tbMunicipio202501.csv", ["x"])])
    found = AR.land_releases(spark, [archive], os.path.join(tmpdir_path, "landing"))
    assert found["municipio"].first()["nome"] == 'SÃO "JOÃO";\nDO SUL'
    assert found["municipio"].columns == ["codigo", "nome", "uf", "competencia"]
    r = normalize_release(found).first()
    assert (r["leitos_existentes"], r["uf"]) == (100, "AM")


def test_archives_with_missing_duplicate_or_broken_members_are_refused(spark, tmpdir_path):
    def folder(name):
        os.makedirs(path := os.path.join(tmpdir_path, name))
        return path

    whole = [(f"{n}202501.csv", lines) for n, lines in RELEASE.items()]
    twice = _zip(folder("a"), "202501", [*whole, ("TB-LEITO-202501.csv", RELEASE["tbLeito"])])
    with pytest.raises(AR.ArchiveError, match="duplicadas.*leito"):
        AR.check_archives(spark, [twice])
    with pytest.raises(AR.ArchiveError, match="faltando.*municipio"):
        AR.check_archives(spark, [_zip(folder("b"), "202501", [m for m in whole if "Municipio" not in m[0]])])
    with pytest.raises(AR.ArchiveError, match="faltando"):  # members of another month
        AR.check_archives(spark, [_zip(folder("c"), "202502", whole)])
    good = _zip(folder("d"), "202501", whole)
    with pytest.raises(AR.ArchiveError, match="more than 10 bytes"):
        AR.check_archives(spark, [good], max_bytes=10)
    with pytest.raises(AR.ArchiveError):
        AR.check_archives(spark, [os.path.join(tmpdir_path, "other.zip")])
    ragged = dict(whole) | {"tbLeito202501.csv": ["CO_LEITO;DS_LEITO;CO_TIPO_LEITO", "L1;x"]}
    with pytest.raises(Exception, match="row 2 has 2 fields"):
        AR.land_releases(spark, [_zip(folder("e"), "202501", ragged.items())], os.path.join(tmpdir_path, "l"))


def test_one_input_partition_per_member(spark, tmpdir_path):
    archives = []
    for c in ("202501", "202502", "202503"):
        archives.append(_zip(tmpdir_path, c, [(f"{n}{c}.csv", lines) for n, lines in RELEASE.items()]))
    rows = AR.read_table(spark, archives, "leitos")
    assert rows.rdd.getNumPartitions() == 3 and rows.count() == 9
    assert {r.competencia for r in rows.collect()} == {"202501", "202502", "202503"}


def test_annual_archive_holds_one_csv(spark, tmpdir_path):
    path = _zip(tmpdir_path, "202500", [("Leitos_2025.csv", ["COMP;UF;MUNICÍPIO", "202501;AM;MANAUS"]), ("leia.txt", ["x"])])
    df = AR.read_annual(spark, [path])
    assert df.columns == ["COMP", "UF", "MUNICÍPIO"] and df.collect()[0].asDict() == {"COMP": "202501", "UF": "AM", "MUNICÍPIO": "MANAUS"}
    with pytest.raises(Exception, match="2 CSV members"):
        AR.read_annual(spark, [_zip(tmpdir_path, "202599", [("a.csv", ["A"]), ("b.csv", ["B"])])]).count()


def test_fetch_with_filters_verifies_bytes_and_rows(spark, tmpdir_path):
    from regilake.plans.release_ingest import fetch_releases
    archive = _write_release(tmpdir_path, "202501")
    root, landing = os.path.join(tmpdir_path, "lake"), os.path.join(tmpdir_path, "landing")
    everything = fetch_releases(spark, [archive], root, landing)[0]
    chosen = fetch_releases(spark, [archive], root, landing, {"uf": "am", "min_leitos": 100, "municipio": "Manáus"})[0]
    none = fetch_releases(spark, [archive], root, landing, {"uf": "SP"})[0]
    assert (everything["accepted_count"], chosen["accepted_count"], none["accepted_count"]) == (1, 1, 0)
    assert chosen["filters_json"] == '{"min_leitos": 100, "municipio": "Manáus", "uf": "AM"}'
    assert len({e["batch_id"] for e in (everything, chosen, none)}) == 3
    os.utime(archive)  # another time, same bytes: nothing to do
    assert fetch_releases(spark, [archive], root, landing, {"min_leitos": 100, "municipio": "Manáus", "uf": "AM"}) == []
    shutil.rmtree(os.path.join(LK.facilities_path(root), "competencia=202501", f"batch_id={everything['batch_id']}"))
    again = fetch_releases(spark, [archive], root, landing)  # catalogued, but its rows are gone
    assert again[0]["batch_id"] == everything["batch_id"] and again[0]["accepted_count"] == 1
    _write_release(tmpdir_path, "202501", {"rlEstabComplementar": ["CO_UNIDADE;CO_LEITO;QT_EXIST;QT_SUS", "U1;L1;31;20"]})
    assert fetch_releases(spark, [archive], root, landing)[0]["batch_id"] != everything["batch_id"]


def test_many_files_load_in_as_many_jobs_as_one(spark, tmpdir_path):
    from regilake.plans.load import load_csv_files
    head = "CNES,COMPETENCIA,NOME_FANTASIA,LEITOS_EXISTENTES,LEITOS_SUS\n"
    paths = [_csv(tmpdir_path, f"f {i}.csv", (head + f"{i:07d},202401,U{i},{i},1\n" * (1 + i % 2) + ",202401,x,1,1\n").encode()) for i in range(6)]
    paths.append(_csv(tmpdir_path, "same.csv", open(paths[0], "rb").read()))
    bad = [_csv(tmpdir_path, "nocode.csv", b"A,B\n1,2\n"), _csv(tmpdir_path, "empty.csv", b"")]
    tracker = spark.sparkContext.statusTracker()

    def jobs(files, name):
        spark.sparkContext.setJobGroup(name, name)
        out = load_csv_files(spark, files, os.path.join(tmpdir_path, name))
        n = len(tracker.getJobIdsForGroup(name))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n, {os.path.basename(r["path"]): r for r in out}

    one, _ = jobs(paths[1:2], "one")
    many, got = jobs(paths + bad, "many")
    assert many <= one + 2
    assert "error" in got["nocode.csv"] and "error" in got["empty.csv"]
    assert got["f 0.csv"]["batch_id"] == got["same.csv"]["batch_id"] and got["same.csv"]["reused"]
    assert [got[f"f {i}.csv"]["rows_ignored"] for i in range(6)] == [0, 1, 0, 1, 0, 1]
    assert got["f 1.csv"]["rejection_reasons"] == '{"cnes_ausente":1}' and got["f 1.csv"]["rows_read"] == 3
    lake = LK.read_lake(spark, os.path.join(tmpdir_path, "many"))
    assert lake.count() == 6 and LK.read_catalog(spark, os.path.join(tmpdir_path, "many")).count() == 6
    assert load_csv(spark, [paths[2]], os.path.join(tmpdir_path, "many"))["reused"]  # the same id as loaded alone


def test_normalize_csv_reports_empty_and_derived(spark, tmpdir_path):
    from regilake.plans.normalize import normalize_csv
    out = normalize_csv(spark, [os.path.join(FIX, "incomplete.csv")], os.path.join(tmpdir_path, "n"))
    assert out["registros"] == 1
    assert "nome_fantasia" in out["campos_vazios"] and "cnes" not in out["campos_vazios"]
    assert "convenio_sus" in out["campos_derivados"]


def _csv(folder, name, data: bytes):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_sniffing_many_files_matches_each_alone(spark, tmpdir_path):
    from regilake.sources import csv_files as CF
    paths = [os.path.join(tmpdir_path, f"f {i}.csv") for i in range(5)]
    for i, p in enumerate(paths):
        shutil.copy(os.path.join(FIX, "valid.csv" if i % 2 else "invalid_rows.csv"), p)
    assert CF.sniff_many(spark, paths) == {p: CF.sniff(spark, p) for p in paths}


def test_encoding_is_decided_from_the_whole_file(spark, tmpdir_path):
    from regilake.sources import csv_files as CF
    line = "1234567,Unidade,São Luís\n"
    head = "CNES,NOME_FANTASIA,MUNICIPIO\n"
    pad = head + "x" * (65_535 - len(head)) + "é\n" + line  # the letter straddles byte 65,536
    assert CF.sniff(spark, _csv(tmpdir_path, "u.csv", pad.encode())).encoding == "UTF-8"
    late = (head + "1,a,b\n" * 20_000).encode() + line.encode("latin-1")
    assert CF.sniff(spark, _csv(tmpdir_path, "l.csv", late)).encoding == "ISO-8859-1"
    with pytest.raises(CF.CsvLoadError):
        CF.sniff(spark, _csv(tmpdir_path, "e.csv", b""))


def test_quoted_delimiters_quotes_and_line_breaks(spark, tmpdir_path):
    from regilake.sources import csv_files as CF
    data = ('CNES,NOME_FANTASIA,MUNICIPIO,UF\n'
            '1111111,"HOSPITAL ""SAO"" JOAO, LTDA",A,SP\n'
            '2222222,"DUAS\nLINHAS",B,SP\n3333333,SIMPLES,C,SP\n')
    (dialect, df), = CF.read_raw(spark, [_csv(tmpdir_path, "q.csv", data.encode())])
    assert dialect.quoted_breaks
    got = {r["CNES"]: (r["NOME_FANTASIA"], r["MUNICIPIO"]) for r in df.collect()}
    assert got == {"1111111": ('HOSPITAL "SAO" JOAO, LTDA', "A"), "2222222": ("DUAS\nLINHAS", "B"),
                   "3333333": ("SIMPLES", "C")}


def test_months_with_other_headers_and_without_the_optional_table(spark, tmpdir_path):
    other = dict(RELEASE)
    other["rlEstabComplementar"] = [";".join(reversed(line.split(";")))
                                    for line in RELEASE["rlEstabComplementar"]]
    first = _write_release(tmpdir_path, "202501")
    second = _write_release(tmpdir_path, "202502", other)
    clean = os.path.join(tmpdir_path, "clean")
    os.makedirs(clean)
    target = os.path.join(clean, os.path.basename(second))
    with zipfile.ZipFile(second) as src, zipfile.ZipFile(target, "w") as dst:
        for info in src.infolist():
            if not info.filename.startswith("tbTipoLeito"):
                dst.writestr(info, src.read(info))
    landing = os.path.join(tmpdir_path, "landing3")
    rows = {r["competencia"]: r for r in normalize_release(AR.land_releases(spark, [first, target], landing)).collect()}
    assert set(rows) == {"202501", "202502"}
    for r in rows.values():
        assert (r["leitos_existentes"], r["leitos_sus"], r["uf"]) == (100, 60, "AM")
        assert (r["leitos_cirurgicos"], r["leitos_clinicos"], r["leitos_complementares"]) == (30, 40, 30)


def test_free_text_competence_is_rejected(spark, tmpdir_path):
    from regilake.plans.load import plan_csv_load
    data = "CNES,COMPETENCIA,LEITOS_EXISTENTES,LEITOS_SUS\n1111111,LIXO QUALQUER,1,1\n2222222,2024/05,1,1\n"
    rows = plan_csv_load(spark, [_csv(tmpdir_path, "c.csv", data.encode())]).validated.collect()
    assert {r["cnes"]: r["reject_reason"] for r in rows} == {"1111111": "valor_invalido", "2222222": None}


def test_only_a_missing_catalog_reads_as_empty(spark, tmpdir_path):
    assert LK.catalog_if_any(spark, os.path.join(tmpdir_path, "none")).count() == 0
    root = os.path.join(tmpdir_path, "broken")
    os.makedirs(LK.catalog_path(root))
    _csv(LK.catalog_path(root), "part-0.parquet", b"no parquet file")
    with pytest.raises(Exception):
        LK.catalog_if_any(spark, root).count()
