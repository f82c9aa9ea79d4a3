import unicodedata

from pyspark.sql import functions as F

from regilake.functions import text as TX
from regilake.functions.numeric import nonneg_int, try_bigint
from regilake.functions.rules import (code_label, mmyyyy_to_yyyymm,
                                      parse_bool, prefix_any, slash_competence)


def _one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_norm_text_matches_python(spark):
    samples = ["  São  Paulo ", "ÁGUAS\tLINDAS\nde Goiás", "Straße ª º", "Crème brûlée", "İstanbul",
               "naïve café", " NBSP x"]
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    got = [r["r"] for r in df.select(TX.norm_text("v").alias("r")).collect()]
    assert got == [TX.norm_text_py(s) for s in samples]


def test_norm_text_equals_the_rule_for_every_code_point(spark):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["x".join(map(chr, codes[i:i + 64])) for i in range(0, len(codes), 64)] + ["½ ﬁm ｆｕｌｌ ㏂ \ue000ﬃ½", "ﬁ", "\ue000"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string").repartition(4)
    got = {r["i"]: r["r"] for r in df.select("i", TX.norm_text("v").alias("r")).collect()}
    assert [got[i] for i in range(len(texts))] == [TX.norm_text_py(t) for t in texts]


def test_upper_unaccent_keeps_ordinals_and_sharp_s(spark):
    assert _one(spark, TX.upper_unaccent("v"), "pediátrica ª ß") == "PEDIATRICA ª ẞ"


def test_norm_column_name():
    assert TX.norm_column_name("CONVÊNIO SUS") == "CONVENIO_SUS"
    assert TX.norm_column_name(" Município ") == "MUNICIPIO"
    assert unicodedata.is_normalized("NFC", TX.norm_column_name("ç"))


def test_try_bigint_lenient(spark):
    cases = {"30": 30, " 30.5 ": 31, "1e2": 100, "abc": None, "": None, "-4": -4, "1_000": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["r"] for r in df.select("v", try_bigint("v").alias("r")).collect()}
    assert got == cases


def test_nonneg_int_rules(spark):
    value, ok = nonneg_int("v")
    cases = {"": (0, True), "12,7": (12, True), "-0.5": (0, True), "-3": (-3, False),
             "abc": (None, False), "inf": (None, False), "1d": (None, False)}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: (r["x"], r["ok"]) for r in df.select("v", value.alias("x"), ok.alias("ok")).collect()}
    assert got == cases


def test_parse_bool(spark):
    value, ok = parse_bool("v")
    cases = {"Sim": True, "NÃO": None, "não": False, "n": False, "": True, "talvez": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["x"] for r in df.select("v", value.alias("x")).collect()}
    # Upper-case accented NÃO lower-cases to não -> False.
    cases["NÃO"] = False
    assert got == cases


def test_labels_and_prefix(spark):
    assert _one(spark, code_label("v"), "1") == "INDIVIDUAL"
    assert _one(spark, code_label("v"), " 2 ") == "2"
    assert _one(spark, TX.join_label(F.lit("05"), F.col("v")), "Hospital Geral") == "05 - Hospital Geral"
    assert _one(spark, TX.join_label(F.lit(""), F.col("v")), "X") == "X"
    assert _one(spark, prefix_any("v", ["2062", "3999"]), " 2062-x") is True
    assert _one(spark, prefix_any("v", ["2062"]), "") is False


def test_competence_helpers(spark):
    assert _one(spark, mmyyyy_to_yyyymm("v"), "012024") == "202401"
    assert _one(spark, slash_competence("v"), "2026/07") == "202607"


def test_qualifications_cover_their_months(spark):
    from regilake.sources.release import qualification_rows
    spells = spark.createDataFrame([("1", "a", "012024", "999999"), ("1", "b", "012024", "122024"), ("2", "a", "022025", "999999"),
                                    ("3", "a", "2024", "999999"), ("4", "a", "012020", "x"), ("5", "a", "012025", "012025")],
                                   "co_unidade string, codigo string, inicio string, fim string")
    names = spark.createDataFrame([("a", "A"), ("b", " ")], "codigo string, descricao string")
    months = spark.createDataFrame([("202412",), ("202501",), ("202501",), ("x",)], "competencia string")
    got = {(r.competencia, r.co_unidade, r.descricao) for r in qualification_rows(spells, names, months).collect()}
    assert got == {("202412", "1", "A"), ("202501", "1", "A"), ("202412", "1", "b"), ("202501", "5", "A")}
