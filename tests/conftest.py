import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from regilake.schema import LAKE_SCHEMA  # noqa: E402
from regilake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="regilake-tests-", dir="/tmp")
    s = build_session("local[4]", shuffle_partitions=4, extra={
        "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
        "spark.local.dir": scratch,
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    })
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="regilake-t-", dir="/tmp")


def lake_rows(spark, rows, batch_id="B", imported_at="2025-01-01T00:00:00+00:00"):
    """Lake-schema DataFrame from partial dicts (defaults: '' / 0 / NULL / [])."""
    full = []
    for r in rows:
        d = {}
        for f in LAKE_SCHEMA.fields:
            if f.name in r:
                d[f.name] = r[f.name]
            elif f.name in ("habilitacoes", "campos_ausentes"):
                d[f.name] = []
            elif f.name == "municipio_normalizado":
                from regilake.functions.text import norm_text_py
                d[f.name] = norm_text_py(r.get("municipio") or "")
            elif f.name in ("leitos_existentes", "leitos_sus", "total_habilitacoes"):
                d[f.name] = 0
            elif f.name == "convenio_sus":
                d[f.name] = True
            elif not f.nullable:
                d[f.name] = ""
            else:
                d[f.name] = None
        d["batch_id"] = r.get("batch_id", batch_id)
        d["imported_at"] = r.get("imported_at", imported_at)
        full.append(d)
    from pyspark.sql import types as T
    schema = T.StructType(list(LAKE_SCHEMA.fields) + [T.StructField("batch_id", T.StringType()),
                                                       T.StructField("imported_at", T.StringType())])
    return spark.createDataFrame(full, schema)
