"""The shared folder and spooled tables."""

import os

import pytest

from palimpsest.llm import shared


def test_spooled_tables_keep_their_schema_and_can_be_swept(spark):
    held = shared.spool(spark.range(5).selectExpr("id", "cast(null as string) as s"), "some")
    assert held.count() == 5 and [f.dataType.simpleString() for f in held.schema] == ["bigint", "string"]
    assert shared.spool(spark.range(5).where("id > 9"), "none").count() == 0
    root = shared.shared_root(spark).removeprefix("file://")
    assert os.path.isdir(f"{root}/spool")
    shared.sweep(spark)
    assert spark.sparkContext.applicationId not in os.listdir(f"{root}/spool")


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="share"):
        shared.shared_root(Session)
