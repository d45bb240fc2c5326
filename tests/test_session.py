from types import SimpleNamespace as N

import pytest
from pyspark.sql import functions as F

from tagtide.session import fresh_folder, settled, shared_folder


class Option:
    def __init__(self, value):
        self.value = value

    def isEmpty(self):
        return self.value is None

    def isDefined(self):
        return self.value is not None

    def get(self):
        return self.value


def stub(conf, current, master="local[2]"):
    made = []
    context = N(master=master, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: Option(current))), setCheckpointDir=made.append)
    return N(conf=N(get=lambda key, default: conf), sparkContext=context), made


def test_the_named_folder_is_used():
    session, made = stub("s3a://shared/x", None)
    assert shared_folder(session) == "s3a://shared/x" and made == ["s3a://shared/x"]
    session, made = stub("s3a://shared/x", "s3a://shared/x/1")
    assert shared_folder(session) == "s3a://shared/x" and made == []


def test_a_folder_is_made_only_where_none_is_named():
    session, made = stub(None, "/set/by/hand")
    assert shared_folder(session) == "/set/by/hand" and made == []
    session, made = stub(None, None)
    assert [shared_folder(session)] == made


def test_a_cluster_has_to_name_its_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(stub(None, None, master)[0])


def test_settled_rows_do_not_go_back_to_their_source(spark):
    df = settled(spark.range(5).withColumn("x", F.rand()))
    assert df.collect() == df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "ExistingRDD" in plan
    assert fresh_folder(spark, "a") != fresh_folder(spark, "a")
