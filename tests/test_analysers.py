"""External analysers as a table function."""

import os
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql.types import StructType

from corpora.operators import profile

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see this module
SCHEMA = StructType().add("k", "long").add("n", "integer").add("batch", "integer")


class Counting:
    """Leaves a file for each start and each close; tells the size of the batch it got."""

    def __init__(self, folder):
        self.folder, self.name = folder, uuid.uuid4().hex
        open(f"{folder}/started-{self.name}", "w").close()

    def analyse(self, batch):
        return [(row["k"], len(row["text"] or ""), len(batch)) for row in batch]

    def close(self):
        open(f"{self.folder}/closed-{self.name}", "w").close()


def test_one_start_for_each_partition(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(i, None if i == 3 else "x" * i) for i in range(25)]
    docs = spark.createDataFrame(rows, "k long, text string").coalesce(1)
    got = profile.analyse_by_table_function(docs, lambda: Counting(folder), SCHEMA, batch_size=10).collect()
    assert sorted((r.k, r.n) for r in got) == [(i, 0 if i == 3 else i) for i in range(25)]
    assert sorted(r.batch for r in got) == [5] * 5 + [10] * 20
    files = os.listdir(folder)
    started, closed = ({f.split("-")[1] for f in files if f.startswith(w)} for w in ("started", "closed"))
    assert len(started) == 1 and started == closed


def test_every_partition_has_its_own(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.range(0, 400, 1, 4).selectExpr("id as k", "cast(id as string) as text", "1 as extra")
    got = profile.analyse_by_table_function(docs, lambda: Counting(folder), SCHEMA).collect()
    assert len(got) == 400 and {r.batch for r in got} == {100}
    assert len([f for f in os.listdir(folder) if f.startswith("started")]) == 4 == len([f for f in os.listdir(folder) if f.startswith("closed")])


def test_missing_columns_fail_when_planned(spark, tmp_path):
    make = profile.analyser_table(lambda: Counting(str(tmp_path)), SCHEMA, ["k", "text"])
    with pytest.raises(Exception, match="not found"):
        make(spark.range(3).asTable()).collect()


def test_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "k long, text string")
    assert profile.analyse_by_table_function(docs, lambda: Counting(str(tmp_path)), SCHEMA).count() == 0
