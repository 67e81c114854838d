import os

import pytest

from folioflux.llm import shared
from folioflux.llm.spelling import group_variants


def folders(spark):
    base = shared.shared_folder(spark).removeprefix("file://") + "/folioflux"
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_a_scratch_block_leaves_no_tables_behind(spark):
    df = spark.createDataFrame([(1, "several wordss several words " * 9)], "doc_id long, text string")
    before = folders(spark)
    with shared.scratch(spark):
        rows = group_variants(df).collect()
        assert folders(spark) - before
    assert rows and folders(spark) == before
    kept = shared.written(df, "kept")
    with pytest.raises(ZeroDivisionError), shared.scratch(spark):
        shared.written(df, "gone")
        1 / 0
    assert {x.split("-")[0] for x in folders(spark) - before} == {"kept"} and kept.count() == 1
