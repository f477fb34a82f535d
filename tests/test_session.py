"""Scoped work folders: nothing is left, whatever happens inside."""

import os
import uuid

import pytest
from compare import TESTDATA
from pyspark.sql import functions as F

from tallyframe import plans
from tallyframe.session import SCOPE_PREFIX, checkpoint_folder, checkpointed, remove_abandoned, work_scope

FOLDER = str(TESTDATA / "sf0.001")


def local(folder):
    return folder.removeprefix("file:")


def scopes(spark):
    return [n for n in os.listdir(local(checkpoint_folder(spark))) if n.startswith(SCOPE_PREFIX + spark.sparkContext.applicationId)]


@pytest.mark.parametrize("name", ["a6_parquet_manifest", "f1_total_ranking", "m2_additive_prediction"])
def test_folder_is_empty_after_a_query(spark, name):
    outside = set(os.listdir(local(checkpoint_folder(spark))))
    with work_scope(spark) as folder:
        assert checkpoint_folder(spark) == folder
        want = sorted(map(str, plans.QUERIES[name](spark, FOLDER).collect()))
        assert os.listdir(local(folder))
    assert not os.path.exists(local(folder))
    now = set(os.listdir(local(checkpoint_folder(spark)))) - outside
    assert len(now) <= 1 and not any(os.listdir(f"{local(checkpoint_folder(spark))}/{n}") for n in now)
    assert sorted(map(str, plans.QUERIES[name](spark, FOLDER).collect())) == want


def test_folder_goes_after_a_failure_and_scopes_nest(spark):
    with pytest.raises(ZeroDivisionError):
        with work_scope(spark) as outer:
            held = checkpointed(spark.range(5))
            with work_scope(spark) as inner:
                assert inner.startswith(outer) and checkpointed(spark.range(3)).count() == 3
            assert not os.path.exists(local(inner)) and checkpoint_folder(spark) == outer and held.count() == 5
            assert checkpointed(held.where("id > 2")).count() == 2
            raise ZeroDivisionError
    assert not os.path.exists(local(outer)) and scopes(spark) == []
    assert checkpointed(spark.range(4)).agg(F.sum("id")).first()[0] == 6


def test_scopes_of_a_killed_run_are_removed(spark):
    root = local(checkpoint_folder(spark))
    old, fresh = (f"{root}/{SCOPE_PREFIX}local-{n}-{uuid.uuid4().hex}" for n in (1, 2))
    for folder in (old, fresh):
        os.makedirs(f"{folder}/part")
    for folder in (f"{old}/part", old):
        os.utime(folder, (1, 1))
    with work_scope(spark) as mine:
        os.utime(local(mine), (1, 1))
        removed = [local(f) for f in remove_abandoned(spark, 24)]
        assert old in removed and fresh not in removed and not os.path.exists(old)
        assert os.path.exists(local(mine)) and os.path.exists(fresh)
    with pytest.raises(ValueError, match="running"):
        remove_abandoned(spark, 0)
    os.rmdir(f"{fresh}/part")
    os.rmdir(fresh)
