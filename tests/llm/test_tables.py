from __future__ import annotations

import os

from tessera.llm import common


def test_written_tables_can_be_released(spark):
    a = common.written(spark.range(5).toDF("x"), "a")
    b = common.written(a.selectExpr("x + 1 as x"), "b")
    path = a._tessera_path
    assert b.count() == 5 and os.path.isdir(path)
    common.discard(a)
    assert not os.path.exists(path) and b.count() == 5
    common.release(spark)
    assert not os.path.exists(b._tessera_path)


def test_fresh_names():
    assert common.fresh("x", ["X", "_x"]) == "__x" and common.fresh("x", ["y"]) == "x"


def test_the_rest_imports_without_this_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['tessera.llm'] = None; import tessera.api, tessera.plans.registry, tessera.streaming.stateful, tessera.sources.fvecs"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_tables_that_are_written_have_executors_collect(spark, monkeypatch):
    runtime = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in runtime if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(common, "SETTLE_S", 0)
    before = full()
    assert common.written(spark.range(3)).count() == 3 and full() > before
    monkeypatch.setattr(common, "SETTLE_S", 3600)
    before = full()
    assert common.written(spark.range(3)).count() == 3 and not common.settle(spark) and full() == before
