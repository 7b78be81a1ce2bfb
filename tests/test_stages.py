"""Stage tables and what their plans leave in the driver."""

from corpusloom.plans import stages


def test_a_write_has_the_driver_collect_its_garbage_once_in_a_while(spark, monkeypatch):
    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    own = stages.Stages(spark, "t")
    table = own.write(spark.range(10))
    before = collections()
    monkeypatch.setattr(stages, "COLLECT_AFTER", 1000)
    own.write(table)
    assert collections() == before
    monkeypatch.setattr(stages, "COLLECT_AFTER", 0)
    assert own.write(table).count() == 10
    assert collections() > before
