import datetime as dt

from slotwise.plans import tasks
from slotwise.sources import star


def test_matches_of_one_key_are_held_where_they_can_spill(spark, tmp_path, monkeypatch):
    """With many order lines a merge join keeps few matches of a key outside of managed memory."""
    monkeypatch.setattr(tasks, "TASK_ROWS", 50)
    lines = [(i, 1, 1, "R", "F", dt.datetime(1998, 6, 1)) for i in range(500)]
    spark.createDataFrame(lines, star._SOURCES["lineitem"]).write.parquet(f"{tmp_path}/lineitem.parquet")
    name, own = "spark.sql.sortMergeJoinExec.buffer.in.memory.threshold", spark.newSession()
    assert star.star_clinic(own, str(tmp_path)).tickets.columns
    assert own.conf.get(name) == "65536"
    chosen = spark.newSession()
    chosen.conf.set(name, "7")
    assert star.star_clinic(chosen, str(tmp_path)).tickets.columns
    assert chosen.conf.get(name) == "7"
