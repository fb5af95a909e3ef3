"""The journal folded backwards against the versions that were published."""

from pyspark.sql import functions as F

from keepsake.operators import history, ledger
from test_ledger import claims, no_flags, no_names, writes


def at(n):
    return F.timestamp_seconds(F.lit(1_710_000_000 + n))


def test_every_version_comes_back(spark, tmp_path):
    held = ledger.Ledger(spark, str(tmp_path / "s"))
    first = claims(spark, [(1, "The build cache expires after 12 hours", "active", 2), (2, "Team lunch is on Tuesday", "aging", 2), (3, "Rent is due", "quarantined", 3), (4, "Old news", "tombstoned", 2)])
    held.commit({"memories": first, "flags": no_flags(spark)})
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id long")

    def step(change):
        out, ops = change(held.table("memories"))
        held.commit({"memories": out}, ops)

    def write(m):
        batch = writes(spark, [(11, "The build cache expires after 48 hours", "fact", 2, False), (12, "team lunch is on tuesday", "", 2, False), (13, "Team lunch IS on Tuesday", "", 2, False)])
        out, _, ops = ledger.applied(ledger.dispositions(batch, m, no_names(spark)), m, no_flags(spark), at(5))
        return out, ops

    def approve(m):
        out, _, ops = ledger.approve(m, no_flags(spark), ids(3), at(9))
        return out, ops

    step(write)
    step(approve)
    step(lambda m: ledger.update_content(m, spark.createDataFrame([(2, "Team lunch is on Friday")], "id long, content string"), "dates", at(12)))
    step(lambda m: ledger.forget(m, ids(1, 2, 11), at(20)))
    step(lambda m: ledger.restore(m, ids(2, 4), at(30)))
    step(lambda m: ledger.set_confidence(m, ids(2), 0.3, at(31)))
    step(lambda m: ledger.set_trust(m, ids(2), 0, at(32)))
    now, journal = held.table("memories"), held.journal().cache()
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    for v in range(1, held.version() + 1):
        assert rows(history.snapshot(now, journal, v)) == rows(held.table("memories", v)), v
    # each point by itself
    points = spark.createDataFrame([(2, 1), (2, 4), (11, 1), (11, 2), (99, 1)], "id long, version int")
    got = {(r["id"], r["version"]): (r["status"], r["content"]) for r in history.as_of(now, journal, points).collect()}
    assert got == {(2, 1): ("aging", "Team lunch is on Tuesday"), (2, 4): ("active", "Team lunch is on Friday"), (11, 2): ("active", "The build cache expires after 48 hours")}
    # all undone: what was there is as it was, what was not is forgotten; and the undoing is undone
    step(lambda m: history.undone(m, journal, 1, at(40)))
    after = held.table("memories")
    assert rows(after.join(first.select("id"), "id", "left_semi")) == rows(first)
    assert {r["status"] for r in after.join(first.select("id"), "id", "left_anti").collect()} == {"tombstoned"}
    assert rows(history.snapshot(after, held.journal(), 8)) == rows(now)
    ops = [(r["op"], r["place"]) for r in history.ops_for(journal, ids(2)).orderBy("place").collect()]
    assert ops == [("reconfirm", 1), ("edit", 2), ("tombstone", 3), ("restore", 4), ("edit", 5), ("edit", 6)]
    shown = history.dossier(now, journal, no_flags(spark), spark.createDataFrame([(1, 1, 11)], "start long, hop int, id long"), spark.createDataFrame([(11, 1, 1)], "start long, hop int, id long"), ids(1)).collect()
    parts = {p: [r["value"] for r in sorted(shown, key=lambda r: r["place"]) if r["part"] == p] for p in ("record", "newer", "older", "op", "flag")}
    assert parts["record"][0] == "content: The build cache expires after 12 hours" and parts["newer"] == ["11"] and parts["older"] == [] and parts["op"] == ["supersede", "tombstone"]
