from rillflow import checkpoint


def test_large_tables_are_not_broadcast_however_small_their_files(spark):
    many, few = (checkpoint.saved(spark.range(n).selectExpr("id", "id div 100000 as v")) for n in (4 * checkpoint.MANY, 1000))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10485760b", "10485760", "10MB")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(many.join(many.selectExpr("id as v", "v as w").where("w >= 0"), "v"))
    assert "Broadcast" in plan(few.join(few.selectExpr("id as v"), "v"))
