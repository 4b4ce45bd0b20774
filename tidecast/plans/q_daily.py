"""Query: the whole daily run on the stand-in inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.plans import daily
from tidecast.plans import inputs as I
from tidecast.plans.q_forecast import chain_dim
from tidecast.plans.q_learn import keys2, seasonal2, segments2, state
from tidecast.plans.q_ledger import ledger
from tidecast.plans.q_profile import schedule_by_entity
from tidecast.plans.registry import query


def run_inputs(spark, sf):
    led = ledger(spark, sf).select("run_date", "entity", "date", "hour", "shift", "pred", "actual", "mode")
    return daily.Inputs(
        txn=I.txn(spark, sf), calendar=I.calendar(spark, sf), ledger=led, booking=I.booking(spark, sf),
        schedule=schedule_by_entity(spark, sf), chain_dim=chain_dim(spark, sf), keys=keys2(spark, sf),
        segments=segments2(spark, sf), seasonal=seasonal2(spark, sf), entity_state=state(spark, sf),
    )


@query("run_daily")
def run_daily(spark, sf):
    out = daily.run(run_inputs(spark, sf), I.AS_OF)
    return out.where(F.col("run_date") == F.lit(I.AS_OF).cast("date")).select("run_date", "entity", "date", "shift", "pred", "mode")
