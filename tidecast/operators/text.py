"""Texts for prompts, parsing of model answers, example pairs for tuning a model."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.operators import facts
from tidecast.operators.features import slide_pairs

ANSWER = "array<struct<date:string,forecast:double>>"


def _day_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def history(day: DataFrame, cal: DataFrame, n: int = 21) -> DataFrame:
    """Last ``n`` days of each entity as lines; rows are limited before they are collected."""
    rn = F.row_number().over(W.partitionBy("entity").orderBy(F.desc("date")))
    recent = day.withColumn("rn", rn).where(F.col("rn") <= n).join(F.broadcast(cal.select("date", "is_holiday")), "date", "left")
    line = F.concat(
        F.lit("- "), F.col("date").cast("string"), F.lit(" ("), _day_name(F.col("date")), F.lit("): "), F.col("guests").cast("int").cast("string"),
        F.when(F.col("is_holiday"), " HOLIDAY").otherwise(""),
    )
    lines = F.transform(F.sort_array(F.collect_list(F.struct("date", line.alias("line")))), lambda x: x["line"])
    return recent.groupBy("entity").agg(F.array_join(lines, "\n").alias("text"))


def prompt(day: DataFrame, profile: DataFrame, ref: str) -> DataFrame:
    """Profile line, weekday means of the last 30/60/90 days and the last seven days."""
    means = facts.window_mean(day, ref)
    long = means.unpivot(["entity", "weekday"], ["mean_30d", "mean_60d", "mean_90d"], "span", "mean").where("mean is not null and mean <> 0")
    order = F.array_position(F.array(*[F.lit(w) for w in facts.WEEKDAYS]), F.col("weekday"))
    line = F.concat(F.col("span"), F.lit(" "), F.col("weekday"), F.lit(": ~"), F.floor("mean").cast("string"))
    block = F.transform(F.sort_array(F.collect_list(F.struct("span", order.alias("o"), line.alias("line")))), lambda x: x["line"])
    windows = long.groupBy("entity").agg(F.array_join(block, "\n").alias("windows"))
    rn = F.row_number().over(W.partitionBy("entity").orderBy(F.desc("date")))
    last = day.withColumn("rn", rn).where(F.col("rn") <= 7)
    dl = F.concat(F.col("date").cast("string"), F.lit(": "), F.col("guests").cast("int").cast("string"))
    days = F.transform(F.sort_array(F.collect_list(F.struct("date", dl.alias("line")))), lambda x: x["line"])
    last = last.groupBy("entity").agg(F.array_join(days, "\n").alias("last_days"))
    head = F.concat_ws(", ", "category", "strategy", "trend", F.concat(F.lit("active days "), F.col("active_days").cast("string")))
    p = profile.select("entity", head.alias("head"))
    return (
        p.join(last, "entity").join(windows, "entity", "left")
        .select("entity", F.concat_ws("\n", F.lit("PROFILE"), "head", F.lit("WEEKDAY MEANS"), "windows", F.lit("LAST 7 DAYS"), "last_days").alias("text"))
    )


def state_context(state: DataFrame, keys: DataFrame) -> DataFrame:
    """What was learned about an entity, as lines: bias, weekdays, holidays, factor."""
    n = lambda c: F.bround(F.abs(c), 0).cast("int").cast("string")
    wd = keys.where("scope = 'weekday' and abs(value) >= 3")
    rn = F.row_number().over(W.partitionBy("entity").orderBy(F.desc(F.abs("value")), "key"))
    wl = F.concat(F.col("key"), F.lit(": "), F.when(F.col("value") > 0, "reduce").otherwise("increase"), F.lit(" by "), n(F.col("value")))
    days = wd.withColumn("rn", rn).where("rn <= 4").groupBy("entity").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", wl.alias("l")))), lambda x: x["l"]), "; ").alias("days"))
    hol = keys.where("scope = 'holiday' and abs(value) >= 3").select("entity", F.col("value").alias("hol"))
    j = state.join(days, "entity", "left").join(hol, "entity", "left")
    b, m = F.col("overall_bias"), F.col("last_mape")
    lines = F.array_compact(F.array(
        F.when(F.abs(b) >= 2, F.concat(F.lit("forecasts are "), F.when(b > 0, "high").otherwise("low"), F.lit(" by "), n(b))),
        F.concat(F.lit("weekdays: "), F.col("days")),
        F.when(F.col("hol").isNotNull(), F.concat(F.lit("holidays are "), F.when(F.col("hol") > 0, "high").otherwise("low"), F.lit(" by "), n(F.col("hol")))),
        F.when(m > 0, F.concat(F.lit("accuracy is "), F.when(m < 15, "good").when(m < 30, "moderate").otherwise("poor"))),
        F.when(F.abs(F.col("correction_factor") - 1) >= 0.05, F.concat(F.lit("scale forecasts "), F.when(F.col("correction_factor") > 1, "up").otherwise("down"))),
    ))
    return j.select("entity", F.array_join(lines, "\n").alias("text"))


def holiday_guide(impacts: DataFrame) -> DataFrame:
    """Calibrated factors as one guide text: range of percent changes per type and phase."""
    pct = lambda c: F.bround((c - 1) * 100, 0).cast("int").cast("string")
    g = impacts.groupBy("holiday_type", "phase").agg(F.min("impact").alias("lo"), F.max("impact").alias("hi"), F.count("*").alias("n"))
    line = F.concat(F.lit("- "), F.col("holiday_type"), F.lit(" "), F.col("phase"), F.lit(": "), pct(F.col("lo")), F.lit("% to "), pct(F.col("hi")), F.lit("% ("), F.col("n").cast("string"), F.lit(" days)"))
    return g.agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))


def parse_answer(df: DataFrame, col: str) -> DataFrame:
    """Rows (date, forecast) of the first JSON array inside free text; texts without a
    readable array give single objects, else nothing."""
    t = F.col(col)
    arr = F.from_json(F.regexp_extract(t, r"(?s)\[.*\]", 0), ANSWER)
    objs = F.transform(F.regexp_extract_all(t, F.lit(r"(\{[^{}]+\})"), F.lit(1)), lambda o: F.from_json(o, "date string, forecast double"))
    objs = F.filter(objs, lambda o: o["date"].isNotNull() & o["forecast"].isNotNull())
    got = F.when(F.size(F.coalesce(arr, F.array().cast(ANSWER))) > 0, arr).otherwise(objs)
    return df.withColumn("__a", got).select(*df.columns, F.inline("__a"))


# -- example pairs ----------------------------------------------------------------------------


class PairTemplate(NamedTuple):
    """Wording and marks of an example pair; the days asked for are rows of the same table."""

    system: str = 'The table lists the guests of one site per day. Replace every "?" and reply with a JSON list of {"date", "forecast"} only.'
    site: str = "site;"
    tendency: str = "earlier forecasts were "
    high: str = "too high"
    low: str = "too low"
    header: str = "date;day;guests;kind"
    asked: str = "?"
    holiday: str = "H"
    weekend: str = "W"
    turn: str = "<|im_start|>%s\n"
    end: str = "<|im_end|>"


def pairs(
    day: DataFrame, cal: DataFrame, min_rows: int = 100, state: DataFrame | None = None, template: PairTemplate | None = None
) -> DataFrame:
    """Chat examples: 14 days of history to the next 7 days, for every entity with 21 days or more.
    A history of fewer than ``min_rows`` days over all entities gives none."""
    t = template or PairTemplate()
    enough = day.agg((F.count("*") >= min_rows).alias("enough"))
    s = slide_pairs(day.where(enough.scalar()))
    s = s.withColumn("__hol", cal.where("is_holiday").agg(F.collect_set("date").alias("h")).scalar())
    count = lambda x: x["guests"].cast("int").cast("string")

    def row(x, guests):
        kind = F.concat(
            F.when(F.array_contains(F.col("__hol"), x["date"]), t.holiday).otherwise(""),
            F.when(F.weekday(x["date"]) >= 5, t.weekend).otherwise(""),
        )
        return F.concat_ws(";", x["date"].cast("string"), F.substring(_day_name(x["date"]), 1, 3), guests, kind)

    rows = F.concat(F.transform("history", lambda x: row(x, count(x))), F.transform("target", lambda x: row(x, F.lit(t.asked))))
    note = F.lit(None).cast("string")
    if state is not None:
        s = s.join(state.select("entity", F.col("overall_bias").alias("__b")), "entity", "left")
        side = F.when(F.col("__b") > 0, t.high).otherwise(t.low)
        note = F.when(F.abs("__b") > 2, F.concat(F.lit(t.tendency), side))
    user = F.concat_ws("\n", F.concat(F.lit(t.site), F.col("entity")), note, F.lit(t.header), F.array_join(rows, "\n"))
    one = lambda x: F.concat(F.lit('{"date": "'), x["date"].cast("string"), F.lit('", "forecast": '), count(x), F.lit("}"))
    reply = F.concat(F.lit("["), F.array_join(F.transform("target", one), ", "), F.lit("]"))
    said = {"system": F.lit(t.system), "user": user, "assistant": reply}
    turns = [F.concat(F.lit(t.turn % role), c, F.lit(t.end)) for role, c in said.items()]
    return s.select(
        "entity", F.concat_ws("\n", *turns).alias("text"),
        F.element_at("history", -1)["date"].alias("history_end"), F.element_at("target", 1)["date"].alias("forecast_start"),
        F.element_at("target", -1)["date"].alias("forecast_end"),
        F.aggregate("target", F.lit(0.0), lambda a, x: a + x["guests"]).cast("long").alias("target_total"),
    )


#: Letters behind the common beginning of all names by which a date's rows are counted.
CELL_LETTERS = 3


def split_pairs(examples: DataFrame, share: float) -> DataFrame:
    """Chronological train/eval flag, entities in order within a date.

    The cut date is found on counts per start date (bounded by the calendar). Its rows are then
    counted by the first letters in which its entities differ, and the place of the cut among these
    counts is known; only rows with the same letters are ordered, side by side with others.
    """
    counts = examples.groupBy("forecast_start").agg(F.count("*").alias("k"))
    w = W.orderBy("forecast_start")
    c = counts.withColumns({"upto": F.sum("k").over(w), "total": F.sum("k").over(W.partitionBy())})
    n = F.floor(F.col("total") * share)
    cut = F.when(F.col("total") > 1, F.greatest(F.lit(1), F.least(n, F.col("total") - 1))).otherwise(F.col("total"))
    c = c.select("forecast_start", (cut - (F.col("upto") - F.col("k"))).alias("take"), "k")
    j = examples.join(F.broadcast(c), "forecast_start")
    whole = j.where("take <= 0 or take >= k").withColumn("part", F.when(F.col("take") <= 0, "eval").otherwise("train"))
    edge = j.where("take > 0 and take < k")
    # what the least and the greatest name have in common, all names have
    ends = edge.agg(F.min("entity").alias("a"), F.max("entity").alias("b"))
    same = F.sequence(F.lit(1), F.greatest(F.length("a"), F.lit(1)))
    common = F.size(F.filter(same, lambda i: F.substring(F.col("a"), F.lit(1), i) == F.substring(F.col("b"), F.lit(1), i)))
    edge = edge.withColumn("__skip", ends.select(F.coalesce(common, F.lit(0))).scalar())
    edge = edge.withColumn("__cell", F.substring(F.col("entity"), F.lit(1), F.col("__skip") + CELL_LETTERS))
    cells = edge.groupBy("__cell").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.orderBy("__cell").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__n")
    cells = cells.select("__cell", before.alias("__before"))  # a row per cell
    rn = F.col("__before") + F.row_number().over(W.partitionBy("__cell").orderBy("entity"))
    edge = edge.join(cells, "__cell").withColumn("part", F.when(rn <= F.col("take"), "train").otherwise("eval"))
    return whole.unionByName(edge.select(*whole.columns)).drop("take", "k")


def evaluate_answers(truth: DataFrame, answers: DataFrame) -> DataFrame:
    """Parse rate and errors of model answers. truth: id, date, forecast; answers: id, answer."""
    p = parse_answer(answers, "answer").groupBy("id", "date").agg(F.min("forecast").alias("predicted"))
    parsed = p.select("id").distinct().withColumn("ok", F.lit(1))
    rate = answers.join(parsed, "id", "left").agg(F.count("*").alias("samples"), (F.coalesce(F.sum("ok"), F.lit(0)) / F.count("*") * 100).alias("parse_rate"))
    t = truth.withColumn("date", F.col("date").cast("string")).join(p, ["id", "date"]).where("forecast > 0")
    e = F.abs(F.col("predicted") - F.col("forecast"))
    pct = t.select(e.alias("e"), (e / F.col("forecast") * 100).alias("pct"), F.lit("all").alias("scope"))
    from tidecast.functions.stats import grouped_quantiles

    m = pct.groupBy("scope").agg(F.avg("pct").alias("avg_mape"), F.avg("e").alias("avg_mae"), F.count("*").alias("days"))
    q = grouped_quantiles(pct, ["scope"], "pct", {"median_mape": 0.5})
    return rate.withColumn("scope", F.lit("all")).join(m, "scope", "left").join(q, "scope", "left").drop("scope")
