"""The learner model: mastery, analytics, recommendations, plans and an adaptive policy over an event log.

Events are (student, concept, kind, score, difficulty) with an order column. A score makes an event an assessment; without
one it is an exposure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as c


def learner_events(events: DataFrame) -> DataFrame:
    """The events table as a learner log: views are exposures, of other kinds a value of 50 and more counts as correct."""
    difficulty = F.get_json_object("props", "$.k").cast("double") / 100
    score = F.when(F.col("event_type") == "view", F.lit(None)).when(F.col("value") >= 50, 1.0).otherwise(0.0)
    return events.select("event_id", "ts", F.col("user_id").alias("student"), F.col("event_type").alias("concept"), score.alias("score"), F.coalesce(difficulty, F.lit(0.5)).alias("difficulty"))


def updated(mastery: Column, score: Column, difficulty: Column) -> Column:
    """Mastery after one event: an exposure lifts it a little, an assessment draws it to the score, the harder the more."""
    lifted = mastery + c.EXPOSURE_GAIN * (1 - mastery)
    drawn = mastery + c.MASTERY_K * (0.5 + difficulty) * (score - mastery)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(score.isNull(), lifted).otherwise(drawn)))


def update_map(score: Column, difficulty: Column) -> Column:
    """One event's update as a map of mastery m to clamp(a * m + b, low, high)."""
    k = F.when(score.isNull(), F.lit(c.EXPOSURE_GAIN)).otherwise(c.MASTERY_K * (0.5 + difficulty)).cast("double")
    return F.struct((1 - k).alias("a"), (k * F.coalesce(score, F.lit(1.0))).cast("double").alias("b"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))


def _after(f: Column, g: Column) -> Column:
    """The map that does f, then g: such maps are closed under composition, so that a history may be folded in parts."""
    clamp = lambda x: F.least(g["high"], F.greatest(g["low"], x))
    p, q = clamp(g["a"] * f["low"] + g["b"]), clamp(g["a"] * f["high"] + g["b"])
    return F.struct((f["a"] * g["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"), F.least(p, q).alias("low"), F.greatest(p, q).alias("high"))


def folded_map(log: Column | str, step: Callable[[Column], Column]) -> Column:
    """The composition of an array's maps, in order."""
    same = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    return F.aggregate(log, same, lambda f, x: _after(f, step(x)))


def mapped(f: Column, value: Column) -> Column:
    return F.least(f["high"], F.greatest(f["low"], f["a"] * value + f["b"]))


def _part(order: Column, kind: str) -> Column:
    """A part of a history that is dealt by itself: an hour of times, a thousand of numbers; of other types there is one."""
    if kind.startswith("timestamp"):
        return F.date_trunc("hour", order).cast("timestamp")
    return F.floor(order / 1000).cast("bigint") if kind in ("int", "bigint", "double", "float", "smallint") else F.lit(0)


def mastery_maps(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """f (what events do to the mastery before them), events and assessments of each student and concept, events folded in order.

    An hour's events of a key are folded to one map by themselves, then the hours' maps in order: no task holds the whole
    history of a key that has very many events.
    """
    part = _part(F.col(order[0]), events.schema[order[0]].dataType.simpleString()).alias("__part")
    log = F.array_sort(F.collect_list(F.struct(*order, "score", "difficulty")))
    parts = events.groupBy("student", "concept", part).agg(log.alias("log"), F.count("*").alias("events"), F.count("score").alias("assessments"))
    maps = parts.select("student", "concept", "events", "assessments", F.struct("__part", folded_map("log", lambda e: update_map(e["score"], e["difficulty"])).alias("f")).alias("x"))
    whole = maps.groupBy("student", "concept").agg(F.array_sort(F.collect_list("x")).alias("x"), F.sum("events").alias("events"), F.sum("assessments").alias("assessments"))
    return whole.select("student", "concept", folded_map("x", lambda x: x["f"]).alias("f"), "events", "assessments")


def mastery(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """mastery, events and assessments of each student and concept, events folded in order."""
    value = mapped(F.col("f"), F.lit(c.MASTERY_START))
    return mastery_maps(events, order).select("student", "concept", F.round(value, 6).alias("mastery"), "events", "assessments")


def level(value: Column) -> Column:
    return F.when(value < c.WEAK, "weak").when(value >= c.STRONG, "strong").otherwise("middle")


def histogram(masteries: DataFrame) -> DataFrame:
    """Students' concepts in five bins of mastery, the last one closed."""
    return masteries.groupBy(F.least(F.floor(F.col("mastery") * 5), F.lit(4)).cast("int").alias("bin")).agg(F.count("*").alias("concepts"))


def running_accuracy(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Of each scored event the mean score of the student so far."""
    so_far = Window.partitionBy("student").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.where("score IS NOT NULL").select("event_id", "student", F.round(F.avg("score").over(so_far), 6).alias("accuracy"))


def recent_accuracy(events: DataFrame, n: int = 5, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Of each scored event the mean of the last n scores of its student and concept, and how many of n there are."""
    last = Window.partitionBy("student", "concept").orderBy(*order).rowsBetween(1 - n, 0)
    scored = events.where("score IS NOT NULL")
    return scored.select("event_id", "student", "concept", F.round(F.avg("score").over(last), 6).alias("recent"), F.round(F.count("score").over(last) / n, 6).alias("exposure"))


def minutes(kind: Column) -> Column:
    out = F.lit(c.OTHER_MINUTES)
    for name, value in c.MINUTES.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def recommendations(masteries: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """student, kind and concept: practice of weak concepts with fewer than three assessments, review of the others, and of each strong concept the first related one not yet seen.

    related: edges (src, dst). Each strong concept chooses by itself, so two may choose the same, which is listed once.
    """
    weak = masteries.where(F.col("mastery") < c.WEAK).select("student", F.when(F.col("assessments") < 3, "practice").otherwise("review").alias("kind"), "concept", "mastery")
    strong = masteries.where(F.col("mastery") >= c.STRONG).select("student", F.col("concept").alias("src"), "mastery")
    new = strong.join(edges.select("src", "dst"), "src").join(masteries.select("student", F.col("concept").alias("dst")), ["student", "dst"], "left_anti")
    first = new.groupBy("student", "src").agg(F.min("dst").alias("concept"), F.first("mastery").alias("mastery")).groupBy("student", "concept").agg(F.max("mastery").alias("mastery"))
    place = F.row_number().over(Window.partitionBy("student").orderBy(F.desc("mastery"), "concept"))
    explore = first.withColumn("n", place).where(F.col("n") <= most).select("student", F.lit("explore").alias("kind"), "concept", "mastery")
    return weak.unionByName(explore)


def study_plan(masteries: DataFrame, days: int = 10, minutes_a_day: int = 60) -> DataFrame:
    """student, day, concept, activity and minutes: activities of weak concepts, weakest first, each put on the first day from the last one's that has room. Days and activities of one student depend on each other, so each student is planned in turn, many students a batch."""
    shortest = min(c.PLAN_MINUTES.values())

    def plan(student: int, weak: list[dict]) -> Iterator[tuple]:
        left = [minutes_a_day] * days
        for r in sorted(weak, key=lambda r: (r["mastery"], r["concept"] is None, r["concept"])):
            if max(left, default=0) < shortest:
                return
            start, scale = 0, 1 + 0.6 * (1 - r["mastery"])
            for activity, base in c.PLAN_MINUTES.items():
                need = int(round(base * scale)) if activity != "quiz" else base
                day = next((d for d in range(start, days) if left[d] >= need), None)
                if day is None:
                    continue
                left[day] -= need
                yield student, day + 1, r["concept"], activity, need
                start = min(day + 2, days - 1) if activity == "quiz" else day

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32())
        for b in batches:
            for p in range(0, b.num_rows, 512):
                part = b.slice(p, 512)
                rows = [x for student, weak in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for x in plan(student, weak)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["student", "day", "concept", "activity", "minutes"])

    weak = masteries.where(F.col("mastery") < c.WEAK).groupBy(F.col("student").cast("bigint").alias("student")).agg(F.collect_list(F.struct("mastery", "concept")).alias("weak"))
    return weak.mapInArrow(run, "student bigint, day int, concept string, activity string, minutes int")


def plan_statistics(plan: DataFrame) -> DataFrame:
    days = plan.groupBy("student", "day").agg(F.sum("minutes").alias("m"))
    return days.groupBy("student").agg(F.sum("m").alias("minutes"), F.max("m").alias("longest_day"), F.count("*").alias("days"))


def calendar(plan: DataFrame, start: str) -> DataFrame:
    """student and ics: an iCalendar text with an event for each planned day, its first three concepts in the summary."""
    names = F.array_join(F.slice(F.array_sort(F.collect_set("concept")), 1, 3), ", ")
    day = plan.groupBy("student", "day").agg(names.alias("names"), F.sum("minutes").alias("minutes"))
    date = F.date_format(F.date_add(F.to_date(F.lit(start)), F.col("day") - 1), "yyyyMMdd")
    event = F.concat(F.lit("BEGIN:VEVENT\r\nUID:"), F.col("student"), F.lit("-"), F.col("day"), F.lit("@tessera\r\nDTSTART;VALUE=DATE:"), date, F.lit("\r\nSUMMARY:Study: "), F.col("names"), F.lit(" ("), F.col("minutes"), F.lit(" min)\r\nEND:VEVENT"))
    body = day.groupBy("student").agg(F.array_sort(F.collect_list(F.struct("day", event.alias("e")))).alias("events"))
    return body.select("student", F.concat(F.lit("BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//tessera//plan//EN\r\n"), F.array_join(F.transform("events", lambda x: x["e"]), "\r\n"), F.lit("\r\nEND:VCALENDAR\r\n")).alias("ics"))


class LinearBandit:
    """An upper confidence bound policy with a linear model for each arm."""

    def __init__(self, arms: int, width: int, alpha: float = c.BANDIT_ALPHA):
        self.alpha, self.a, self.b = alpha, np.stack([np.eye(width)] * arms), np.zeros((arms, width))

    def values(self, x: np.ndarray, explore: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Means and bonuses of all arms."""
        inverse = np.linalg.inv(self.a)
        mean = np.einsum("kij,kj,i->k", inverse, self.b, x)
        return mean, self.alpha * np.sqrt(np.einsum("i,kij,j->k", x, inverse, x)) * explore

    def select(self, x: np.ndarray, explore: bool = True) -> int:
        return int(np.argmax(sum(self.values(x, explore))))

    def update(self, arm: int, x: np.ndarray, reward: float) -> None:
        self.a[arm] += np.outer(x, x)
        self.b[arm] += reward * x


def reward(correct: Column, gain: Column, seconds: Column, repeat: Column, skipped: Column, forgetting: Column | None = None) -> Column:
    """Correctness and mastery gain, less slowness (30 seconds count in full), repeated mistakes, skipped prerequisites and forgetting."""
    w = (0.4, 1.0, 0.15, 0.3, 0.3)
    lost = F.lit(0.0) if forgetting is None else F.greatest(F.lit(0.0), forgetting)
    return F.round(w[0] * correct + w[1] * gain - w[2] * F.least(F.lit(1.0), seconds / 30) - w[3] * repeat - w[4] * skipped - w[1] * lost, 5)


def difficulty_policy(events: DataFrame) -> DataFrame:
    """student, arm, chosen, mean, bonus and bound: the policy over difficulties that each student's scored events, in order, have taught. One student's events depend on each other; students don't."""

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        bandit, m = LinearBandit(len(c.DIFFICULTIES), 3), c.MASTERY_START
        for r in rows.sort_values(["ts", "event_id"]).itertuples():
            arm = int(np.argmin([abs(d - r.difficulty) for d in c.DIFFICULTIES]))
            after = min(1.0, max(0.0, m + c.MASTERY_K * (0.5 + r.difficulty) * (r.score - m)))
            bandit.update(arm, np.asarray([m, m * m, 1.0]), 0.4 * r.score + (after - m))
            m = after
        mean, bonus = bandit.values(np.asarray([m, m * m, 1.0]))
        best = int(np.argmax(mean + bonus))
        return pd.DataFrame([(rows["student"].iloc[0], k, k == best, round(mean[k], 6), round(bonus[k], 6), round(mean[k] + bonus[k], 6)) for k in range(len(mean))], columns=["student", "arm", "chosen", "mean", "bonus", "bound"])

    scored = events.where("score IS NOT NULL").select("student", "ts", "event_id", "score", "difficulty")
    return scored.groupBy("student").applyInPandas(learn, "student bigint, arm int, chosen boolean, mean double, bonus double, bound double")
