"""Hunts and rules: predicate documents checked strictly and compiled to column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"artifact_any", "artifact_all", "intent_in", "command_count_gte", "login_fail_gte", "novelty_gte", "window_days"}


@dataclass(frozen=True)
class Hunt:
    """A named conjunction of predicates over session rows."""

    hunt_id: str
    where: dict = field(default_factory=dict)
    enabled: bool = True
    cap: int = 500


def load_hunts(docs: list[dict]) -> list[Hunt]:
    """Hunts of parsed documents; unknown kinds, empty lists, wrong types and repeated ids are errors."""
    out, seen = [], set()
    for doc in docs:
        name = doc.get("id")
        if not isinstance(name, str) or not name:
            raise ValueError("a hunt needs an id")
        if name in seen:
            raise ValueError(f"hunt {name} occurs twice")
        seen.add(name)
        where = doc.get("where")
        if not isinstance(where, dict) or not where:
            raise ValueError(f"hunt {name} has no predicates")
        for kind, value in where.items():
            if kind not in KINDS:
                raise ValueError(f"hunt {name}: unknown predicate {kind}")
            if kind in ("artifact_any", "artifact_all", "intent_in"):
                if not isinstance(value, list) or not value or not all(isinstance(v, str) and v for v in value):
                    raise ValueError(f"hunt {name}: {kind} needs a list of texts")
            elif isinstance(value, bool) or not isinstance(value, int | float):
                raise ValueError(f"hunt {name}: {kind} needs a number")
        enabled = doc.get("enabled", True)
        if not isinstance(enabled, bool):
            raise ValueError(f"hunt {name}: enabled must be true or false")
        out.append(Hunt(name, where, enabled, int(doc.get("cap", 500))))
    return out


def predicate(kind: str, value: object, now: Column) -> Column:
    """A session predicate; columns that are null don't match."""
    arr = F.coalesce(F.col("artifacts"), F.array().cast("array<string>"))
    if kind == "artifact_any":
        return F.arrays_overlap(arr, F.array(*map(F.lit, value)))
    if kind == "artifact_all":
        return F.size(F.array_except(F.array(*map(F.lit, value)), arr)) == 0
    if kind == "intent_in":
        return F.coalesce(F.col("dominant_intent").isin(list(value)), F.lit(False))
    if kind == "window_days":
        return F.col("started_at") >= now - F.make_interval(days=F.lit(int(value)))
    column = {"command_count_gte": "command_count", "login_fail_gte": "login_fail_count", "novelty_gte": "novelty"}[kind]
    return F.coalesce(F.col(column) >= F.lit(value), F.lit(False))


def compile_hunt(hunt: Hunt, now: Column) -> Column:
    return reduce(lambda a, b: a & b, [predicate(k, v, now) for k, v in hunt.where.items()])


def run_hunts(sessions: DataFrame, hunts: list[Hunt], now: Column, order: list) -> DataFrame:
    """(hunt_id, rank, ...): matches of every enabled hunt, newest first, each up to its cap; one pass over the sessions."""
    from pyspark.sql.window import Window

    on = [h for h in hunts if h.enabled]
    if not on:
        return sessions.withColumn("hunt_id", F.lit(None).cast("string")).withColumn("rank", F.lit(0)).limit(0)
    tags = F.array_compact(F.array(*[F.when(compile_hunt(h, now), F.struct(F.lit(h.hunt_id).alias("hunt_id"), F.lit(h.cap).alias("cap"))) for h in on]))
    hit = sessions.withColumn("h", F.explode(tags)).withColumn("hunt_id", F.col("h.hunt_id")).withColumn("cap", F.col("h.cap")).drop("h")
    w = Window.partitionBy("hunt_id").orderBy(*order)
    return hit.withColumn("rank", F.row_number().over(w)).filter("rank <= cap").drop("cap")
