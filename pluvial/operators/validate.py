"""Expectations, counted in one aggregation, and time splits."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from pluvial.functions.expr import labelled


class Violation(ValueError):
    pass


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, violations``: rows for which a rule is not true; a null rule counts as violated."""
    counts = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    return df.agg(*counts).unpivot([], list(rules), "rule", "violations")


def check(df: DataFrame, rules: dict[str, Column]) -> None:
    broken = [f"{r.rule}: {r.violations}" for r in violations(df, rules).where("violations > 0").collect()]
    if broken:
        raise Violation("; ".join(broken))


def gold_rules(rain: str = "PRCP", threshold: float = 0.1) -> dict[str, Column]:
    amount, label, log = F.col("target_1stage_prcp_mm"), F.col("target_stage1_rain_label"), F.col("target_stage2_prcp_log1p")
    return {
        "rain_finite": ~F.isnan(F.col(rain)) & (F.abs(F.col(rain)) < float("inf")),
        "rain_not_negative": F.col(rain) >= 0,
        "label_follows_rain": label == (F.col(rain) >= threshold).cast("int"),
        "amount_is_rain": F.abs(amount - F.col(rain)) <= 1e-8,
        "log_is_log1p": F.abs(log - F.log1p(F.col(rain))) <= 1e-6,
    }


def shares(df: DataFrame, conditions: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``name, share``: of the rows where the second column holds, how many fulfil the first."""
    found = [F.avg(F.when(among, c.cast("double"))).alias(name) for name, (c, among) in conditions.items()]
    return df.agg(*found).unpivot([], list(conditions), "name", "share")


def pressure_level_faults(df: DataFrame) -> DataFrame:
    """Shares of pairs with the 500 hPa level not above, or not colder than, the 850 hPa level."""
    z = F.col("z_500").isNotNull() & F.col("z_850").isNotNull()
    t = F.col("t_500").isNotNull() & F.col("t_850").isNotNull()
    return shares(df, {"height_inverted": (F.col("z_500") <= F.col("z_850"), z), "temperature_inverted": (F.col("t_850") <= F.col("t_500"), t)})


def check_pressure_levels(df: DataFrame, fatal: float = 0.01, warn: float = 0.10) -> list[str]:
    """Raises if too many heights are inverted; returns warnings on temperatures."""
    share = {r["name"]: r["share"] or 0.0 for r in pressure_level_faults(df).collect()}
    if share["height_inverted"] > fatal:
        raise Violation(f"z_500 <= z_850 in {share['height_inverted']:.2%} of pairs")
    return [f"t_850 <= t_500 in {share['temperature_inverted']:.2%} of pairs"] if share["temperature_inverted"] > warn else []


def absent_levels(df: DataFrame, level: str, levels) -> list:
    seen = {r[0] for r in df.select(level).where(F.col(level).isin(list(levels))).distinct().collect()}
    return [x for x in levels if x not in seen]


def not_empty(**parts: DataFrame) -> None:
    if empty := [name for name, df in parts.items() if df.isEmpty()]:
        raise Violation(f"no rows: {', '.join(empty)}")


def split_by_time(df: DataFrame, time: str, valid: str = "2023-01-01", test: str = "2024-01-01") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Before ``valid``, from there to ``test``, and from ``test`` on; an error if a part is empty."""
    t = F.col(time)
    parts = df.where(t < valid), df.where((t >= valid) & (t < test)), df.where(t >= test)
    not_empty(train=parts[0], valid=parts[1], test=parts[2])
    return parts


def split_by_year(df: DataFrame, time: str, train: tuple[int, int] = (2015, 2022), valid: int = 2023, test: int = 2024) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unlike ``split_by_time``, other years are in no part."""
    y = F.year(time)
    return df.where(y.between(*train)), df.where(y == valid), df.where(y == test)


def split_label(time: str, train: tuple[int, int] = (2015, 2022), valid: int = 2023, test: int = 2024) -> Column:
    y = F.year(time)
    return labelled([(y.between(*train), "train"), (y == valid, "valid"), (y == test, "test")], "outside")


class Audit:
    """Checks that are counted while a table is computed for another purpose: ``watch`` tables on the way, run the one
    action, then ask for the ``report``. No check reads anything a second time."""

    def __init__(self):
        self.watched: list[tuple[str, Observation, dict[str, float | None], list[str]]] = []

    def watch(self, df: DataFrame, name: str, rules: dict[str, Column] | None = None, tolerated: dict[str, float] | None = None, present: dict[str, Column] | None = None) -> DataFrame:
        """``df``, whose rows are counted as they pass. ``rules``: not true (or null) is a violation, up to the share
        ``tolerated`` a warning only; ``present``: some row has to fulfil these."""
        rules, present = rules or {}, present or {}
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        counts = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"r{i}") for i, rule in enumerate(rules.values())]
        counts += [F.count_if(rule).alias(f"p{i}") for i, rule in enumerate(present.values())]
        self.watched.append((name, seen, {r: (tolerated or {}).get(r) for r in rules}, list(present)))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)

    def report(self) -> list[tuple[str, str, int, int]]:
        """(check, PASS, WARNING or FAIL, violations, rows) after the action; a table whose rows never passed fails."""
        out = []
        for name, seen, rules, present in self.watched:
            try:
                found = seen.get
            except Py4JJavaError:  # the action did without the table
                found = {}
            rows = found.get("rows", 0) or 0
            for i, (rule, share) in enumerate(rules.items()):
                n = found.get(f"r{i}", -1)
                status = "FAIL" if n < 0 else "PASS" if n == 0 else "WARNING" if share is not None and n <= share * rows else "FAIL"
                out.append((f"{name}_{rule}", status, n, rows))
            out += [(f"{name}_{p}", "PASS" if found.get(f"p{i}", 0) else "FAIL", 0 if found.get(f"p{i}", 0) else 1, rows) for i, p in enumerate(present)]
        return out

    def settle(self) -> list[tuple[str, str, int, int]]:
        """The report; an error if anything failed."""
        found = self.report()
        if broken := [f"{check}: {n}" for check, status, n, _ in found if status == "FAIL"]:
            raise Violation("; ".join(broken))
        return found


REPORT = "check string, status string, violations bigint, rows bigint"


def profile(df: DataFrame) -> DataFrame:
    """``column, type, rows, known, least, greatest``: every column in one aggregation; bounds of numbers only."""
    kinds = dict(df.dtypes)
    numeric = {f.name for f in df.schema if isinstance(f.dataType, NumericType)}
    number = lambda c: F.col(f"`{c}`").cast("double") if c in numeric else F.lit(None).cast("double")
    aggs = [F.struct(F.count(F.lit(1)).alias("rows"), F.count(F.col(f"`{c}`")).alias("known"), F.min(number(c)).alias("least"), F.max(number(c)).alias("greatest")).alias(f"c{i}") for i, c in enumerate(kinds)]
    place = F.regexp_extract("_c", r"(\d+)", 1).cast("int") + 1
    names, types = (F.array(*[F.lit(x) for x in xs]) for xs in (kinds.keys(), kinds.values()))
    rows = df.agg(*aggs).unpivot([], [f"c{i}" for i in range(len(kinds))], "_c", "p")
    return rows.select(F.element_at(names, place).alias("column"), F.element_at(types, place).alias("type"), "p.rows", "p.known", "p.least", "p.greatest")


def against_codebook(df: DataFrame, codebook: DataFrame) -> DataFrame:
    """``column, verdict, known, least, greatest`` for every column of the table or of the codebook.

    ``codebook``: ``column, type, low, high, least_known`` (null: no bound). The
    first that holds: ``absent`` from the table, ``extra`` in it, ``mistyped``,
    ``too_few`` known values, ``out_of_range``; else ``ok``.
    """
    both = profile(df).join(F.broadcast(codebook.withColumnRenamed("type", "declared").withColumn("listed", F.lit(True))), "column", "full")  # a row for each column
    c = F.col
    verdict = labelled(
        [
            (c("rows").isNull(), "absent"), (c("listed").isNull(), "extra"), (c("declared") != c("type"), "mistyped"), (c("known") < c("least_known"), "too_few"),
            ((c("least") < c("low")) | (c("greatest") > c("high")), "out_of_range"),
        ],
        "ok",
    )
    return both.select("column", verdict.alias("verdict"), "known", "least", "greatest")
