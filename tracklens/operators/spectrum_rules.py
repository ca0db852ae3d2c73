"""Verdicts on a file's spectrum, as expressions over one sorted array of bands.

bands is array<struct<hz: long, db: double>>, sorted by hz: one shuffle by file gathers
at most some sixty bands, and everything after it stays in a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import rate_family

#: The grid of bands in Hz.
FINE_FROM, FINE_TO, FINE_STEP, COARSE_FROM, COARSE_STEP, TOP_SHARE = 14000, 25000, 500, 26000, 2000, 0.95
#: The cliff of a lossy codec.
CLIFF_DB, CLIFF_SPAN, CLIFF_TO, CLIFF_CAP, NOISE_DB, WALL_SHARE = 40.0, 2, 20000, 22500, -100.0, 0.88
#: Silence above an upsampled source.
GAP_DB, SPREAD_DB, EDGE_DB, CHECKED_RATE = 70.0, 30.0, 20.0, 48000
SOURCES = ((22600, 44100), (24600, 48000))
#: Readings of the bandwidth.
BAND_FROM, RISE_DB, FLAT_DB, FLAT_SPAN, LEAVE_DB, FLOOR_DB, QUIET_DB, PASSBAND, SHAPED_SHARE, STEP_DB = 20000, 6.0, 4.0, 8000, 6.0, 20.0, 50.0, 0.49, 0.5, 10.0
LADDER = {11025: (44100, 88200, 176400), 8000: (48000, 96000, 192000)}
READINGS = ("shaping", "floor", "step", "quiet")


def gather_bands(bands: DataFrame, *keys: str) -> DataFrame:
    """One row per file: its bands as a sorted array; other keys come along."""
    return bands.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("hz").cast("long").alias("hz"), F.col("db").cast("double").alias("db")))).alias("bands"))


def _where(bands: Column, test) -> Column:
    return F.filter(bands, test)


def _db(bands: Column) -> Column:
    return F.transform(bands, lambda b: b["db"])


def median(values: Column) -> Column:
    """The middle value, or the mean of the middle two; null if there is none."""
    ordered, n = F.sort_array(values), F.size(values)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def find_cliff(files: DataFrame) -> DataFrame:
    """files with cliff_db and cutoff_hz: the deepest fall to the next two fine bands, the lowest of equal ones."""
    fine = F.filter("bands", lambda b: (b["hz"] >= FINE_FROM) & (b["hz"] <= FINE_TO) & (b["hz"] % FINE_STEP == 0))
    ceiling = F.least(F.lit(float(CLIFF_CAP)), F.lit(float(CLIFF_TO)) * F.col("sample_rate") / 44100)
    files = files.withColumns({"_fine": fine, "_ceiling": ceiling})

    def fall(b: Column, i: Column) -> Column:
        after = F.array_min(_db(F.slice("_fine", i + 2, CLIFF_SPAN)))
        good = (i < F.size("_fine") - 1) & (b["hz"] <= F.col("_ceiling")) & (b["db"] >= NOISE_DB)
        return F.struct(F.when(good, b["db"] - after).alias("drop"), (-b["hz"]).alias("back"))

    files = files.withColumn("_best", F.array_max(F.filter(F.transform("_fine", fall), lambda x: x["drop"] > 0)))
    cutoff = F.when(F.col("_best.drop") >= CLIFF_DB, -F.col("_best.back")).otherwise(0).cast("long")
    return files.withColumns({"cliff_db": F.coalesce("_best.drop", F.lit(0.0)), "cutoff_hz": cutoff}).drop("_fine", "_ceiling", "_best")


def find_upsampling(bands: Column, rate: Column) -> tuple[Column, Column, Column]:
    """(gap_db, spread_db, source_rate): featureless silence above what a lower rate holds."""
    audible = _where(bands, lambda b: (b["hz"] >= 15000) & (b["hz"] <= 20000))
    coarse = _db(_where(bands, lambda b: b["hz"] >= COARSE_FROM))
    floor = median(coarse)
    gap, spread = median(_db(audible)) - floor, F.array_max(coarse) - F.array_min(coarse)
    fine = _where(bands, lambda b: (b["hz"] <= FINE_TO) & (b["db"] > floor + EDGE_DB))
    edge = F.coalesce(F.array_max(F.transform(fine, lambda b: b["hz"])), F.lit(0))
    source = F.when(edge <= SOURCES[0][0], SOURCES[0][1]).when(edge <= SOURCES[1][0], SOURCES[1][1]).otherwise(F.floor(edge * 2 / 1000) * 1000)
    silent = (rate > CHECKED_RATE) & (gap >= GAP_DB) & (spread <= SPREAD_DB)
    return gap, spread, F.when(F.coalesce(silent, F.lit(False)), source).otherwise(0).cast("long")


def blame_resampler(cutoff: Column, cliff: Column, source: Column) -> tuple[Column, Column]:
    """(cutoff_hz, cliff_db) without a wall that upsampling explains."""
    explained = (cutoff > 0) & (source > 0) & (cutoff >= source / 2 * WALL_SHARE)
    return F.when(explained, 0).otherwise(cutoff).cast("long"), F.when(explained, 0.0).otherwise(cliff)


_HIT = "struct<edge:long,place:int,level:double,peak:long>"


def _hit(edge: Column, place: int, level: Column, peak: Column) -> Column:
    return F.struct(edge.cast("long").alias("edge"), F.lit(place).alias("place"), level.alias("level"), peak.cast("long").alias("peak")).cast(_HIT)


def _climb() -> Column:
    """The low point from BAND_FROM up, and whether the spectrum climbs from it."""
    begin = F.struct(F.lit(float("inf")).alias("low"), F.lit(0).cast("long").alias("turn"), F.lit(False).alias("over"))

    def step(acc: Column, b: Column) -> Column:
        falls = ~acc["over"] & (b["db"] < acc["low"])
        low, turn = F.when(falls, b["db"]).otherwise(acc["low"]), F.when(falls, b["hz"]).otherwise(acc["turn"])
        return F.struct(low.alias("low"), turn.alias("turn"), (acc["over"] | (~falls & (b["db"] > acc["low"] + RISE_DB))).alias("over"))

    return F.aggregate("_up", begin, step)


def _flat() -> Column:
    """The first stretch of FLAT_SPAN that is flat and far below the music."""
    run = lambda b: _db(F.filter("_up", lambda g: (g["hz"] >= b["hz"]) & (g["hz"] <= b["hz"] + FLAT_SPAN)))
    runs = F.transform(F.filter("_up", lambda b: F.col("_top") >= b["hz"] + FLAT_SPAN), lambda b: F.struct(b["hz"].alias("hz"), F.sort_array(run(b)).alias("run")))
    middle = lambda r: (F.get(r, F.floor((F.size(r) - 1) / 2).cast("int")) + F.get(r, F.floor(F.size(r) / 2).cast("int"))) / 2
    levels = F.transform(runs, lambda x: F.struct(x["hz"].alias("hz"), middle(x["run"]).alias("level"), (F.element_at(x["run"], -1) - F.get(x["run"], F.lit(0))).alias("spread")))
    return _first(F.filter(levels, lambda x: (x["spread"] < FLAT_DB) & (x["level"] < F.col("_reference") - FLOOR_DB)))


def _drop() -> Column:
    """The first sharp step down that nothing above climbs back over."""

    def fall(b: Column, i: Column) -> Column:
        before = F.get("_up", i - 1)
        sharp = (i > 0) & (i < F.size("_up") - 1) & (b["hz"] - before["hz"] <= FINE_STEP) & (before["db"] - b["db"] >= STEP_DB)
        tail = F.sort_array(_db(F.slice("_up", i + 1, F.size("_up"))))
        return F.when(sharp, F.struct(before["hz"].alias("edge"), b["db"].alias("db"), tail.alias("tail")))

    falls = F.filter(F.transform("_up", fall), lambda x: x.isNotNull() & (F.element_at(x["tail"], -1) <= x["db"] + LEAVE_DB))
    middle = lambda r: (F.get(r, F.floor((F.size(r) - 1) / 2).cast("int")) + F.get(r, F.floor(F.size(r) / 2).cast("int"))) / 2
    return _first(F.transform(falls, lambda x: F.struct(x["edge"].alias("edge"), middle(x["tail"]).alias("level"))))


def readings(files: DataFrame) -> DataFrame:
    """files with _up, _reference and hits: the readings that fired, lowest edge first.

    hits is array<struct<edge, place, level, peak>>, null where ultrasound wasn't
    measured. What several readings use is a column of its own, worked out once.
    """
    audible = _db(F.filter("bands", lambda b: (b["hz"] >= 15000) & (b["hz"] <= 20000)))
    files = files.withColumns({"_up": F.filter("bands", lambda b: b["hz"] >= BAND_FROM), "_audible": F.sort_array(audible)})
    n = F.size("_audible")
    reference = F.when(n > 0, (F.get("_audible", F.floor((n - 1) / 2).cast("int")) + F.get("_audible", F.floor(n / 2).cast("int"))) / 2)
    files = files.withColumns({"_reference": reference, "_top": F.array_max(F.transform("_up", lambda b: b["hz"]))})
    files = files.withColumns({"_climb": _climb(), "_flat": _flat(), "_step": _drop()})
    above = F.filter("_up", lambda b: b["hz"] > F.col("_climb.turn"))
    files = files.withColumns({
        "_above": above, "_left": F.array_max(F.transform(F.filter("_up", lambda g: (g["hz"] < F.col("_flat.hz")) & (g["db"] > F.col("_flat.level") + LEAVE_DB)), lambda g: g["hz"])),
        "_faded": _first(F.filter("_up", lambda b: b["db"] < F.col("_reference") - QUIET_DB)),
    })
    raised = F.size(F.filter("_above", lambda b: b["db"] > F.col("_climb.low")))
    peak = F.array_max(F.transform("_above", lambda b: F.struct(b["db"].alias("db"), (-b["hz"]).alias("back"))))
    hits = F.array(
        F.when(F.col("_climb.over") & (raised >= F.size("_above") * SHAPED_SHARE), _hit(F.col("_climb.turn"), 0, peak["db"], -peak["back"])),
        F.when(F.col("_flat").isNotNull(), _hit(F.coalesce("_left", "_flat.hz"), 1, F.col("_flat.level"), F.lit(0))),
        F.when(F.col("_step").isNotNull(), _hit(F.col("_step.edge"), 2, F.col("_step.level"), F.lit(0))),
        F.when(F.col("_faded").isNotNull(), _hit(F.col("_faded.hz"), 3, F.col("_reference") - QUIET_DB, F.lit(0))),
    )
    measured = F.exists("bands", lambda b: b["hz"] >= COARSE_FROM) & (F.size("_up") >= 4) & F.col("_reference").isNotNull()
    hits = F.when(measured, F.sort_array(F.filter(hits, lambda x: x.isNotNull())))
    return files.withColumn("hits", hits).drop("_audible", "_climb", "_flat", "_step", "_above", "_left", "_faded")


def enough_rate(content: Column, rate: Column) -> Column:
    """The lowest rate of the file's family, below its own, that holds content; 0 if there is none."""
    fits = lambda rungs: F.coalesce(F.get(F.filter(F.array(*map(F.lit, rungs)), lambda r: (r * PASSBAND >= content) & (r < rate)), F.lit(0)), F.lit(0))
    return F.when(rate_family(rate) == 11025, fits(LADDER[11025])).otherwise(fits(LADDER[8000]))


def inspect_verdicts(files: DataFrame) -> DataFrame:
    """files (sample_rate, bands) with the verdict on each spectrum.

    Adds cliff_db, cutoff_hz, source_rate and, where ultrasound was measured,
    content_why, content_hz, ultra_level_db, ultra_peak_hz and enough_rate. The columns are built in
    steps, so that each array is worked out once.
    """
    gap, spread, source = find_upsampling(F.col("bands"), F.col("sample_rate"))
    out = find_cliff(files).withColumns({"gap_db": gap, "spread_db": spread, "source_rate": source})
    cutoff, cliff = blame_resampler(F.col("cutoff_hz"), F.col("cliff_db"), F.col("source_rate"))
    out = readings(out.withColumns({"cutoff_hz": cutoff, "cliff_db": cliff}))
    turn = _first(F.filter("hits", lambda h: h["place"] == 0))["edge"]
    out = out.withColumns({"_won": _first(F.col("hits")), "_ceiling": F.coalesce(turn, F.col("_top"))})
    loud = F.filter("_up", lambda b: (b["hz"] <= F.col("_ceiling")) & (b["db"] > F.col("_won.level") + FLOOR_DB) & (b["db"] > F.col("_reference") - QUIET_DB))
    loudest = F.coalesce(F.array_max(F.transform(loud, lambda b: b["hz"])), F.lit(0))
    won = F.col("_won").isNotNull()
    content = F.when(F.col("hits").isNotNull(), F.when(won, F.greatest("_won.edge", loudest)).otherwise(F.col("_top"))).otherwise(0)
    why = F.get(F.array(*map(F.lit, READINGS)), F.col("_won.place"))
    out = out.withColumns({
        "content_why": F.when(won, why), "content_hz": content.cast("long"), "ultra_level_db": F.col("_won.level") - F.col("_reference"), "ultra_peak_hz": F.coalesce("_won.peak", F.lit(0)),
    })
    enough = F.when(won, enough_rate(F.col("content_hz"), F.col("sample_rate"))).otherwise(0)
    return out.withColumn("enough_rate", enough.cast("long")).drop("hits", "_up", "_top", "_reference", "_won", "_ceiling")
