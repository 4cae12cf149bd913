"""Shared horizons, leave-one-subject-out medians and the fallback hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import height, plausible
from ..functions.nulls import finite
from ..sources.shared import stage
from .ranks import median, running

FRONT_BACK, LATERAL = ("front", "back"), ("left", "right")


def shared(df: DataFrame, subject: str, value: str, donor: Column) -> DataFrame:
    """A subject's median over its donors, else the median of all donors: (.., shared, shared_source)."""
    v = F.when(donor, F.col(value))
    own = df.where(F.col(subject).isNotNull()).groupBy(F.col(subject).alias("_subject")).agg(F.median(v).alias("_own"))
    everyone = median(df.select(v.alias("_v")), "_v", "_all")
    out = df.join(own, F.col(subject) == F.col("_subject"), "left").crossJoin(F.broadcast(everyone))  # one row
    pick = F.coalesce(F.when(F.col("_own").isNotNull(), F.struct(F.col("_own").alias("y"), F.lit("subject").alias("s"))), F.when(F.col("_all").isNotNull(), F.struct(F.col("_all").alias("y"), F.lit("global").alias("s"))))
    return out.withColumn("_p", pick).select(*df.columns, F.col("_p.y").alias("shared"), F.col("_p.s").alias("shared_source"))


def valid_donor(view: Column, views: tuple[str, ...], status: Column, y: Column, cube_height: Column | None = None) -> Column:
    """Whether an image's own horizon can serve others: its view, status ok, a finite row and, if given, a plausible height of its own."""
    ok = view.isin(*views) & (status == "ok") & finite(y).isNotNull()
    return F.coalesce(ok if cube_height is None else ok & plausible(finite(cube_height)), F.lit(False))


def loso_medians(donors: DataFrame, subjects: DataFrame, subject: str, value: str, kind: str) -> DataFrame:
    """(subject, kind, loso): for every subject and kind of donor the median of all other subjects' values; null if there are none.

    Counts of distinct values replace rows, so a frequent value is one row. Of the values up to v the rest holds
    G(v) - O(v), all less the subject's own; its k-th lies where G first reaches k plus the own ones before it. So a
    subject needs two counts over its own values and two look-ups, not all pairs. Only sums and look-ups are joined.
    """
    rows = donors.where(F.col(value).isNotNull() & F.col(subject).isNotNull()).select(F.col(kind).alias("kind"), F.col(subject).alias("subject"), F.col(value).cast("double").alias("v"))
    own = stage(rows.groupBy("kind", "subject", "v").agg(F.count("*").alias("o")), "own")
    upto = running(own.groupBy("kind", "v").agg(F.sum("o").alias("c")), ["kind", "v"], "c", "g")
    ends = upto.groupBy("kind").agg(F.sum("c").alias("n"), F.min(F.col("g") - F.col("c")).alias("base"))  # kinds are a few labels
    upto = upto.join(F.broadcast(ends), "kind").withColumn("g", F.col("g") - F.col("base"))
    # own values below each own value, summed by part first so that a hot subject is many groups
    mine = own.join(upto.select("kind", "v", "g", "part"), ["kind", "v"])
    by_part = mine.groupBy("kind", "subject", "part").agg(F.sum("o").alias("p"))
    before = F.sum("p").over(Window.partitionBy("kind", "subject").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    by_part = by_part.select("kind", "subject", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("o").over(Window.partitionBy("kind", "subject", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    mine = mine.withColumn("inside", inside).join(by_part, ["kind", "subject", "part"]).select("kind", "subject", "g", (F.col("inside") + F.col("before")).alias("mine"))
    # how many values each subject leaves to the median, and the two middle places
    sizes = own.groupBy("kind", "subject").agg(F.sum("o").alias("m"))
    asked = subjects.select(F.col(subject).alias("subject")).where("subject IS NOT NULL").distinct().crossJoin(F.broadcast(ends.select("kind", "n")))
    asked = asked.join(sizes, ["kind", "subject"], "left").withColumn("rest", F.col("n") - F.coalesce("m", F.lit(0)))
    places = F.explode(F.array_distinct(F.array(F.floor((F.col("rest") + 1) / 2), F.floor((F.col("rest") + 2) / 2))))
    asked = asked.where("rest > 0").select("kind", "subject", places.alias("k"))
    passed = asked.join(mine, ["kind", "subject"]).where(F.col("g") - F.col("mine") < F.col("k")).groupBy("kind", "subject", "k").agg(F.max("mine").alias("passed"))
    asked = asked.join(passed, ["kind", "subject", "k"], "left").select("kind", "subject", (F.col("k") + F.coalesce("passed", F.lit(0))).alias("r"))
    # each place asked for is looked up once, in the part of the values that holds it
    last = upto.groupBy("kind", "part").agg(F.max("g").alias("end"))
    last = last.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("part", "end"))).alias("ends"))  # a number for each part
    wanted = asked.select("kind", "r").distinct().join(F.broadcast(last), "kind")
    wanted = wanted.select("kind", F.get(F.filter("ends", lambda e: e["end"] >= F.col("r")), F.lit(0))["part"].alias("part"), F.col("r").alias("pos"), F.lit(None).cast("double").alias("v"), F.lit(0).alias("value"))
    line = wanted.unionByName(upto.select("kind", "part", F.col("g").alias("pos"), "v", F.lit(1).alias("value")))
    ahead = Window.partitionBy("kind", "part").orderBy("pos", "value").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = line.withColumn("v", F.min("v").over(ahead)).where("value = 0").select("kind", F.col("pos").alias("r"), "v")
    out = asked.join(found, ["kind", "r"]).groupBy("kind", "subject").agg(F.avg("v").alias("loso"))
    every = subjects.select(F.col(subject).alias("subject")).where("subject IS NOT NULL").distinct()
    out = every.crossJoin(F.broadcast(ends.select("kind"))).join(out, ["kind", "subject"], "left")
    return out.select(F.col("subject").alias(subject), F.col("kind").alias(kind), "loso")


def loso_median(donors: DataFrame, subjects: DataFrame, subject: str, value: str) -> DataFrame:
    """(subject, loso) for one kind of donor."""
    name = "_kind"
    out = loso_medians(donors.withColumn(name, F.lit("all")), subjects, subject, value, name).drop(name)
    every = subjects.select(subject).where(F.col(subject).isNotNull()).distinct()
    return every.join(out, subject, "left")


def hierarchy(df: DataFrame, view: str, own: Column, subject_fb: Column, subject_lateral: Column, global_fb: Column, global_lateral: Column) -> DataFrame:
    """(.., y_horizon_shared, horizon_shared_source, y_global_front_back_loo, y_global_lateral_loo, y_horizon_corrected, horizon_corrected_source, height_reliability).

    The first candidate that is there; value, source and reliability stay together. The names of the sources are fixed values.
    """

    def pick(y: Column, source: str, reliability: str) -> Column:
        return F.when(y.isNotNull(), F.struct(y.alias("y"), F.lit(source).alias("source"), F.lit(reliability).alias("reliability")))

    nothing = F.struct(F.lit(None).cast("double").alias("y"), F.lit("no_valid_horizon").alias("source"), F.lit("unavailable").alias("reliability"))
    shared_y = F.coalesce(subject_fb, global_fb)
    front = F.coalesce(
        pick(subject_fb, "subject_front_back", "high"),
        pick(own, "per_image_cube_front_back_fallback", "medium"),
        pick(global_fb, "global_front_back_fallback_loo", "low"),
        pick(global_lateral, "global_lateral_last_resort_loo", "very_low"),
        nothing,
    )
    side = F.coalesce(
        pick(own, "per_image_cube_lateral", "high"),
        pick(subject_lateral, "paired_lateral_subject_fallback", "medium"),
        pick(shared_y, "subject_front_back_lateral_fallback", "medium"),
        pick(global_lateral, "global_lateral_fallback_loo", "low"),
        nothing,
    )
    other = F.coalesce(
        pick(own, "per_image_cube_unknown_view", "medium"),
        pick(shared_y, "shared_unknown_view_fallback", "low"),
        pick(global_lateral, "global_lateral_unknown_view_fallback_loo", "very_low"),
        nothing,
    )
    chosen = F.when(F.col(view).isin(*FRONT_BACK), front).when(F.col(view).isin(*LATERAL), side).otherwise(other)
    shared_source = F.when(subject_fb.isNotNull(), "subject_front_back").otherwise("global_front_back_fallback_loo")
    return df.withColumn("_pick", chosen).select(
        *df.columns, shared_y.alias("y_horizon_shared"), shared_source.alias("horizon_shared_source"), global_fb.alias("y_global_front_back_loo"), global_lateral.alias("y_global_lateral_loo"),
        F.col("_pick.y").alias("y_horizon_corrected"), F.col("_pick.source").alias("horizon_corrected_source"), F.col("_pick.reliability").alias("height_reliability"),
    )


def correct(df: DataFrame, subject: str, view: str, value: str, status: str, cube_height: str, by: str | None = None) -> DataFrame:
    """The whole hierarchy from one table of images: subject medians, leave-one-subject-out medians of both kinds of donor in one pass, and the pick.

    With by, each of its values (a few, such as those of a parameter) is a table of its own.
    """
    c = F.col
    part = c(by).cast("string") if by else F.lit("")
    donor = lambda views: valid_donor(c(view), views, c(status), c(value), c(cube_height))
    own = F.when((c(status) == "ok") & plausible(finite(c(cube_height))), finite(c(value)))
    kinds = F.when(donor(FRONT_BACK), F.concat(F.lit("fb"), part)).when(donor(LATERAL), F.concat(F.lit("la"), part))
    medians = df.groupBy(part.alias("_part"), subject).agg(F.median(F.when(donor(FRONT_BACK), c(value))).alias("_sfb"), F.median(F.when(donor(LATERAL), c(value))).alias("_sl"))
    loso = loso_medians(df.withColumn("_kind", kinds).where("_kind IS NOT NULL"), df, subject, value, "_kind")
    loso = loso.groupBy(F.substring("_kind", 3, 1000).alias("_part"), subject).agg(F.max(F.when(c("_kind").startswith("fb"), c("loso"))).alias("_gfb"), F.max(F.when(c("_kind").startswith("la"), c("loso"))).alias("_gl"))
    known = medians.join(loso, ["_part", subject], "left").withColumnRenamed(subject, "_subject")
    out = df.join(known, (c(subject) == c("_subject")) & (part == c("_part")), "left")
    picked = hierarchy(out, view, own, *(c(x) for x in ("_sfb", "_sl", "_gfb", "_gl")))
    return picked.drop("_part", "_subject", "_sfb", "_sl", "_gfb", "_gl")


def diagnose(df: DataFrame, camera_cm: str, feet: str, head: str, own: str, shared_: str, truth: str, image_h: str) -> DataFrame:
    """(.., heights, errors and absolute errors from an image's own horizon and from the shared one, improvement, delta_px, delta_share).

    improvement is positive where the own horizon is nearer to the truth; delta_share is the horizons' distance over the image's height.
    """
    c = F.col
    out = df.withColumns({f"h_{n}": height(c(camera_cm), c(feet), c(head), c(y), "c") for n, y in (("own", own), ("shared", shared_))})
    out = out.withColumns({f"error_{n}": c(f"h_{n}") - c(truth) for n in ("own", "shared")})
    out = out.withColumns({f"abs_error_{n}": F.abs(f"error_{n}") for n in ("own", "shared")})
    delta = c(own) - c(shared_)
    return out.withColumns({"improvement": c("abs_error_shared") - c("abs_error_own"), "delta_px": delta, "delta_share": F.when(c(image_h) > 0, delta / c(image_h))})
