"""From labelled pixels to tokens, keypoints and cleaned masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmotion.functions.arrays import token_features
from fieldmotion.functions.constants import HASH, HASH_FAR_Y, HASH_NEAR_Y, FIELD_WIDTH, NUMBER, NUMBER_FAR_INSIDE_Y, NUMBER_NEAR_INSIDE_Y, SIDE, YARD
from fieldmotion.functions.field import allowed_region, class_yards, quantise_conf
from fieldmotion.functions.geometry import project, undistort
from fieldmotion.operators import lines as L
from fieldmotion.operators.labels import drop_rates
from fieldmotion.operators.rejects import drop_small_groups
from fieldmotion.operators.reliable import stage

FRAME = ["clip", "frame_idx"]
COMP = [*FRAME, "comp"]

# Pixel sizes, aspect ratios and tolerances of line grouping.
YARD_RULE = dict(min_pixels=40, aspect=3.0, rho=25.0, theta=0.08, fragments=2, singleton=500, total=100)
SIDE_RULE = dict(min_pixels=60, aspect=2.0, rho=30.0, theta=0.10, fragments=1, singleton=200, total=100)


def clean_masks(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Pixels with their field position and whether their channel may lie there."""
    held = frames.where(F.col("h").isNotNull()).select(*FRAME, "h")
    x, y = project(F.col("h"), F.col("px"), F.col("py"), "floor9")
    placed = pixels.join(held, FRAME).withColumns({"x_yd": x, "y_yd": y}).drop("h")
    ok = allowed_region(F.col("x_yd"), F.col("y_yd"))
    ch = F.col("ch")
    return placed.withColumn("allowed", F.when(ch == YARD, ok["yard"]).when(ch == SIDE, ok["side"]).when(ch == HASH, ok["hash"]).otherwise(ok["number"]))


def mask_report(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    return drop_rates(stage(clean_masks(pixels, frames)), F.col("allowed"), FRAME)


def grouped_lines(pixels: DataFrame, channel: int, rule: dict, dedup: float | None) -> DataFrame:
    """One token row per physical line, from pixels or from component records: fragments grouped by direction and offset, small
    groups dropped, and near duplicates in x reduced to the larger."""
    mine = pixels.where(F.col("ch") == channel)
    params = L.line_params(mine, COMP, rule["aspect"], rule["min_pixels"])
    groups = L.group_collinear(params, rule["theta"], rule["rho"])
    stats = L.component_stats(mine.join(groups, COMP), [*FRAME, "line"])
    size = groups.groupBy(*FRAME, "line").agg(F.count("*").alias("_k"))
    n, k = F.col("area"), F.col("_k")
    ok = ((k >= rule["fragments"]) | (n >= rule["singleton"])) & (n >= rule["total"])
    kept = stage(stats.join(size, [*FRAME, "line"]).where(ok).drop("_k"))
    return L.suppress_near_dups(kept, dedup) if dedup else kept


def number_groups(pixels: DataFrame, min_component: int = 30) -> DataFrame:
    """Number components of a frame grouped by single link at the yard-line spacing."""
    num = pixels.where(F.col("ch") == NUMBER)
    comps = L.component_stats(num, COMP).where(F.col("area") >= min_component)
    yards = L.component_stats(pixels.where(F.col("ch") == YARD), COMP).where(F.col("area") >= 50)
    spaced = comps.join(L.yard_spacing(yards), FRAME, "left").withColumn("spacing", F.coalesce("spacing", F.lit(100.0)))
    clusters = L.single_link(spaced, F.col("spacing"))
    stats = L.component_stats(num.join(clusters, COMP), [*FRAME, "cluster"])
    members = clusters.groupBy(*FRAME, "cluster").agg(F.sort_array(F.collect_set("comp")).alias("members"))  # a frame's few components
    return drop_small_groups(stage(stats.join(members, [*FRAME, "cluster"]))).withColumnRenamed("cluster", "line")


def tokenise(pixels: DataFrame, labeller=None) -> DataFrame:
    """All tokens of every frame: lines, hashes and numbers with their 16 features.

    ``labeller`` maps number groups to rows with value, has_value, conf and optionally
    keep; by default numbers carry no value. Pixels are read once, into one record per
    component, from which all statistics follow.
    """
    pixels = stage(L.moments(pixels, [*FRAME, "ch", "comp"]))
    yard = grouped_lines(pixels, YARD, YARD_RULE, 50.0).withColumn("type", F.lit(YARD))
    side = grouped_lines(pixels, SIDE, SIDE_RULE, None).withColumn("type", F.lit(SIDE))
    hashes = L.component_stats(pixels.where(F.col("ch") == HASH), COMP).withColumnRenamed("comp", "line").withColumn("type", F.lit(HASH))
    plain = [d.withColumns({"value": F.lit(0.0), "has_value": F.lit(False)}) for d in (yard, side, hashes)]
    numbers = label_numbers(number_groups(pixels), labeller).drop("members").withColumn("type", F.lit(NUMBER))
    out = plain[0]
    for d in (plain[1], plain[2], numbers):
        out = out.unionByName(d)
    c = F.col
    feats = token_features(c("type"), c("cx"), c("cy"), c("x_min"), c("y_min"), c("x_max"), c("y_max"), c("area"),
                           c("cos_t"), c("sin_t"), c("value"), c("has_value"), c("conf"))
    return out.select(*FRAME, "type", "line", "area", feats.alias("token"))


def null_labeller(groups: DataFrame) -> DataFrame:
    """No value, no confidence: numbers carry geometry only."""
    return groups.withColumns({"value": F.lit(0.0), "has_value": F.lit(False), "label_conf": F.lit(0.0)})


def truth_labeller(frames: DataFrame):
    """A labeller that places each group's centre by its frame's known homography and snaps
    it to five yards. ``frames``: clip, frame_idx, h and, for lenses to be undone, k and
    dist; groups of frames without a homography have no value."""
    held = frames.where(F.col("h").isNotNull()).select(*FRAME, *[F.col(c).alias("_" + c) for c in ("h", "k", "dist") if c in frames.columns])

    def labeller(groups: DataFrame) -> DataFrame:
        u, v = F.col("cx"), F.col("cy")
        if "_k" in held.columns:
            iu, iv = undistort(u, v, F.col("_k"), F.col("_dist"))
            u, v = F.when(F.col("_k").isNull(), u).otherwise(iu), F.when(F.col("_k").isNull(), v).otherwise(iv)
        x, _ = project(F.col("_h"), u, v)
        q = quantise_conf(x)
        placed = groups.join(held, FRAME, "left")
        known = F.coalesce(F.col("_h").isNotNull() & q["has_value"], F.lit(False))
        return placed.withColumns({"value": F.when(known, q["value"]).otherwise(0.0), "has_value": known,
                                   "label_conf": F.when(known, q["conf"]).otherwise(0.0)}).drop(*[c for c in held.columns if c not in FRAME])

    return labeller


def majority_labeller(pixels: DataFrame, value: Column):
    """A labeller that gives each group the five-yard value most of its labelled pixels
    have, with their share. ``pixels``: clip, frame_idx, comp and what ``value`` reads (0 or
    less: no label); groups carry their components in ``members``. Votes are counted per
    component before they meet the groups."""
    votes = pixels.where(value > 0).groupBy(*COMP, (F.rint(value / 5) * 5).alias("_q")).agg(F.count("*").alias("_n"))

    def labeller(groups: DataFrame) -> DataFrame:
        member = groups.select(*FRAME, "line", F.explode("members").alias("comp"))
        counted = member.join(votes, COMP).groupBy(*FRAME, "line", "_q").agg(F.sum("_n").alias("_n"))
        best = counted.groupBy(*FRAME, "line").agg(F.max_by("_q", F.struct("_n", -F.col("_q"))).alias("value"), (F.max("_n") / F.sum("_n")).alias("label_conf"))
        named = groups.join(best, [*FRAME, "line"], "left").withColumn("has_value", F.col("value").isNotNull())
        return named.fillna(0.0, ["value", "label_conf"])

    return labeller


def label_numbers(groups: DataFrame, labeller=None) -> DataFrame:
    """Apply a labeller (groups -> value, has_value, label_conf[, keep]); rows it does not
    keep are dropped, and a valued token's confidence is scaled by the label's."""
    named = (labeller or null_labeller)(groups)
    if "keep" in named.columns:
        named = named.where("keep").drop("keep")
    conf = F.col("conf") * F.when(F.col("has_value"), F.col("label_conf")).otherwise(1.0)
    return named.withColumn("conf", conf).drop("label_conf")


def extract_keypoints(pixels: DataFrame) -> DataFrame:
    """Correspondences per frame from classified pixels (columns cls and row): yard lines
    meet sidelines and number edges; hashes sit on their yard line."""
    m = stage(L.moments(pixels, [*FRAME, "ch", "comp", "cls", "row"]))
    yard_px = pixels.where(F.col("ch") == YARD)
    fits = L.fit_lines(m.where(F.col("ch") == YARD), [*FRAME, "cls"])
    covered = L.mask_coverage(stage(fits), yard_px, [*FRAME, "cls"]).where(F.col("coverage") >= 0.70)
    yards = stage(L.spacing_outliers(stage(covered)).select(*FRAME, "cls", "a", "b"))
    line = lambda ch: L.fit_lines(m.where(F.col("ch") == ch), [*FRAME, "row"], "px", "py").select(*FRAME, "row", F.col("a").alias("a2"), F.col("b").alias("b2"))
    sides, hash_rows = stage(line(SIDE)), line(HASH)
    x = class_yards(F.col("cls"))

    def point(df, u, v, near, far, y_near, y_far):
        row = F.col("row") == 0
        return df.select(*FRAME, u.alias("u"), v.alias("v"), x.alias("fx"), F.when(row, y_near).otherwise(y_far).alias("fy"),
                         F.when(row, F.lit(near)).otherwise(F.lit(far)).alias("kind"))

    marks = L.component_stats(m.where(F.col("ch") == HASH), [*FRAME, "comp", "cls", "row"])
    on_line = marks.join(yards, [*FRAME, "cls"], "left")
    hashes = point(on_line, F.coalesce(F.col("a") + F.col("b") * F.col("cy"), F.col("cx")), F.col("cy"), "near_hash", "far_hash", HASH_NEAR_Y, HASH_FAR_Y)
    edges = point(L.line_crossings(yards, sides), F.col("u"), F.col("v"), "sideline_near", "sideline_far", 0.0, FIELD_WIDTH)
    slopes = hash_rows.select(*FRAME, "row", F.col("b2").alias("_h")).join(sides.select(*FRAME, "row", F.col("b2").alias("_s")), [*FRAME, "row"], "full")
    slopes = slopes.select(*FRAME, "row", F.coalesce("_h", "_s").alias("slope"))
    numbers = point(number_edges(pixels, yards, slopes), F.col("u"), F.col("v"), "number_near", "number_far", NUMBER_NEAR_INSIDE_Y, NUMBER_FAR_INSIDE_Y)
    return hashes.unionByName(edges).unionByName(numbers)


def number_edges(pixels: DataFrame, yards: DataFrame, slopes: DataFrame, k: int = 5, margin: float = 30) -> DataFrame:
    """Inner edge of each painted number on its yard line: the k-th extreme pixel along
    the row's slope, kept if it lands near the number's own pixels."""
    num = pixels.where(F.col("ch") == NUMBER).join(slopes, [*FRAME, "row"])
    key = [*FRAME, "comp", "cls", "row"]
    c = F.col("py") - F.col("slope") * F.col("px")
    inward = F.when(F.col("row") == 0, c).otherwise(-c)
    ranked = num.withColumn("_c", c).withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(inward)))
    edge = ranked.groupBy(*key, "slope").agg(
        F.count("*").alias("_n"), F.max(F.when(F.col("_k") == k + 1, F.col("_c"))).alias("a2"), F.min("px").alias("_x0"), F.max("px").alias("_x1"),
        F.min("py").alias("_y0"), F.max("py").alias("_y1")).where(F.col("_n") >= k + 2).withColumnRenamed("slope", "b2")
    met = L.line_crossings(yards, edge, [*FRAME, "cls"])
    return met.where(F.col("u").between(F.col("_x0") - margin, F.col("_x1") + margin) & F.col("v").between(F.col("_y0") - margin, F.col("_y1") + margin))
