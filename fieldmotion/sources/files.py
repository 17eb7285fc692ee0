"""Readers and writers for tracking, truth, manifest, ledger and label files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmotion.operators.reliable import stage

TRUTH_SCHEMA = T.StructType([
    T.StructField("frame", T.IntegerType()), T.StructField("nflId", T.LongType()),
    T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("s", T.DoubleType()),
    T.StructField("event", T.StringType()), T.StructField("displayName", T.StringType()),
    T.StructField("jerseyNumber", T.IntegerType()), T.StructField("position", T.StringType()),
    T.StructField("teamAbbr", T.StringType()),
])

ENTRY = T.StructType([
    T.StructField("frame_idx", T.IntegerType()), T.StructField("stratum", T.IntegerType()),
    T.StructField("n_corrs", T.IntegerType()), T.StructField("inlier_frac", T.DoubleType()),
    T.StructField("mean_ngs_x", T.DoubleType()), T.StructField("ngs_x_range", T.DoubleType()),
    T.StructField("H", T.ArrayType(T.ArrayType(T.DoubleType()))),
])

INTRINSICS = T.StructType([
    T.StructField("K", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("dist", T.ArrayType(T.DoubleType())),
])

SCORE_COLUMNS = [
    "track_id", "nfl_id", "player", "jersey", "pos", "team", "n_obs", "n_overlap_frames",
    "match_cost_yd", "pos_rmse_yd", "pos_mean_yd", "pos_p50_yd", "pos_p90_yd", "speed_rmse_yds",
    "speed_corr", "speed_mean_us_yds", "speed_mean_ngs_yds", "accel_rmse_yds2", "accel_corr",
]


def read_truth(spark: SparkSession, path: str, schema: T.StructType = TRUTH_SCHEMA) -> DataFrame:
    """Tab-separated sensor truth; rows without a player are dropped."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema).where(F.col("nflId").isNotNull())


def three_decimals(x: Column) -> Column:
    """Text with three decimals of the exact binary value, as C and Python print it
    (Spark's own formatting rounds the shortest decimal instead)."""
    k = F.floor(x * 1000).cast("double")
    tie = (2 * k + 1) / 2000
    # exact sign of tie - (2k+1)/2000: powers of two keep every step free of rounding
    above = ((tie * 2048 - (2 * k + 1)) - tie * 32) - tie * 16
    up = (x > tie) | ((x == tie) & ((above > 0) | ((above == 0) & (F.abs(k) % 2 == 1))))
    return F.format_string("%.3f", (k + F.when(up, 1).otherwise(0)) / 1000.0)


def tracking_rows(df: DataFrame) -> DataFrame:
    """The published tracking columns: finite positions only, three decimals."""
    finite = ~(F.isnan("x_yd") | F.isnan("y_yd")) & (F.abs("x_yd") < float("inf")) & (F.abs("y_yd") < float("inf"))
    keep = [c for c in df.columns if c == "clip"]
    return df.where(F.coalesce(finite, F.lit(False))).select(
        *keep, "frame_idx", "track_id", three_decimals(F.col("x_yd")).alias("x_yd"),
        three_decimals(F.col("y_yd")).alias("y_yd"), F.coalesce("team", F.lit("unknown")).alias("team"),
        F.col("in_bad_run").cast("int").alias("in_bad_run"))


TRACKING = "frame_idx int, track_id bigint, x_yd double, y_yd double, team string, in_bad_run int"


def write_tracking(df: DataFrame, path: str, file_bytes: int = 128 << 20) -> None:
    """CSV files in the order of clip (where there is one), track and frame, each a range of
    that order of about ``file_bytes``, and a commit record of what was written.

    The number of files follows the bytes, not the clips; the record is written last, so
    an interrupted write is no table. An existing table is never replaced.
    """
    rows = stage(tracking_rows(df))
    order = [c for c in ("clip", "track_id", "frame_idx") if c in rows.columns]
    size = rows.agg(F.coalesce(F.sum(F.length(F.concat_ws(",", *rows.columns)) + 1), F.lit(0)).alias("n")).first()["n"]
    files = max(1, -(-int(size) // file_bytes))
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("errorifexists").csv(f"{path}/data", header=True)
    schema = ("clip string, " if "clip" in order else "") + TRACKING
    back = df.sparkSession.read.csv(f"{path}/data", header=True, schema=schema)
    ends = [f(F.struct(*order)).alias(n) for f, n in ((F.min, "first"), (F.max, "last"))]
    per_file = back.groupBy(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file")).agg(F.count("*").alias("n_rows"), *ends)
    per_file.coalesce(1).write.mode("errorifexists").json(f"{path}/commit")


def read_tracking(spark: SparkSession, path: str, clip: bool = True) -> DataFrame:
    """A committed tracking table; without its commit record the read fails."""
    record = spark.read.schema("file string, n_rows long").json(f"{path}/commit")
    rows = spark.read.csv(f"{path}/data", header=True, schema=("clip string, " if clip else "") + TRACKING)
    # files that no commit names, as those of a failed attempt, are not part of the table
    named = rows.withColumn("_file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return named.join(record.select(F.col("file").alias("_file")), "_file", "left_semi").drop("_file")


def write_scores(df: DataFrame, path: str) -> None:
    """Per-player scores with the fixed column order."""
    df.select(*SCORE_COLUMNS).write.csv(path, header=True)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    texts, counts = {"player", "pos", "team"}, {"track_id", "nfl_id", "jersey", "n_obs", "n_overlap_frames"}
    kind = lambda c: "string" if c in texts else "bigint" if c in counts else "double"
    return spark.read.csv(path, header=True, schema=", ".join(f"{c} {kind(c)}" for c in SCORE_COLUMNS))


def read_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Entries and camera intrinsics of manifest documents: (entries, intrinsics). A big
    manifest is better kept as one document per line (``multi_line=False``)."""
    entry = T.StructType([T.StructField("clip", T.StringType()), *ENTRY.fields])
    schema = T.StructType([T.StructField("entries", T.ArrayType(entry)),
                           T.StructField("intrinsics_by_clip", T.MapType(T.StringType(), INTRINSICS))])
    doc = spark.read.json(path, schema=schema, multiLine=multi_line)
    entries = doc.select(F.explode("entries").alias("e")).select("e.*")
    cameras = doc.select(F.explode("intrinsics_by_clip").alias("clip", "i")).select("clip", "i.K", "i.dist")
    return entries, cameras


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """A folder of per-clip JSON documents: entries of clips with status ok, with an id."""
    schema = T.StructType([T.StructField("clip", T.StringType()), T.StructField("tag", T.StringType()),
                           T.StructField("status", T.StringType()), T.StructField("entries", T.ArrayType(ENTRY)),
                           T.StructField("intrinsics", INTRINSICS)])
    ok = spark.read.json(path, schema=schema).where(F.col("status") == "ok")
    rows = ok.select("clip", "tag", F.explode("entries").alias("e")).select("clip", "tag", "e.*")
    return rows.withColumn("id", F.concat_ws("_", "tag", F.format_string("%04d", "frame_idx")))


def read_ledger(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Decisions maps of ledger documents: clip, frame_idx, decision. A big ledger is better
    kept as many documents, one a line (``multi_line=False``)."""
    doc = spark.read.json(path, schema="decisions map<string,string>", multiLine=multi_line)
    return ledger_rows(doc)


def ledger_rows(doc: DataFrame) -> DataFrame:
    rows = doc.select(F.explode("decisions").alias("key", "decision"))
    part = F.split("key", "#")
    return rows.select(part[0].alias("clip"), part[1].cast("int").alias("frame_idx"), "decision")


def read_blacklist(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    doc = spark.read.json(path, schema="bad_gt_keys array<string>", multiLine=multi_line)
    return doc.select(F.explode("bad_gt_keys").alias("frame_key"))


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Names from a text list; ``#`` starts a comment anywhere on a line."""
    name = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(name.alias("name")).where(F.col("name") != "")


def read_box_labels(spark: SparkSession, path: str, image: str = r"([^/]+)\.txt$") -> DataFrame:
    """Normalised box labels, one text file per image; ``image`` finds its name in the path."""
    return box_label_rows(spark.read.text(path), F.regexp_extract(F.input_file_name(), image, 1))


def box_label_rows(lines: DataFrame, image: Column) -> DataFrame:
    """Lines ``class cx cy w h`` to rows; blank lines are skipped."""
    part = F.split(F.trim("value"), r"\s+")
    names = ["cx", "cy", "w", "h"]
    return (lines.where(F.trim("value") != "")
            .select(image.alias("image"), part[0].cast("int").alias("class_id"),
                    *[part[i + 1].cast("double").alias(n) for i, n in enumerate(names)]))


def write_manifest(entries: DataFrame, path: str, config: dict, partial: bool = False) -> None:
    """Entries as JSON lines and a one-row header with counts and config. An existing
    manifest is never replaced, and a partial run writes none."""
    if partial:
        raise ValueError("a partial run must not write a manifest")
    entries.write.mode("errorifexists").json(f"{path}/entries")
    header = entries.agg(F.count("*").alias("n_total"), F.count_distinct("clip").alias("n_clips"))
    header.withColumn("config", F.lit(json.dumps(config, sort_keys=True))).write.mode("errorifexists").json(f"{path}/header")


def pack_frames(boxes: DataFrame, spine: DataFrame) -> DataFrame:
    """One row per frame of ``spine`` with its boxes in order; empty frames keep an
    empty array."""
    box = F.struct("det_idx", "x1", "y1", "x2", "y2", "confidence")
    packed = boxes.groupBy("clip", "frame_idx").agg(F.sort_array(F.collect_list(box)).alias("dets"))
    out = spine.select("clip", "frame_idx").join(packed, ["clip", "frame_idx"], "left")
    empty = F.filter("dets", lambda _: F.lit(False))
    return out.withColumn("dets", F.coalesce("dets", F.array().cast(packed.schema["dets"].dataType))).withColumn("n", F.size("dets"))


def frame_offsets(packed: DataFrame) -> DataFrame:
    """Start and end of each frame's boxes in the flat array of its clip."""
    from fieldmotion.operators.ordered import running

    out = running(packed, ["clip"], "frame_idx", {"end": ("sum", F.col("n").cast("long"))})
    return out.withColumn("begin", F.col("end") - F.col("n"))


def unpack_frames(packed: DataFrame) -> DataFrame:
    """Back to a row per box; empty frames give one row of NULLs."""
    return packed.select("clip", "frame_idx", F.explode_outer("dets").alias("d")).select("clip", "frame_idx", "d.*")


def fingerprint(*params: Column) -> Column:
    """Digest of the settings a stored result depends on."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in params]), 256)


def reusable(stored: DataFrame, wanted: DataFrame, settings: list[str]) -> DataFrame:
    """Wanted clips marked reusable where a stored result has the same settings."""
    print_ = fingerprint(*[F.col(s) for s in settings])
    have = stored.select("clip", print_.alias("_f")).distinct().withColumn("_hit", F.lit(True))
    out = wanted.withColumn("_f", print_).join(have, ["clip", "_f"], "left")
    return out.withColumn("reusable", F.coalesce("_hit", F.lit(False))).drop("_f", "_hit")


def pending(work: DataFrame, done: DataFrame, key: str = "clip") -> DataFrame:
    """Work whose output does not exist yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def per_frame_report(frames: DataFrame, columns: list[str], block: int = 1024) -> DataFrame:
    """Per-frame diagnostics nested under (clip, block of frames), so that a document
    stays small however long the clip is."""
    blocks = frames.withColumn("block", F.floor(F.col("frame_idx") / block).cast("int"))
    rows = F.sort_array(F.collect_list(F.struct("frame_idx", *columns)))
    return blocks.groupBy("clip", "block").agg(rows.alias("per_frame")).withColumn("n_frames", F.size("per_frame"))


def field_points(spark: SparkSession) -> DataFrame:
    """Every marking of the field: four points per yard line and the painted numbers."""
    from fieldmotion.functions import constants as K

    x = 10.0 + 5 * F.col("id")
    n = F.least(x - K.GOAL_LEFT, K.GOAL_RIGHT - x).cast("int")
    five = F.col("id") % 2 == 1
    tail = F.concat(F.lit("_"), n.cast("string"), F.when(five, F.lit("+5yd")).otherwise(F.lit("yd")))
    kinds = [("near_sideline", 0.0), ("near_hash", K.HASH_NEAR_Y), ("far_hash", K.HASH_FAR_Y), ("far_sideline", K.FIELD_WIDTH)]
    line = F.array(*[F.struct(F.lit(y).alias("y"), F.concat(F.lit(k), tail).alias("label")) for k, y in kinds])
    painted = (~five) & (F.col("id") > 0) & (F.col("id") < 20)
    number = F.array(*[F.struct(F.lit(y).alias("y"), F.concat(F.lit("number_"), n.cast("string")).alias("label"))
                       for y in (K.NUMBER_NEAR_Y, K.NUMBER_FAR_Y)])
    points = F.concat(line, F.when(painted, number).otherwise(F.slice(number, 1, 0)))
    return spark.range(K.YARD_LINES).select(F.col("id").cast("int").alias("slot"), x.alias("x"), F.explode(points).alias("p")).select("slot", "x", "p.y", "p.label")
