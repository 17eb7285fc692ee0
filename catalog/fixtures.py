"""Reference-shaped tables derived from the driver's parquet, in Spark and in SQL.

Clips stand for plays: 22 tracks or 500 frames each, so their number grows with the
data. Frame numbers come from integer keys, so no window is needed to build them,
except for tracks, where the row position per user is computed piecewise.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmotion.operators.ordered import numbered

TRACKS_PER_CLIP = 22
FRAMES_PER_CLIP = 500

# Y of each correspondence kind, in yards.
KIND_Y = {
    "near_hash": 23.583,
    "far_hash": 29.747,
    "sideline_near": 0.0,
    "sideline_far": 53.33,
    "number_near": 14.0,
    "number_far": 39.33,
}


def idiv(a, n):
    """Integer division of a non-negative integer column."""
    return F.floor(a / F.lit(n)).cast("long")


def corr_id():
    """printf('%012d-%d-%08d-%06d-%.2f') of a lineitem's keys and price. Plain padding gives
    the text of usual keys at a fraction of the cost; unusual ones go through the formatter."""
    def padded(name, width):
        return F.lpad(F.col(name).cast("string"), width, "0")

    keys = {"l_orderkey": 12, "l_partkey": 8, "l_suppkey": 6}
    usual = F.col("p").between(0.0, 9e9) & (F.col("l_linenumber") >= 0)
    for name, width in keys.items():
        usual = usual & F.col(name).between(0, 10**width - 1)
    price = F.col("p").cast("decimal(12,2)").cast("string")
    return F.when(usual, F.concat_ws("-", padded("l_orderkey", 12), F.col("l_linenumber").cast("string"),
                                     padded("l_partkey", 8), padded("l_suppkey", 6), price)).otherwise(
        F.format_string("%012d-%d-%08d-%06d-%.2f", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p"))


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def points(self) -> DataFrame:
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
        ev = self.table("events").select(
            "event_id", F.col("user_id").alias("track_id"), "event_type", "value", k.alias("k"))
        n = numbered(ev, ["track_id"], "event_id", "frame_idx")
        return n.select(
            F.concat(F.lit("c"), idiv(F.col("track_id"), TRACKS_PER_CLIP)).alias("clip"),
            "track_id", "frame_idx", "event_id",
            (F.col("value") % 120).alias("x"),
            (10 + 0.3 * F.col("frame_idx") + (F.col("value") % 7) / 10).alias("xs"),
            (F.col("k") * F.lit(0.5333)).alias("y"),
            ((F.col("event_id") % 100) / 100.0).alias("confidence"),
            (~((F.col("event_type") == "error") & (F.col("event_id") % 4 == 0))).alias("measured"),
            F.col("value"),
        )

    @cached_property
    def truth(self) -> DataFrame:
        f = F.col("frame_idx")
        return self.points.where(f % 3 == 0).select(
            "clip", (F.col("track_id") + 1000).alias("player_id"),
            (idiv(f, 3) + 100).cast("int").alias("frame"),
            (F.col("xs") + ((F.col("event_id") * 13) % 11 - 5) / 50.0).alias("x"),
            "y", (F.col("value") % 10).alias("s"),
            F.when(f == 12, F.lit("ball_snap")).alias("event"),
            F.concat(F.lit("P"), (F.col("track_id") + 1000)).alias("display_name"),
            (F.col("track_id") % 99 + 1).cast("int").alias("jersey"),
            F.when(F.col("track_id") % 2 == 0, F.lit("QB")).otherwise(F.lit("CB")).alias("position"),
            F.when(F.col("track_id") % 22 < 11, F.lit("AAA")).otherwise(F.lit("BBB")).alias("team"),
        )

    @cached_property
    def frames(self) -> DataFrame:
        """Per-frame homographies: clip, frame_idx, h (9 doubles or NULL), method, rmse."""
        o = self.table("orders").select(
            "o_orderkey", "o_orderstatus", "o_orderpriority",
            F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
        f = (F.col("o_orderkey") % FRAMES_PER_CLIP).cast("int")
        e = (F.col("cents") % 1000) * F.lit(4e-7)
        h = F.array(0.08 + e, F.lit(0.002), 5 + 0.01 * f, F.lit(0.001), 0.07 - e, F.lit(-3.0),
                    F.lit(1e-5), F.lit(2e-5), F.lit(1.0))
        lost = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 10 == 0)
        p = F.substring("o_orderpriority", 1, 1)
        return o.select(
            F.concat(F.lit("c"), idiv(F.col("o_orderkey"), FRAMES_PER_CLIP)).alias("clip"),
            f.alias("frame_idx"), F.when(~lost, h).alias("h"),
            F.when(p == "5", F.lit("carry")).when(p == "4", F.lit("delta"))
            .otherwise(F.lit("full")).alias("method"),
            ((F.col("cents") % 1000) / 3000.0).alias("rmse"),
            (F.col("cents") % 30).cast("int").alias("n_corrs"),
            F.when(F.col("cents") % 7 > 0, (90 + F.col("cents") % 11) / 100.0).alias("inlier_frac"),
            F.when(F.col("cents") % 5 > 0, (F.col("cents") % 9 + 2).cast("int")).alias("n_yard_fits"),
        )

    @cached_property
    def boxes(self) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        x1, y1 = F.col("l_quantity") * 22, F.col("l_extendedprice") % 600
        return self.table("lineitem").select(
            F.concat(F.lit("c"), idiv(F.col("l_orderkey"), FRAMES_PER_CLIP)).alias("clip"),
            (F.col("l_orderkey") % FRAMES_PER_CLIP).cast("int").alias("frame_idx"),
            (F.row_number().over(w) - 1).cast("int").alias("det_idx"),
            x1.alias("x1"), y1.alias("y1"),
            (x1 + 20 + 400 * F.col("l_discount")).alias("x2"),
            (y1 + 60 + 1000 * F.col("l_tax")).alias("y2"),
            (0.2 + 8 * F.col("l_discount")).alias("confidence"),
            F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        )

    @cached_property
    def corrs(self) -> DataFrame:
        li = self.table("lineitem")
        kind = (
            F.when(F.col("l_linestatus") == "F",
                   F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2))
            .otherwise(F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "N", 4).otherwise(5)))
        names = ["sideline_near", "number_near", "near_hash", "far_hash", "number_far", "sideline_far"]
        base = li.select(
            F.concat(F.lit("c"), idiv(F.col("l_orderkey"), 4 * FRAMES_PER_CLIP)).alias("clip"),
            idiv(F.col("l_orderkey") % (4 * FRAMES_PER_CLIP), 4).cast("int").alias("frame_idx"),
            (F.col("l_partkey") % 21).cast("int").alias("slot"), kind.alias("ki"),
            F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        y = F.array(*[F.lit(KIND_Y[n]) for n in names])
        return base.select(
            "clip", "frame_idx", "slot",
            F.element_at(F.array(*[F.lit(n) for n in names]), F.col("ki") + 1).alias("kind"),
            (40 * F.col("slot") + (F.col("q") % 10) * 3).alias("u"),
            (100 * F.col("ki") + F.col("p") % 60).alias("v"),
            (10.0 + 5 * F.col("slot")).alias("fx"),
            F.element_at(y, F.col("ki") + 1).alias("fy"),
            corr_id().alias("corr_id"),
        )

    @cached_property
    def pixels(self) -> DataFrame:
        """Labelled mask pixels: ch 0 yard, 1 side, 2 hash, 3 number; comp 0..4."""
        r, q = F.floor("l_extendedprice").cast("int"), F.col("l_quantity").cast("int")
        comp = (F.col("l_partkey") % 5).cast("int")
        ln = F.col("l_linenumber")
        ch = F.when(ln <= 3, 0).when(ln == 4, 1).when(ln == 5, 2).otherwise(3)
        side_x = 40 + (r % 60) * 15
        px = (F.when(ln <= 3, 200 * comp + 100 + idiv(r % 24, 4) + q % 2)
              .when(ln == 4, side_x)
              .when(ln == 5, 200 * comp + 100 + r % 7)
              .otherwise(200 * comp + 90 + r % 31))
        py = (F.when(ln <= 3, 300 + r % 24)
              .when(ln == 4, 40 + 600 * (comp % 2) + idiv(side_x, 50) + q % 2)
              .when(ln == 5, 250 + 80 * (comp % 2) + q % 5)
              .otherwise(180 + 300 * (comp % 2) + q % 20))
        ok = F.col("l_orderkey")
        return self.table("lineitem").select(
            F.concat(F.lit("c"), idiv(ok, 12800)).alias("clip"),
            idiv(ok % 12800, 128).cast("int").alias("frame_idx"),
            ch.alias("ch"), comp.alias("comp"), px.cast("int").alias("px"), py.cast("int").alias("py"),
            (0.5 + 5 * F.col("l_discount")).alias("prob"),
            (2 * comp + 2).alias("cls"), (comp % 2).cast("int").alias("row"),
            r.alias("raw"),
        )

    @cached_property
    def hsv(self) -> DataFrame:
        ok = F.col("l_orderkey")
        return self.table("lineitem").select(
            F.concat(F.lit("c"), idiv(F.col("l_suppkey"), TRACKS_PER_CLIP)).alias("clip"),
            F.col("l_suppkey").alias("track_id"),
            (F.col("l_partkey") % 180).cast("int").alias("h"),
            ((ok * 7) % 256).cast("int").alias("s"),
            ((F.col("l_linenumber") * 37 + ok) % 256).cast("int").alias("v"),
            idiv(ok, 3000).cast("int").alias("sample"),
        )

    @cached_property
    def sigs(self) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        return self.table("embeddings").select(
            F.concat(F.lit("c"), idiv(F.col("vec_id"), TRACKS_PER_CLIP)).alias("clip"),
            F.col("vec_id").alias("track_id"), v.alias("sig"),
            F.slice(v, 1, 21).alias("logits"), "label")

    @cached_property
    def decided(self) -> DataFrame:
        d = self.table("documents").select("doc_id", "source", "lang", "n_chars")
        q = F.col("quality")
        return d.join(self.table("labels"), "doc_id", "left").select(
            F.col("doc_id").alias("id"), F.col("source").alias("clip"), F.col("lang").alias("game"),
            (F.when(F.col("n_chars") < 200, 0).when(F.col("n_chars") < 1000, 1)
             .when(F.col("n_chars") < 5000, 2).otherwise(3)).alias("stratum"),
            F.when(q == 1, F.lit("y")).when(q == 0, F.lit("n")).alias("decision"),
            (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("old_red"),
            (F.coalesce(q, F.lit(1)) == 0).alias("new_red"),
            (F.col("doc_id") % 300).cast("int").alias("frame_idx"),
            F.col("n_chars"),
        )

    @cached_property
    def views(self) -> DataFrame:
        ev = self.table("events").select("event_id", "user_id", "event_type")
        n = numbered(ev, ["user_id"], "event_id", "sec")
        t = F.col("event_type")
        return n.select(
            F.col("user_id").alias("clip"), "sec",
            F.when(t.isin("click", "view"), F.lit("sideline"))
            .when(t == "error", F.lit("scoreboard")).otherwise(F.lit("endzone")).alias("label"),
            ((F.col("event_id") * 37) % 100 / 100.0).alias("conf"))

    @cached_property
    def labels(self) -> DataFrame:
        off = F.when(F.col("l_suppkey") % 9 == 0, 1).otherwise(0)
        ok = F.col("l_orderkey")
        return self.table("lineitem").select(
            F.concat(F.lit("c"), idiv(ok, FRAMES_PER_CLIP)).alias("clip"),
            (ok % FRAMES_PER_CLIP).cast("int").alias("frame_idx"),
            (F.col("l_linenumber") % 4).cast("int").alias("type"),
            (F.col("l_partkey") % 22 - 1).cast("int").alias("true_class"),
            ((F.col("l_partkey") + off) % 22 - 1).cast("int").alias("pred_class"),
            (ok % 2).cast("int").alias("true_row"),
            ((ok + off) % 2).cast("int").alias("pred_row"),
            F.col("l_quantity").alias("q"),
        )

    @cached_property
    def yards(self) -> DataFrame:
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
        return self.table("events").select(
            "event_id", (F.col("value") % 120).alias("x"), (k * F.lit(0.5333)).alias("y"),
            "user_id", k.alias("k"), F.col("value"))

    @cached_property
    def paths(self) -> DataFrame:
        d = F.col("doc_id")
        return self.table("documents").select(
            F.col("doc_id"),
            F.concat((2019092200 + d % 20).cast("string"), F.lit("/play_"),
                     F.lpad((idiv(d, 20) % 1000).cast("string"), 3, "0"), F.lit("/"),
                     F.when(d % 3 == 0, F.lit("endzone")).otherwise(F.lit("sideline")),
                     F.lit(".mp4")).alias("path"),
            (d % 300).cast("int").alias("frame_idx"), F.col("n_chars"))


def _kind_case(names, col):
    return "CASE " + " ".join(f"WHEN {col}={i} THEN {n}" for i, n in enumerate(names)) + " END"


_KINDS = ["sideline_near", "number_near", "near_hash", "far_hash", "number_far", "sideline_far"]

CTES = {
    "fx_points": """SELECT 'c'||CAST(floor(track_id/22) AS BIGINT) AS clip, track_id, frame_idx, event_id,
        value % 120 AS x, 10 + 0.3e0*frame_idx + (value % 7)/10 AS xs, k*0.5333e0 AS y,
        (event_id % 100)/100e0 AS confidence,
        NOT (event_type = 'error' AND event_id % 4 = 0) AS measured, value
      FROM (SELECT user_id AS track_id, event_id, event_type, value,
              CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
              CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS frame_idx
            FROM events)""",
    "fx_truth": """SELECT clip, track_id + 1000 AS player_id, CAST(floor(frame_idx/3) + 100 AS INT) AS frame,
        xs + ((event_id*13) % 11 - 5)/50e0 AS x, y, value % 10 AS s,
        CASE WHEN frame_idx = 12 THEN 'ball_snap' END AS event,
        'P'||(track_id + 1000) AS display_name, CAST(track_id % 99 + 1 AS INT) AS jersey,
        CASE WHEN track_id % 2 = 0 THEN 'QB' ELSE 'CB' END AS position,
        CASE WHEN track_id % 22 < 11 THEN 'AAA' ELSE 'BBB' END AS team
      FROM fx_points WHERE frame_idx % 3 = 0""",
    "fx_frames": """SELECT clip, frame_idx,
        CASE WHEN NOT lost THEN [0.08e0+e, 0.002e0, 5e0+0.01e0*frame_idx, 0.001e0, 0.07e0-e, -3e0, 1e-5, 2e-5, 1e0] END AS h,
        CASE substr(o_orderpriority,1,1) WHEN '5' THEN 'carry' WHEN '4' THEN 'delta' ELSE 'full' END AS method,
        (cents % 1000)/3000e0 AS rmse, CAST(cents % 30 AS INT) AS n_corrs,
        CASE WHEN cents % 7 > 0 THEN (90 + cents % 11)/100e0 END AS inlier_frac,
        CASE WHEN cents % 5 > 0 THEN CAST(cents % 9 + 2 AS INT) END AS n_yard_fits
      FROM (SELECT 'c'||CAST(floor(o_orderkey/500) AS BIGINT) AS clip, CAST(o_orderkey % 500 AS INT) AS frame_idx,
              CAST(round(o_totalprice*100) AS BIGINT) AS cents, o_orderpriority,
              (CAST(round(o_totalprice*100) AS BIGINT) % 1000)*4e-7 AS e,
              o_orderstatus = 'P' AND o_orderkey % 10 = 0 AS lost FROM orders)""",
    "fx_boxes": """SELECT 'c'||CAST(floor(l_orderkey/500) AS BIGINT) AS clip, CAST(l_orderkey % 500 AS INT) AS frame_idx,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS det_idx,
        l_quantity*22 AS x1, l_extendedprice % 600 AS y1,
        l_quantity*22 + 20 + 400*l_discount AS x2, l_extendedprice % 600 + 60 + 1000*l_tax AS y2,
        0.2e0 + 8*l_discount AS confidence, l_partkey AS part, l_suppkey AS supp FROM lineitem""",
    "fx_corrs": f"""SELECT clip, frame_idx, slot, {_kind_case([f"'{n}'" for n in _KINDS], 'ki')} AS kind,
        40*slot + (q % 10)*3 AS u, 100*ki + p % 60 AS v, 10e0 + 5*slot AS fx,
        {_kind_case([repr(KIND_Y[n]) + 'e0' for n in _KINDS], 'ki')} AS fy, corr_id
      FROM (SELECT 'c'||CAST(floor(l_orderkey/2000) AS BIGINT) AS clip,
              CAST(floor((l_orderkey % 2000)/4) AS INT) AS frame_idx, CAST(l_partkey % 21 AS INT) AS slot,
              CASE l_linestatus WHEN 'F' THEN CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END
                ELSE CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 4 ELSE 5 END END AS ki,
              l_quantity AS q, l_extendedprice AS p,
              printf('%012d-%d-%08d-%06d-%.2f', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS corr_id
            FROM lineitem)""",
    "fx_pixels": """SELECT clip, frame_idx, ch, comp,
        CAST(CASE ch WHEN 0 THEN 200*comp + 100 + floor((r % 24)/4) + q % 2
          WHEN 1 THEN 40 + (r % 60)*15 WHEN 2 THEN 200*comp + 100 + r % 7
          ELSE 200*comp + 90 + r % 31 END AS INT) AS px,
        CAST(CASE ch WHEN 0 THEN 300 + r % 24
          WHEN 1 THEN 40 + 600*(comp % 2) + floor((40 + (r % 60)*15)/50) + q % 2
          WHEN 2 THEN 250 + 80*(comp % 2) + q % 5 ELSE 180 + 300*(comp % 2) + q % 20 END AS INT) AS py,
        0.5e0 + 5*l_discount AS prob, CAST(2*comp + 2 AS INT) AS cls, CAST(comp % 2 AS INT) AS row, r AS raw
      FROM (SELECT 'c'||CAST(floor(l_orderkey/12800) AS BIGINT) AS clip,
              CAST(floor((l_orderkey % 12800)/128) AS INT) AS frame_idx,
              CASE WHEN l_linenumber <= 3 THEN 0 WHEN l_linenumber = 4 THEN 1 WHEN l_linenumber = 5 THEN 2 ELSE 3 END AS ch,
              CAST(l_partkey % 5 AS INT) AS comp, CAST(floor(l_extendedprice) AS INT) AS r,
              CAST(l_quantity AS INT) AS q, l_discount FROM lineitem)""",
    "fx_hsv": """SELECT 'c'||CAST(floor(l_suppkey/22) AS BIGINT) AS clip, l_suppkey AS track_id,
        CAST(l_partkey % 180 AS INT) AS h, CAST((l_orderkey*7) % 256 AS INT) AS s,
        CAST((l_linenumber*37 + l_orderkey) % 256 AS INT) AS v,
        CAST(floor(l_orderkey/3000) AS INT) AS sample FROM lineitem""",
    "fx_sigs": """SELECT 'c'||CAST(floor(vec_id/22) AS BIGINT) AS clip, vec_id AS track_id,
        CAST(embedding AS DOUBLE[]) AS sig, CAST(embedding AS DOUBLE[])[1:21] AS logits, label FROM embeddings""",
    "fx_decided": """SELECT d.doc_id AS id, source AS clip, lang AS game,
        CASE WHEN n_chars < 200 THEN 0 WHEN n_chars < 1000 THEN 1 WHEN n_chars < 5000 THEN 2 ELSE 3 END AS stratum,
        CASE quality WHEN 1 THEN 'y' WHEN 0 THEN 'n' END AS decision,
        coalesce(toxic, 0) = 1 AS old_red, coalesce(quality, 1) = 0 AS new_red,
        CAST(d.doc_id % 300 AS INT) AS frame_idx, n_chars
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "fx_views": """SELECT user_id AS clip,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS sec,
        CASE WHEN event_type IN ('click','view') THEN 'sideline' WHEN event_type = 'error' THEN 'scoreboard' ELSE 'endzone' END AS label,
        (event_id*37) % 100 / 100e0 AS conf FROM events""",
    "fx_labels": """SELECT 'c'||CAST(floor(l_orderkey/500) AS BIGINT) AS clip, CAST(l_orderkey % 500 AS INT) AS frame_idx,
        CAST(l_linenumber % 4 AS INT) AS type, CAST(l_partkey % 22 - 1 AS INT) AS true_class,
        CAST((l_partkey + CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END) % 22 - 1 AS INT) AS pred_class,
        CAST(l_orderkey % 2 AS INT) AS true_row,
        CAST((l_orderkey + CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END) % 2 AS INT) AS pred_row,
        l_quantity AS q FROM lineitem""",
    "fx_yards": """SELECT event_id, value % 120 AS x,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)*0.5333e0 AS y, user_id,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, value FROM events""",
    "fx_paths": """SELECT doc_id, (2019092200 + doc_id % 20)||'/play_'||lpad(CAST(CAST(floor(doc_id/20) AS BIGINT) % 1000 AS VARCHAR), 3, '0')||'/'||
        CASE WHEN doc_id % 3 = 0 THEN 'endzone' ELSE 'sideline' END||'.mp4' AS path,
        CAST(doc_id % 300 AS INT) AS frame_idx, n_chars FROM documents""",
}
