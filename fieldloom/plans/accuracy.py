"""Queries that join fields with fields: accuracy, merging and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import boxes, ensemble, evaluate, merge
from fieldloom.plans import fixtures as fx
from fieldloom.plans.registry import query

CELL = 100.0
MEET = "a.xmax >= b.xmin AND a.xmin <= b.xmax AND a.ymax >= b.ymin AND a.ymin <= b.ymax"
SHARED = "(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))"
SIZE = lambda t: f"({t}.xmax - {t}.xmin) * ({t}.ymax - {t}.ymin)"
PAIRS = f"""{fx.REFERENCE}, {fx.PREDICTED}, raw AS (
  SELECT a.fid AS ref_id, b.fid AS pred_id, {SHARED} AS i, {SIZE('a')} AS ref_area, {SIZE('b')} AS pred_area FROM reference a JOIN predicted b ON {MEET}),
pairs AS (SELECT ref_id, pred_id, ref_area, pred_area, CASE WHEN ref_area + pred_area - i > 0 THEN i / (ref_area + pred_area - i) ELSE 0 END AS iou FROM raw),
matched AS (SELECT * FROM pairs WHERE iou >= 0.5),
best AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS matches, row_number() OVER (PARTITION BY ref_id ORDER BY iou DESC, pred_id) AS n FROM matched)"""


def _matched(spark, d, least=0.5):
    return evaluate.iou_pairs(fx.reference(spark, d), fx.predicted(spark, d), least, CELL)


@query("iou_pairs", f"WITH {PAIRS} SELECT ref_id, pred_id, round(iou, 6) AS iou FROM matched")
def iou_pairs(spark, d):
    return _matched(spark, d).select("ref_id", "pred_id", F.round("iou", 6).alias("iou"))


@query("best_match", f"WITH {PAIRS} SELECT ref_id, pred_id, round(iou, 6) AS iou, matches FROM best WHERE n = 1")
def best_match(spark, d):
    return evaluate.best_match(_matched(spark, d)).select("ref_id", "pred_id", F.round("iou", 6).alias("iou"), "matches")


METRICS = """counts AS (SELECT (SELECT count(*) FROM reference) AS n_ref, (SELECT count(*) FROM predicted) AS n_pred, (SELECT count(*) FROM best WHERE n = 1) AS tp,
  (SELECT count(DISTINCT pred_id) FROM best WHERE n = 1) AS hit, (SELECT avg(iou) FROM best WHERE n = 1) AS mean_iou, (SELECT avg(abs(ref_area - pred_area)) FROM best WHERE n = 1) AS area_error,
  (SELECT count(*) FROM best WHERE n = 1 AND matches > 1) AS over_n, (SELECT count(*) FROM (SELECT pred_id FROM matched GROUP BY 1 HAVING count(*) > 1)) AS under_n)"""


@query(
    "evaluate_metrics",
    f"""WITH {PAIRS}, {METRICS}, r AS (SELECT *, n_pred - hit AS fp, n_ref - tp AS fn, tp / CAST(tp + n_pred - hit AS DOUBLE) AS p, tp / CAST(n_ref AS DOUBLE) AS q FROM counts)
    SELECT round(mean_iou, 6) AS iou_mean, round(p, 6) AS "precision", round(q, 6) AS recall, round(2 * p * q / (p + q), 6) AS f1, round(over_n / CAST(n_ref AS DOUBLE), 6) AS over_segmentation,
    round(under_n / CAST(n_pred AS DOUBLE), 6) AS under_segmentation, round(area_error, 6) AS area_error_mean_m2, n_pred AS count_predicted, n_ref AS count_reference, tp AS count_tp, fp AS count_fp, fn AS count_fn, 0.5::DOUBLE AS iou_threshold FROM r""",
)
def evaluate_metrics(spark, d):
    return _rounded(evaluate.metrics(fx.reference(spark, d), fx.predicted(spark, d), 0.5, CELL))


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


EMPTY = """0.0::DOUBLE AS iou_mean, 0.0::DOUBLE AS "precision", 0.0::DOUBLE AS recall, 0.0::DOUBLE AS f1, 0.0::DOUBLE AS over_segmentation, 0.0::DOUBLE AS under_segmentation, 0.0::DOUBLE AS area_error_mean_m2,"""


@query(
    "evaluate_empty",
    f"""WITH {fx.REFERENCE}, {fx.PREDICTED}, r AS (SELECT count(*) AS n FROM reference), p AS (SELECT count(*) AS n FROM predicted)
    SELECT 'both' AS side, {EMPTY.replace('0.0::DOUBLE AS', '1.0::DOUBLE AS', 4)} CAST(0 AS BIGINT) AS count_predicted, CAST(0 AS BIGINT) AS count_reference, CAST(0 AS BIGINT) AS count_tp, CAST(0 AS BIGINT) AS count_fp, CAST(0 AS BIGINT) AS count_fn, 0.4::DOUBLE AS iou_threshold
    UNION ALL SELECT 'predicted', {EMPTY} 0, n, 0, 0, n, 0.4 FROM r UNION ALL SELECT 'reference', {EMPTY} n, 0, 0, n, 0, 0.4 FROM p""",
)
def evaluate_empty(spark, d):
    ref, pred = fx.reference(spark, d), fx.predicted(spark, d)
    none = lambda t: t.where("fid < 0")
    cases = {"both": (none(ref), none(pred)), "predicted": (ref, none(pred)), "reference": (none(ref), pred)}
    out = None
    for side, (a, b) in cases.items():
        one = evaluate.metrics(a, b, 0.4, CELL).select(F.lit(side).alias("side"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "segmentation_rates",
    f"""WITH {PAIRS}, r AS (SELECT ref_id, count(*) AS n FROM matched3 GROUP BY 1), p AS (SELECT pred_id, count(*) AS n FROM matched3 GROUP BY 1)
    SELECT (SELECT count(*) FROM r WHERE n > 1) AS over_n, (SELECT count(*) FROM p WHERE n > 1) AS under_n""".replace("best AS (", "matched3 AS (SELECT * FROM pairs WHERE iou >= 0.3), best AS ("),
)
def segmentation_rates(spark, d):
    pairs = _matched(spark, d, 0.3)
    many = lambda key, name: pairs.groupBy(key).count().agg(F.count(F.when(F.col("count") > 1, 1)).alias(name))
    return many("ref_id", "over_n").crossJoin(many("pred_id", "under_n"))  # one row each


@query("unmatched_fields", f"WITH {PAIRS} SELECT 'reference' AS side, fid FROM reference WHERE fid NOT IN (SELECT ref_id FROM best WHERE n = 1) UNION ALL SELECT 'predicted', fid FROM predicted WHERE fid NOT IN (SELECT pred_id FROM best WHERE n = 1)")
def unmatched_fields(spark, d):
    best = evaluate.best_match(_matched(spark, d))
    left = fx.reference(spark, d).join(best, F.col("fid") == F.col("ref_id"), "left_anti").select(F.lit("reference").alias("side"), "fid")
    return left.unionByName(fx.predicted(spark, d).join(best, F.col("fid") == F.col("pred_id"), "left_anti").select(F.lit("predicted").alias("side"), "fid"))


LINKS = f"""links AS (SELECT a.fid AS a, b.fid AS b, {SHARED} / ({SIZE('a')} + {SIZE('b')} - {SHARED}) AS iou, {SHARED} / least({SIZE('a')}, {SIZE('b')}) AS containment
  FROM crossing a JOIN crossing b ON {MEET} AND a.fid < b.fid)"""
PICKED = "picked AS (SELECT * FROM links WHERE iou >= 0.3 OR containment >= 0.8)"
REACH = """step AS MATERIALIZED (SELECT a, b FROM {links} UNION ALL SELECT b, a FROM {links}),
reach(fid, other) AS (SELECT fid, fid FROM crossing UNION SELECT r.fid, l.b FROM reach r JOIN step l ON l.a = r.other),
roots AS (SELECT fid, min(other) AS root FROM reach GROUP BY fid)"""
#: Area of a union of boxes per group: strips between the group's x edges, and in each the covered length of y.
UNION_AREA = """edges AS (SELECT DISTINCT {key}, x FROM (SELECT {key}, xmin AS x FROM {src} UNION ALL SELECT {key}, xmax FROM {src})),
strips AS (SELECT {key}, x AS x0, lead(x) OVER (PARTITION BY {key} ORDER BY x) AS x1 FROM edges),
near AS (SELECT *, unnest(range(CAST(floor(xmin / 100) AS BIGINT), CAST(floor(xmax / 100) AS BIGINT) + 1)) AS bx FROM {src}),
live AS (SELECT s.{key}, s.x0, s.x1, f.ymin, f.ymax, max(f.ymax) OVER (PARTITION BY s.{key}, s.x0 ORDER BY f.ymin, f.ymax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high
  FROM strips s JOIN near f ON f.{key} = s.{key} AND f.bx = CAST(floor(s.x0 / 100) AS BIGINT) AND f.xmin <= s.x0 AND f.xmax >= s.x1 WHERE s.x1 IS NOT NULL),
areas AS (SELECT {key}, sum((x1 - x0) * greatest(0, ymax - greatest(ymin, coalesce(high, ymin)))) AS union_area FROM live GROUP BY {key})"""


@query("merge_pairs", f"WITH {fx.OVERLAPS}, {LINKS}, {PICKED} SELECT a, b, round(iou, 6) AS iou, round(containment, 6) AS containment FROM picked")
def merge_pairs(spark, d):
    return _rounded(merge.merge_pairs(fx.overlaps(spark, d), 50.0))


@query("merge_components", f"WITH RECURSIVE {fx.OVERLAPS}, {LINKS}, {PICKED}, {REACH.format(links='picked')} SELECT fid, root FROM roots")
def merge_components(spark, d):
    return merge.merge_roots(fx.overlaps(spark, d), 50.0)


GROUPED = "SELECT {key} AS fid, count(*) AS member_count, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, any_value(union_area) AS union_area FROM {src} JOIN areas USING ({key}) GROUP BY {key}"


@query(
    "merge_polygons",
    f"WITH RECURSIVE {fx.OVERLAPS}, {LINKS}, {PICKED}, {REACH.format(links='picked')}, member AS (SELECT root, xmin, ymin, xmax, ymax FROM crossing JOIN roots USING (fid)), {UNION_AREA.format(key='root', src='member')} {GROUPED.format(key='root', src='member')}",
)
def merge_polygons(spark, d):
    return merge.merge_fields(fx.overlaps(spark, d), 50.0)


@query("merge_groups", f"WITH {fx.OVERLAPS}, {UNION_AREA.format(key='engine', src='crossing')} {GROUPED.format(key='engine', src='crossing').replace('AS fid', 'AS engine')}")
def merge_groups(spark, d):
    return merge.dissolve(fx.overlaps(spark, d), "engine", 200.0)


@query("aoi_union_area", f"WITH {fx.PREDICTED}, member AS (SELECT fid % 3 AS part, xmin, ymin, xmax, ymax FROM predicted), {UNION_AREA.format(key='part', src='member')} SELECT part, union_area FROM areas")
def aoi_union_area(spark, d):
    return merge.union_area(fx.predicted(spark, d).withColumn("part", F.col("fid") % 3), "part", 200.0)


TOUCHED = f"shared AS (SELECT a, b FROM (SELECT a.fid AS a, b.fid AS b, {SHARED} AS i FROM crossing a JOIN crossing b ON {MEET} AND a.fid < b.fid) WHERE i > 0)"


@query(
    "ensemble_union",
    f"WITH RECURSIVE {fx.OVERLAPS}, {TOUCHED}, {REACH.format(links='shared')}, member AS (SELECT root, xmin, ymin, xmax, ymax FROM crossing JOIN roots USING (fid)), {UNION_AREA.format(key='root', src='member')}, "
    f"g AS ({GROUPED.format(key='root', src='member')}) SELECT fid AS root, member_count, xmin, ymin, xmax, ymax, union_area, 3 AS engine_count FROM g",
)
def ensemble_union(spark, d):
    return ensemble.union(fx.overlaps(spark, d), 50.0, 3)


@query(
    "ensemble_intersection",
    f"""WITH {fx.OVERLAPS}, two AS (SELECT a.fid AS fid_1, b.fid AS fid_2, greatest(a.xmin, b.xmin) AS xmin, greatest(a.ymin, b.ymin) AS ymin, least(a.xmax, b.xmax) AS xmax, least(a.ymax, b.ymax) AS ymax
      FROM crossing a JOIN crossing b ON a.engine = 'A' AND b.engine = 'N' AND a.xmax > b.xmin AND a.xmin < b.xmax AND a.ymax > b.ymin AND a.ymin < b.ymax)
    SELECT fid_1, fid_2, xmin, ymin, xmax, ymax, 2 AS engine_count FROM two""",
)
def ensemble_intersection(spark, d):
    f = fx.overlaps(spark, d)
    both = ensemble.intersection([f.where("engine = 'A'"), f.where("engine = 'N'")], 50.0)
    return both.select("fid_1", "fid_2", *boxes.flat(F.col("box")), "engine_count")


VOTES = """cells AS (SELECT engine, unnest(range(CAST(ceil(xmin / 10 - 0.5) AS BIGINT), CAST(ceil(xmax / 10 - 0.5) AS BIGINT))) AS col, ymin, ymax FROM crossing),
  pixels AS (SELECT engine, col, unnest(range(CAST(ceil(ymin / 10 - 0.5) AS BIGINT), CAST(ceil(ymax / 10 - 0.5) AS BIGINT))) AS row FROM cells)"""


@query("ensemble_vote", f"WITH {fx.OVERLAPS}, {VOTES} SELECT row, col, count(DISTINCT engine) AS votes FROM pixels GROUP BY row, col HAVING count(DISTINCT engine) >= 2")
def ensemble_vote(spark, d):
    return ensemble.vote(fx.overlaps(spark, d), 3, 0.5, 10.0)


@query("rasterize_boxes", f"WITH {fx.OVERLAPS}, {VOTES} SELECT DISTINCT row, col FROM pixels")
def rasterize_boxes(spark, d):
    return ensemble.covered(fx.overlaps(spark, d).select("box"), 10.0)


@query(
    "polygonize_components",
    f"""WITH RECURSIVE {fx.GRID}, reach(fid, other) AS (SELECT row * 25 + col, row * 25 + col FROM grid
      UNION SELECT r.fid, b.row * 25 + b.col FROM reach r JOIN grid a ON a.row * 25 + a.col = r.other JOIN grid b ON b.label = a.label AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
    roots AS (SELECT fid, min(other) AS root FROM reach GROUP BY fid)
    SELECT root, any_value(label) AS value, count(*) AS pixels, min(row) AS row0, min(col) AS col0, max(row) AS row1, max(col) AS col1 FROM roots JOIN grid ON row * 25 + col = fid GROUP BY root""",
)
def polygonize_components(spark, d):
    found = ensemble.regions(fx.label_grid(spark, d), "label", 4, 25)
    return found.groupBy("root").agg(
        F.first("label").alias("value"), F.count("*").alias("pixels"), F.min("row").alias("row0"), F.min("col").alias("col0"), F.max("row").alias("row1"), F.max("col").alias("col1")
    )
