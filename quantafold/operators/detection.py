"""Operators on detected boxes and tables: suppression, matching, assignment, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..session import cut
from .grouped import per_group


def suppress(detections: DataFrame, page: list[str], threshold: float = 0.5, criterion: str = "iou") -> DataFrame:
    """Greedy non-maximum suppression per page: rows of *detections* (*page*, obj_id, box, score) that stay.

    In order of score (ties by obj_id) a box falls if an earlier one that stayed overlaps it by more
    than *threshold*: by 'iou', or as the share of the lesser box, 'iob'. A page's boxes go to one
    task; a page holds what fits on paper.
    """
    at, score, name = (detections.columns.index(c) for c in ("box", "score", "obj_id"))

    def run(rows: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for row in sorted(rows, key=lambda r: (-r[score], r[name])):
            b = row[at]
            mine = max(b["x1"] - b["x0"], 0) * max(b["y1"] - b["y0"], 0)
            for other in kept:
                o = other[at]
                inter = max(0, min(o["x1"], b["x1"]) - max(o["x0"], b["x0"])) * max(0, min(o["y1"], b["y1"]) - max(o["y0"], b["y0"]))
                base = mine + (o["x1"] - o["x0"]) * (o["y1"] - o["y0"]) - inter if criterion == "iou" else mine
                if base > 0 and inter / base > threshold:
                    break
            else:
                kept.append(row)
        return kept

    return per_group(detections, page, ["obj_id"], run, detections.schema)


def overlapping_pairs(a: DataFrame, b: DataFrame, page: list[str], measure: Callable[[str, str], Column] = B.iou, least: float = 0.0) -> DataFrame:
    """Pairs of boxes of one page: `a_id`, `b_id`, `overlap` above *least*; *a* and *b*: *page*, obj_id, box."""
    left = a.select(*page, F.col("obj_id").alias("a_id"), F.col("box").alias("a_box"))
    right = b.select(*page, F.col("obj_id").alias("b_id"), F.col("box").alias("b_box"))
    return left.join(right, page).withColumn("overlap", measure("a_box", "b_box")).filter(F.col("overlap") > least).select(*page, "a_id", "b_id", "overlap")


def drop_overlapped(tables: DataFrame, page: list[str], threshold: float = 0.3) -> DataFrame:
    """Tables of which more than *threshold* is covered by one of higher score (ties: smaller obj_id) fall;
    those that fall still count against others.
    """
    other = tables.select(*page, F.col("obj_id").alias("o_id"), F.col("box").alias("o_box"), F.col("score").alias("o_score"))
    better = (F.col("o_score") > F.col("score")) | ((F.col("o_score") == F.col("score")) & (F.col("o_id") < F.col("obj_id")))
    beaten = tables.join(other, page).filter(better & (B.covered("box", "o_box") > threshold)).select(*page, "obj_id").distinct()
    return tables.join(beaten, [*page, "obj_id"], "left_anti")


def best_container(items: DataFrame, containers: DataFrame, page: list[str], least: float = 0.5) -> DataFrame:
    """The container that covers most of each item, at least *least* of it; ties: smallest id."""
    pairs = overlapping_pairs(items, containers, page, B.covered)
    best = pairs.filter(F.col("overlap") >= least).groupBy(*page, "a_id").agg(F.max(F.struct("overlap", (-F.col("b_id")).alias("n"))).alias("m"))
    return best.select(*page, F.col("a_id").alias("obj_id"), (-F.col("m.n")).alias("container"), F.col("m.overlap").alias("overlap"))


def match_bands(predicted: DataFrame, truth: DataFrame, page: list[str], low: float = 0.3, high: float = 0.7) -> DataFrame:
    """Each prediction's best truth and its band: -1 between the limits, 0 below, 1 from *high* on; a truth's
    best predictions are rescued to 1 whatever their overlap, if they overlap at all.
    """
    pairs = overlapping_pairs(predicted, truth, page)
    best = pairs.groupBy(*page, "a_id").agg(F.max(F.struct("overlap", (-F.col("b_id")).alias("n"))).alias("m"))
    top = pairs.groupBy(*page, "b_id").agg(F.max("overlap").alias("overlap"))
    saved = pairs.join(top, [*page, "b_id", "overlap"]).select(*page, "a_id").distinct().withColumn("saved", F.lit(True))
    made = predicted.select(*page, F.col("obj_id").alias("a_id")).join(best, [*page, "a_id"], "left").join(saved, [*page, "a_id"], "left")
    overlap = F.coalesce(F.col("m.overlap"), F.lit(0.0))
    band = F.when(F.col("saved") | (overlap >= high), 1).when(overlap >= low, -1).otherwise(0)
    return made.select(*page, F.col("a_id").alias("obj_id"), (-F.col("m.n")).alias("truth_id"), overlap.alias("overlap"), band.alias("band"))


def block_verdicts(predicted: DataFrame, truth: DataFrame, page: list[str], least: float = 2 / 3) -> DataFrame:
    """*page*, obj_id, `verdict`: of each true block by the largest share of it that a found block covers and the largest share of a
    found block that it covers (both from *least* on: correct; only the second: split; only the first: merge; neither: split&merge;
    nothing met: miss), and 'false' of each found block that meets no true one."""
    t = truth.select(*page, F.col("obj_id").alias("t_id"), F.col("box").alias("t"))
    p = predicted.select(*page, F.col("obj_id").alias("p_id"), F.col("box").alias("p"))
    met = t.join(p, page).select(*page, "t_id", "p_id", B.covered("t", "p").alias("iog"), B.covered("p", "t").alias("iod")).filter("iog > 0 AND iod > 0")
    best = met.groupBy(*page, F.col("t_id").alias("obj_id")).agg(F.max("iog").alias("iog"), F.max("iod").alias("iod"))
    verdict = F.when(F.col("iog").isNull(), "miss").when((F.col("iog") >= least) & (F.col("iod") >= least), "correct").when(F.col("iod") >= least, "split").when(F.col("iog") >= least, "merge").otherwise("split&merge")
    judged = truth.select(*page, "obj_id").join(best, [*page, "obj_id"], "left").select(*page, "obj_id", verdict.alias("verdict"))
    stray = predicted.select(*page, "obj_id").join(met.select(*page, F.col("p_id").alias("obj_id")).distinct(), [*page, "obj_id"], "left_anti")
    return judged.unionByName(stray.select(*page, "obj_id", F.lit("false").alias("verdict")))


def precision_recall(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset precision, recall and F over tuples: `tp`, `fp`, `fn`, `precision`, `recall`, `f1`."""
    p = predicted.groupBy(*keys).agg(F.count("*").alias("_predicted"))
    t = truth.groupBy(*keys).agg(F.count("*").alias("_true"))
    both = p.join(t, keys, "full").select(F.coalesce("_predicted", F.lit(0)).alias("_predicted"), F.coalesce("_true", F.lit(0)).alias("_true"))
    s = both.agg(F.sum(F.least("_predicted", "_true")).alias("tp"), F.sum("_predicted").alias("np"), F.sum("_true").alias("nt"))
    made = s.select("tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("tp")).alias("fn"), F.coalesce(F.try_divide("tp", "np"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("tp", "nt"), F.lit(0.0)).alias("recall"))
    return made.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def confusion(rows: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """One row per true class, one column per predicted class of *classes*."""
    return rows.groupBy(truth).pivot(predicted, classes).count().fillna(0)


def segmentation_scores(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean IoU, frequency-weighted IoU, mean and overall accuracy from label pairs."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    right = cells.filter("t = p").select(F.col("t").alias("c"), F.col("n").alias("tp"))
    per = cells.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("nt")).join(cells.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("np")), "c", "left").join(right, "c", "left")
    per = per.select("nt", F.coalesce("np", F.lit(0)).alias("np"), F.coalesce("tp", F.lit(0)).alias("tp")).withColumn("iou", F.col("tp") / (F.col("nt") + F.col("np") - F.col("tp")))
    total = F.sum("nt")
    return per.agg(F.avg("iou").alias("miou"), (F.sum(F.col("nt") * F.col("iou")) / total).alias("fwiou"), F.avg(F.col("tp") / F.col("nt")).alias("macc"), (F.sum("tp") / total).alias("pacc"))


def ranked_hits(rows: DataFrame, category: str, score: str, hit: str, order: list[str], positives: DataFrame) -> DataFrame:
    """*category*, *hit*, `tp`, `k` (hits and rows up to here by falling score), `n`, `precision` and `best`, the largest precision from here on.

    Linear in the rows, whatever the size of a category: rows are laid out by range of category and score; running sums and
    the running maximum from the end are worked out within a range, and those of the ranges before and behind it added
    from one row per range and category.
    """
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    down, up = [F.desc(score), *map(F.asc, order)], [F.asc(score), *map(F.desc, order)]
    laid = cut(rows.select(category, score, hit, *order).repartitionByRange(buckets, F.col(category), *down).withColumn("_part", F.spark_partition_id()))
    each = Window.partitionBy(category).orderBy("_part")
    sums = laid.groupBy("_part", category).agg(F.sum(hit).alias("_hits"), F.count("*").alias("_rows"))
    sums = sums.select("_part", category, (F.sum("_hits").over(each) - F.col("_hits")).alias("_tp0"), (F.sum("_rows").over(each) - F.col("_rows")).alias("_k0"))
    local = Window.partitionBy("_part", category)
    so_far = local.orderBy(*down).rowsBetween(Window.unboundedPreceding, 0)
    run = laid.join(sums, ["_part", category]).withColumn("tp", F.col("_tp0") + F.sum(hit).over(so_far)).withColumn("k", F.col("_k0") + F.row_number().over(local.orderBy(*down)))
    run = cut(run.withColumn("precision", F.col("tp") / F.col("k")))
    behind = Window.partitionBy(category).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    tops = run.groupBy("_part", category).agg(F.max("precision").alias("_top")).withColumn("_later", F.max("_top").over(behind)).drop("_top")
    run = run.withColumn("_here", F.max("precision").over(local.orderBy(*up).rowsBetween(Window.unboundedPreceding, 0))).join(tops, ["_part", category])
    return run.join(positives, category).select(category, hit, "tp", "k", "n", "precision", F.greatest("_here", "_later").alias("best"))


def average_precision(rows: DataFrame, category: str, score: str, hit: str, order: list[str], positives: DataFrame) -> DataFrame:
    """Area under the precision-recall curve per category (`ap`) and its mean at the recalls 0, 0.1, ... 1 (`ap11`); *hit* is 1 or 0, *positives*: category, `n`.

    Precision at a recall is the best from there on (its envelope); recall grows with each hit by 1 / n.
    """
    run = ranked_hits(rows, category, score, hit, order, positives)
    at = [F.coalesce(F.max(F.when(F.col("tp") * 10 >= F.lit(t) * F.col("n"), F.col("precision"))), F.lit(0.0)) for t in range(11)]
    return run.groupBy(category).agg(F.sum(F.col("best") * F.col(hit) / F.col("n")).alias("ap"), (sum(at, F.lit(0.0)) / 11).alias("ap11"))


def assign(costs: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one assignment of rows to columns of least total cost (shortest augmenting paths)."""
    n, m = costs.shape
    if n > m:
        return sorted((a, b) for b, a in assign(costs.T))
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = costs[owner[j0] - 1, free - 1] - u[owner[j0]] - v[free]
            shorter = reduced < least[free]
            least[free[shorter]], way[free[shorter]] = reduced[shorter], j0
            j1 = free[least[free].argmin()]
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def match_sets(predicted: DataFrame, truth: DataFrame, page: str, weights: tuple[float, float] = (5.0, 2.0), label: str | None = None, class_weight: float = 1.0) -> DataFrame:
    """Per page the one-to-one matching of predictions and truths of least cost: box distance and generalised IoU, with *label* also a cost for another class.

    A page's boxes go to one task and their costs are a matrix of its predictions by its truths; a page holds what fits on paper."""
    what = F.col(label).cast("string") if label else F.lit("")
    p = predicted.select(page, F.lit(0).alias("side"), "obj_id", "box", what.alias("_label"))
    both = p.unionByName(truth.select(page, F.lit(1).alias("side"), "obj_id", "box", what.alias("_label")))

    def run(rows: list[tuple]) -> list[tuple]:
        first, second = ([(r[2], [r[3][c] for c in ("x0", "y0", "x1", "y1")], r[4]) for r in rows if r[1] == side] for side in (0, 1))
        if not first or not second:
            return []
        a, t = np.array([b for _, b, _ in first]), np.array([b for _, b, _ in second])
        other = np.array([c for *_, c in first])[:, None] != np.array([c for *_, c in second])[None]
        lo, hi = np.maximum(a[:, None, :2], t[None, :, :2]), np.minimum(a[:, None, 2:], t[None, :, 2:])
        inter = np.clip(hi - lo, 0, None).prod(2)
        size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
        union = size(a)[:, None] + size(t)[None] - inter
        whole = (np.maximum(a[:, None, 2:], t[None, :, 2:]) - np.minimum(a[:, None, :2], t[None, :, :2])).prod(2)
        giou = inter / np.maximum(union, 1e-9) - (whole - union) / np.maximum(whole, 1e-9)
        costs = weights[0] * np.abs(a[:, None] - t[None]).sum(2) / 1000 - weights[1] * giou + class_weight * other
        return [(rows[0][0], first[i][0], second[j][0], float(costs[i, j])) for i, j in assign(costs)]

    kinds = dict(predicted.dtypes)
    return per_group(both, [page], ["side", "obj_id"], run, f"`{page}` {kinds[page]}, obj_id {kinds['obj_id']}, truth_id {kinds['obj_id']}, cost double")


def recall_at(matched: DataFrame, total: int, thresholds: list[float]) -> DataFrame:
    """Recall at each IoU threshold; *matched*: `overlap` of each truth that was matched."""
    steps = matched.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    return steps.join(matched.groupBy("overlap").agg(F.count("*").alias("n")), F.col("overlap") >= F.col("threshold"), "left").groupBy("threshold").agg((F.coalesce(F.sum("n"), F.lit(0)) / F.lit(float(total))).alias("recall"))


def align(a: list, b: list, reward: Callable[[object, object], float]) -> tuple[list[tuple[int, int]], float]:
    """The order-keeping pairs of two sequences of most reward, and the reward (a dynamic program)."""
    n, m = len(a), len(b)
    gain = np.array([[reward(x, y) for y in b] for x in a], float).reshape(n, m)
    best = np.zeros((n + 1, m + 1))
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i, j] = max(best[i + 1, j + 1] + gain[i, j], best[i + 1, j], best[i, j + 1])
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if best[i, j] == best[i + 1, j + 1] + gain[i, j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i, j] == best[i + 1, j]:
            i += 1
        else:
            j += 1
    return pairs, float(best[0, 0])


def grid_similarity(a: list[list], b: list[list], reward: Callable[[object, object], float]) -> float:
    """How alike two tables are, 0 to 1: rows are aligned by their best alignment of cells, columns within
    aligned rows; twice the reward over the number of cells of both.
    """
    cells = sum(map(len, a)) + sum(map(len, b))
    if not cells:
        return 1.0
    _, total = align(a, b, lambda x, y: align(x, y, reward)[1])
    return 2 * total / cells


def table_similarity(tables: DataFrame, kind: str = "content") -> DataFrame:
    """Per table of `table_id`, `side` ('truth', 'predicted'), `row`, `col`: `similarity` of the two grids by 'content' (likeness of `text`), by 'topology'
    (overlap of `span`, the cell's reach up, left, down and right of the place) or by 'location' (overlap of `box`); span and box are arrays of four numbers."""
    from difflib import SequenceMatcher

    column = {"content": "text", "topology": "span", "location": "box"}[kind]

    def overlap(x, y) -> float:
        if x is None or y is None:
            return 0.0
        inter = max(0.0, min(x[2], y[2]) - max(x[0], y[0])) * max(0.0, min(x[3], y[3]) - max(x[1], y[1]))
        union = (x[2] - x[0]) * (x[3] - x[1]) + (y[2] - y[0]) * (y[3] - y[1]) - inter
        return inter / union if union > 0 else 0.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grids = []
        for side in ("truth", "predicted"):
            part = pdf[pdf["side"] == side].sort_values(["row", "col"])
            grids.append([(g[column].fillna("") if kind == "content" else g[column]).tolist() for _, g in part.groupby("row")])
        same = (lambda x, y: SequenceMatcher(None, x, y, autojunk=False).ratio()) if kind == "content" else overlap
        return pd.DataFrame({"table_id": [pdf["table_id"].iloc[0]], "similarity": [grid_similarity(*grids, same)]})

    return tables.groupBy("table_id").applyInPandas(run, f"table_id {dict(tables.dtypes)['table_id']}, similarity double")


def shrink_overlaps(spans: pd.DataFrame | Iterable[tuple[int, int, int, int, float]]) -> Iterator[tuple[int, int, int, int]]:
    """Spanning cells (row0, row1, col0, col1, score) in order of score, each cut back until it overlaps none before it; those cut to nothing are left out."""
    kept: list[tuple[int, int, int, int]] = []
    rows = spans.itertuples(index=False) if isinstance(spans, pd.DataFrame) else spans
    for r0, r1, c0, c1, _ in sorted(rows, key=lambda s: -s[4]):
        for k0, k1, q0, q1 in kept:
            while r0 <= r1 and c0 <= c1 and r0 <= k1 and k0 <= r1 and c0 <= q1 and q0 <= c1:
                if min(k1 - r0, r1 - k0) <= min(q1 - c0, c1 - q0):
                    r0, r1 = (k1 + 1, r1) if k1 - r0 <= r1 - k0 else (r0, k0 - 1)
                else:
                    c0, c1 = (q1 + 1, c1) if q1 - c0 <= c1 - q0 else (c0, q0 - 1)
        if r0 <= r1 and c0 <= c1:
            kept.append((r0, r1, c0, c1))
            yield r0, r1, c0, c1


def suppress_by_words(boxes: DataFrame, words: DataFrame, page: list[str], least: float = 0.5) -> DataFrame:
    """Greedy suppression by shared words: in order of score (ties by obj_id) a box falls if it shares a word, of which it holds at least *least*,
    with one that stays. Boxes without words stay. A page's boxes, which paper bounds, go to one task with the ids of their words."""
    held = overlapping_pairs(words, boxes, page, B.covered).filter(F.col("overlap") >= least).groupBy(*page, F.col("b_id").alias("obj_id")).agg(F.collect_set("a_id").alias("_words"))
    marked = boxes.join(held, [*page, "obj_id"], "left").select(*page, "obj_id", "score", "_words")
    at, score, name = (marked.columns.index(c) for c in ("_words", "score", "obj_id"))

    def run(rows: list[tuple]) -> list[tuple]:
        taken: set = set()
        kept = []
        for row in sorted(rows, key=lambda r: (-r[score], r[name])):
            mine = set(row[at]) if row[at] is not None else set()
            if not mine & taken:
                taken |= mine
                kept.append(row)
        return kept

    stay = per_group(marked, page, ["obj_id"], run, marked.schema).select(*page, "obj_id")
    return boxes.join(stay, [*page, "obj_id"], "left_semi")


def set_scores(predicted: DataFrame, truth: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Precision, recall and F of sets of labelled tuples, per *label* and for 'micro' (all together), 'macro' (the labels' mean) and 'boundaries'
    (labels left aside): `label`, `tp`, `fp`, `fn`, `precision`, `recall`, `f1`. Repeated tuples count once."""
    def counted(on: list[str], group: Column) -> DataFrame:
        p, t = predicted.select(*on).distinct().withColumn("_p", F.lit(1)), truth.select(*on).distinct().withColumn("_t", F.lit(1))
        both = p.join(t, on, "full")
        return both.groupBy(group.alias("label")).agg(F.count_if(F.col("_p").isNotNull() & F.col("_t").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))

    def scored(c: DataFrame) -> DataFrame:
        share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
        made = c.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn"))
        return made.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))

    each = counted([*keys, label], F.col(label))
    labels = scored(each)
    micro = scored(each.agg(F.lit("micro").alias("label"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    macro = labels.agg(F.lit("macro").alias("label"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    return labels.unionByName(micro).unionByName(macro).unionByName(scored(counted(keys, F.lit("boundaries"))))


def greedy_matches(predicted: DataFrame, truth: DataFrame, page: str) -> DataFrame:
    """*page*, `truth_id`, `overlap`: truths matched one to one, the most overlapping free pair first (ties by ids). A page's pairs, which paper bounds, go to one task."""
    pairs = overlapping_pairs(predicted, truth, [page])
    where = pairs.columns.index

    def run(rows: list[tuple]) -> list[tuple]:
        used_a, used_b, out = set(), set(), []
        for r in sorted(rows, key=lambda r: (-r[where("overlap")], r[where("a_id")], r[where("b_id")])):
            a, b = r[where("a_id")], r[where("b_id")]
            if a not in used_a and b not in used_b:
                used_a.add(a)
                used_b.add(b)
                out.append((r[where(page)], b, r[where("overlap")]))
        return out

    kinds = dict(pairs.dtypes)
    return per_group(pairs, [page], ["a_id", "b_id"], run, f"`{page}` {kinds[page]}, truth_id {kinds['b_id']}, overlap double")


def panoptic_quality(predicted: DataFrame, truth: DataFrame, page: list[str], label: str) -> DataFrame:
    """Per label `pq`, `sq`, `rq`: segments match where they overlap by more than half (two such can't share a partner); pq is the overlap of the matches over matches
    plus half of what is left over on either side."""
    keys = [*page, label]
    hits = overlapping_pairs(predicted, truth, keys).filter("overlap > 0.5").groupBy(label).agg(F.count("*").alias("_tp"), F.sum("overlap").alias("_iou"))
    n = lambda df, name: df.groupBy(label).agg(F.count("*").alias(name))
    made = n(predicted, "_np").join(n(truth, "_nt"), label, "full").join(hits, label, "left").fillna(0, ["_np", "_nt", "_tp"]).fillna(0.0, ["_iou"])
    weight = (F.col("_np") + F.col("_nt")) / 2
    return made.select(label, F.coalesce(F.try_divide("_iou", weight), F.lit(0.0)).alias("pq"), F.coalesce(F.try_divide("_iou", "_tp"), F.lit(0.0)).alias("sq"), F.coalesce(F.try_divide("_tp", weight), F.lit(0.0)).alias("rq"))


def shrunk_spans(spans: DataFrame, table: str) -> DataFrame:
    """*table*, row0, row1, col0, col1 of spanning cells cut back until none overlap (shrink_overlaps), one table at a time."""
    name, places = spans.columns.index(table), [spans.columns.index(c) for c in ("row0", "row1", "col0", "col1", "score")]

    def run(rows: list[tuple]) -> list[tuple]:
        return [(rows[0][name], *s) for s in shrink_overlaps([tuple(r[p] for p in places) for r in rows])]

    return per_group(spans, [table], ["score", "row0", "col0"], run, f"`{table}` {dict(spans.dtypes)[table]}, row0 int, row1 int, col0 int, col1 int")


def class_report(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """`class`, `support`, `precision`, `recall`, `f1` of each true class; 0 where a share has no ground."""
    cells = pairs.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    right = cells.filter("t = p").select(F.col("t").alias("class"), F.col("n").alias("tp"))
    made = cells.groupBy(F.col("t").alias("class")).agg(F.sum("n").alias("support")).join(cells.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("np")), "class", "left").join(right, "class", "left")
    tp = F.coalesce("tp", F.lit(0))
    scored = made.select("class", "support", F.coalesce(F.try_divide(tp, "np"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(tp, "support"), F.lit(0.0)).alias("recall"))
    return scored.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def recall_by_size(matched: DataFrame, truth: DataFrame, page: str, thresholds: list[float], sizes: dict[str, tuple[float, float]]) -> DataFrame:
    """`size`, `threshold`, `recall` and `mean`, the mean over the thresholds: of the true boxes whose area lies in [low, high) of a size, the share that was matched
    with at least the threshold's overlap. Sizes without boxes have no rows. By counts of overlaps, one row per size."""
    boxes = truth.select(page, F.col("obj_id").alias("truth_id"), B.area("box").alias("_area")).join(matched, [page, "truth_id"], "left")
    kinds = F.explode(F.array(*[F.when((F.col("_area") >= low) & (F.col("_area") < high), F.lit(name)) for name, (low, high) in sizes.items()])).alias("size")
    counted = boxes.select(kinds, "overlap").filter("size IS NOT NULL").groupBy("size").agg(F.count("*").alias("_n"), *[F.count_if(F.coalesce(F.col("overlap") >= t, F.lit(False))).alias(f"_h{k}") for k, t in enumerate(thresholds)])
    steps = F.array(*[F.struct(F.lit(round(t, 4)).alias("threshold"), (F.col(f"_h{k}") / F.col("_n")).alias("recall")) for k, t in enumerate(thresholds)])
    mean = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x["recall"]) / len(thresholds)
    return counted.select("size", mean.alias("mean"), F.inline(steps)).select("size", "threshold", "recall", "mean")


def to_coco(boxes: DataFrame, page: str, offset: int) -> DataFrame:
    """`image_id`, `id` (the page's times *offset* and the object's), `bbox` as corner and extent, `area`."""
    b = B.to_xywh("box")
    return boxes.select(F.col(page).alias("image_id"), (F.col(page) * offset + F.col("obj_id")).alias("id"), F.array(b["x"], b["y"], b["w"], b["h"]).alias("bbox"), B.area("box").alias("area"))
