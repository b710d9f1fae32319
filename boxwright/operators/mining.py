"""Core mining, prototype banks and probes over embeddings.

Nulls: rows without what an operator needs (label, vector, value) are left out, as each says. Ties go to the smaller id, place or
trial. Ids are keys. Empty tables give no rows, but for a bank, where that is an error.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwright.functions.stored import stored
from boxwright.functions.vectors import dot, normalised
from boxwright.operators.clusters import keyed_kmeans


def candidates(decisions: DataFrame, agreements: DataFrame, boxes: DataFrame, reliability: float = 0.70, agreement: float = 0.75) -> DataFrame:
    """result_id, label, agreement of the reliable, agreed, kept results with a damage label.

    decisions: run_id, result_id, final_label, reliability, model_agreement; agreements: run_id, result_id, agreement_ratio; boxes: graph_id, result_id, keep.
    """
    d = decisions.withColumn("graph_id", F.concat("run_id", F.lit("_box_graph_v1")))
    j = d.join(agreements, ["run_id", "result_id"], "left").join(boxes, ["graph_id", "result_id"], "left")
    agreed = F.coalesce("agreement_ratio", "model_agreement")
    other = F.col("final_label").isin("reject", "unknown", "background", "shadow", "edge", "object")
    return j.where((F.col("reliability") >= reliability) & (agreed >= agreement) & (F.coalesce("keep", F.lit(1)) == 1) & ~other).select("result_id", F.col("final_label").alias("label"), agreed.alias("agreement"))


def core_mining(rows: DataFrame, least_size: int = 10, least_agreement: float = 0.75, most_clusters: int = 8, rare: int = 3, seed: int = 42) -> DataFrame:
    """result_id, label, cluster, size, density, cluster_agreement, similarity, status. rows: result_id (a key), label, agreement, v (unit vectors).

    A label with too few rows has no cluster (insufficient_class_samples); else k-means over the label's vectors, all labels at
    once; a cluster is core if it is large and agrees enough, else rare_cluster or noise_cluster. Rows without a vector, id or
    label are left out. Any number of labels; an empty table gives no rows.
    """
    rows = stored(rows.select("result_id", "label", "agreement", "v").where("result_id is not null and label is not null and v is not null"), "mining")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    k = stored(sizes.where(F.col("n") >= least_size).select("label", F.greatest(F.lit(1), F.least(F.lit(most_clusters), F.floor(F.col("n") / least_size))).cast("int").alias("k")), "sizes")
    clustered = keyed_kmeans(rows, k, most_clusters, seed=seed)
    dealt = stored(clustered.unionByName(rows.join(k, "label", "left_anti"), allowMissingColumns=True), "mining")
    keys = ["label", "cluster"]
    means = dealt.where("cluster is not null").select(*keys, F.posexplode("v").alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select(*keys, normalised(F.transform("c", lambda p: p["m"])).alias("c"))
    near = stored(dealt.join(centres, keys).withColumn("similarity", F.least(F.greatest(dot(F.col("v"), F.col("c")), F.lit(-1.0)), F.lit(1.0))), "mining")
    about = near.groupBy(*keys).agg(F.count("*").alias("size"), F.avg("similarity").alias("density"), F.avg("agreement").alias("cluster_agreement"))
    status = F.when((F.col("size") >= least_size) & (F.col("cluster_agreement") >= least_agreement), "core").when(F.col("size") >= rare, "rare_cluster").otherwise("noise_cluster")
    found = near.join(about, keys).select("result_id", "label", "cluster", "size", "density", "cluster_agreement", "similarity", status.alias("status"))
    none = dealt.where("cluster is null").select("result_id", "label", F.lit("insufficient_class_samples").alias("status"))
    return found.unionByName(none, allowMissingColumns=True)


def prototype_bank(manual: DataFrame, members: DataFrame, picked: DataFrame, excluded: DataFrame) -> DataFrame:
    """result_id, label, source of a bank: manual picks, then members of the picked clusters; the later entry of an id wins, excluded ids go.

    manual: result_id, label, place; members: cluster, result_id, similarity, is_core; picked: cluster, label, place. An empty bank is an error.
    """
    m = members.where(F.coalesce("is_core", F.lit(True))).join(picked, "cluster")
    of_clusters = m.select("result_id", "label", F.lit("core_cluster").alias("source"), F.struct(F.lit(1).alias("kind"), F.col("place").cast("long").alias("place")).alias("rank"))
    by_hand = manual.select("result_id", "label", F.lit("manual").alias("source"), F.struct(F.lit(0).alias("kind"), F.col("place").cast("long").alias("place")).alias("rank"))
    last = F.max_by(F.struct("label", "source"), "rank").alias("b")
    bank = stored(by_hand.unionByName(of_clusters).join(excluded, "result_id", "left_anti").groupBy("result_id").agg(last).select("result_id", "b.label", "b.source"), "bank")
    if bank.isEmpty():
        raise ValueError("the prototype bank is empty")
    return bank


def dup_score(overlap: Column, containment: Column, cosine: Column) -> Column:
    """How much two boxes are one finding, 0 to 1: the mean of the larger of IoU and containment, and the vectors' likeness; symmetric in the two. The weights are our choice."""
    clip = lambda v: F.least(F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return 0.6 * F.greatest(clip(overlap), clip(containment)) + 0.4 * clip((cosine + 1) / 2)


def keep_order(*, good: Column, area: Column, key: Column) -> list[Column]:
    """A strict total order of boxes: the better first, then the larger, then the smaller id."""
    return [good.desc(), area.desc(), key.asc()]


def temperature_losses(rows: DataFrame, grid: list[float]) -> DataFrame:
    """t, loss: mean binary cross entropy of logit / t for each temperature, in one pass. rows: logit, target (0 or 1)."""
    t = F.explode(F.array(*map(F.lit, grid))).alias("t")
    z = F.col("logit") / F.col("t")
    loss = F.greatest(z, F.lit(0.0)) - z * F.col("target") + F.log1p(F.exp(-F.abs(z)))
    return rows.select("logit", "target", t).select("t", loss.alias("loss")).groupBy("t").agg(F.avg("loss").alias("loss"))


def fit_temperature(rows: DataFrame, low: float = 0.05, high: float = 20.0, points: int = 17, rounds: int = 5) -> float:
    """The temperature of least loss: grids in the logarithm, each between the neighbours of the last one's best. Null rows are left out; without a row it is 1."""
    rows = rows.where("logit is not null and target is not null and not isnan(logit)")
    best = 1.0
    for _ in range(rounds):
        grid = np.exp(np.linspace(np.log(low), np.log(high), points)).tolist()
        found = sorted((r["loss"], r["t"]) for r in temperature_losses(rows, grid).collect())  # points rows
        if not found:
            return 1.0
        best = found[0][1]
        at = int(np.argmin(np.abs(np.array(grid) - best)))
        low, high = grid[max(0, at - 1)], grid[min(points - 1, at + 1)]
    return best


def linear_probe(rows: DataFrame, candidates: DataFrame, seed: int = 0) -> DataFrame:
    """result_id, probe_label, probability of the candidates by a logistic regression over vectors, classes weighed to balance. rows: label, v; candidates: result_id, v. Rows without a label or vector take no part; without a labelled row there is no result."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vector = array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("features")
    rows, candidates = rows.where("label is not null and v is not null"), candidates.where("v is not null")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    total, classes = counts.agg(F.sum("n"), F.count("*")).first()
    if not total:
        return candidates.select("result_id", F.lit(None).cast("string").alias("probe_label"), F.lit(None).cast("double").alias("probability")).limit(0)
    weighed = stored(rows.join(counts, "label").select("label", vector, (F.lit(float(total)) / (classes * F.col("n"))).alias("weight")), "probe")
    names = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(weighed)
    model = LogisticRegression(labelCol="y", weightCol="weight", regParam=0.001).fit(names.transform(weighed))
    found = model.transform(candidates.select("result_id", vector)).select("result_id", "prediction", vector_to_array("probability").alias("p"))
    labels = F.array(*map(F.lit, names.labels))
    return found.select("result_id", F.get(labels, F.col("prediction").cast("int")).alias("probe_label"), F.array_max("p").alias("probability"))


def threshold_report(probed: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, promoted: candidates at or above each, in one pass."""
    return probed.agg(*[F.count_if(F.col("probability") >= t).alias(str(k)) for k, t in enumerate(thresholds)]).select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(str(k)).alias("promoted")) for k, t in enumerate(thresholds)])))


def bootstrap(rows: DataFrame, value: str, resamples: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """mean, low, high: a percentile interval of the mean over Poisson resamples.

    Rows of one value are counted first: that a row is drawn so many times is a
    Poisson number, and those of n equal rows add up to one of mean n. The numbers follow from the value and the seed, so
    tasks need not know of each other; each sends one row for a resample. Nulls and NaN are left out.
    """

    def partial(batches):
        import pyarrow as pa

        sums = np.zeros((2, resamples))
        for batch in batches:
            hashes, values, counts = (c.to_numpy() for c in batch.columns)
            for h, x, n in zip(hashes.view(np.uint64).tolist(), values.tolist(), counts.tolist(), strict=True):
                w = np.random.default_rng([seed, h]).poisson(n, resamples)
                sums[0] += w
                sums[1] += x * w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(sums[0]), pa.array(sums[1])], names=["b", "w", "wx"])

    good = rows.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    counted = good.groupBy("x").agg(F.count("*").alias("n")).select(F.xxhash64("x").alias("h"), "x", "n")
    means = counted.mapInArrow(partial, "b long, w double, wx double").groupBy("b").agg((F.sum("wx") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    tail = (1 - confidence) / 2
    interval = means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    return good.agg(F.avg("x").alias("mean")).crossJoin(interval)  # one row each


def _trial_place(h: np.ndarray, trial: np.ndarray) -> np.ndarray:
    """Places (0 to 999) of units, by 28 bits of their hashes, in trials: products with odd numbers, their upper bits."""
    odd = (trial * 40503 + 12345) % (1 << 27) * 2 + 1
    return ((h[None, :] * odd[:, None]) % (1 << 28)) * 1000 >> 28


def balanced_split(units: DataFrame, counts: dict[str, float], trials: int = 1200, shares: tuple[float, float] = (0.7, 0.2)) -> DataFrame:
    """unit, split: of so many random splits, the one whose shares of the weighted counts are nearest to those wanted (then the first).

    units: unit (a key) and a column for each count. counts: weight of each column's squared relative deviation. A unit is
    hashed once, its places in all trials follow from that; all trials are scored in one pass, with a row for each trial and
    task. Null counts are 0; an empty table gives no rows.
    """
    names, first, both = list(counts), round(1000 * shares[0]), round(1000 * sum(shares))
    h = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit("split"), F.col("unit").cast("string")).cast("binary")), 1, 7), 16, 10).cast("long")
    hashed = units.select(h.alias("h"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])

    def score(batches):
        import pyarrow as pa

        sums, numbers = np.zeros((2, trials, len(names))), np.arange(trials)
        for batch in batches:
            h, values = batch.column(0).to_numpy(), np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            for at in range(0, len(h), 1024):
                place = _trial_place(h[at : at + 1024], numbers)
                sums[0] += (place < first) @ values[at : at + 1024]
                sums[1] += ((place >= first) & (place < both)) @ values[at : at + 1024]
        columns = [pa.array(sums[side, :, k]) for side in (0, 1) for k in range(len(names))]
        yield pa.RecordBatch.from_arrays([pa.array(numbers), *columns], names=["trial", *(f"{side}_{k}" for side in "tv" for k in range(len(names)))])

    kind = ", ".join(f"{side}_{k} double" for side in "tv" for k in range(len(names)))
    sums = hashed.mapInArrow(score, f"trial long, {kind}").groupBy("trial").agg(*[F.sum(f"{side}_{k}").alias(f"{side}_{k}") for side in "tv" for k in range(len(names))])
    total = hashed.agg(*[F.sum(c).alias(f"n_{k}") for k, c in enumerate(names)])
    j = sums.crossJoin(F.broadcast(total))  # one row
    wanted = [*shares, 1 - sum(shares)]

    def off(k: int) -> list[Column]:
        t, v, n = F.col(f"t_{k}"), F.col(f"v_{k}"), F.nullif(F.col(f"n_{k}"), F.lit(0.0))
        return [counts[names[k]] * F.pow(F.coalesce(x / n, F.lit(0.0)) - share, F.lit(2)) for x, share in zip((t, v, F.col(f"n_{k}") - t - v), wanted, strict=True)]

    cost = reduce(Column.__add__, [x for k in range(len(names)) for x in off(k)])
    found = j.select("trial", F.round(cost, 9).alias("cost")).orderBy("cost", "trial").first()
    odd = (((found["trial"] if found else 0) * 40503 + 12345) % (1 << 27)) * 2 + 1
    place = F.shiftright((h * odd % (1 << 28)) * 1000, 28)
    return units.select("unit", F.when(place < first, "train").when(place < both, "val").otherwise("test").alias("split"))


def source_split(boxes: DataFrame, labels: list[str], trials: int = 5000, image_trials: int = 1200) -> DataFrame:
    """unit, split: all images of a source on one side, by images, boxes, sources and labels; under three sources, images one by one.

    boxes: image, source, label. unit is the source, or the image where there are too few sources.
    """
    few = boxes.select("source").distinct().limit(3).count() < 3
    key = "image" if few else "source"
    units = boxes.groupBy(F.col(key).alias("unit")).agg(F.lit(1).alias("sources"), F.count_distinct("image").alias("images"), F.count("*").alias("boxes"), *[F.count_if(F.col("label") == x).alias(x) for x in labels])
    own = {"images": 20, "boxes": 10} if few else {"images": 8, "boxes": 8, "sources": 1.5}
    return balanced_split(units, own | dict.fromkeys(labels, 2), image_trials if few else trials)


def sources_clustered(rows: DataFrame, wanted: int, seed: int = 42) -> DataFrame:
    """source, cluster: k-means over the sources' normalised mean vectors, k = min(sources, max(3, wanted)). rows: source, v. Null sources and vectors take no part."""
    known = rows.where("source is not null and v is not null")
    m = known.select("source", F.posexplode("v").alias("i", "x")).groupBy("source", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = m.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    vectors = stored(means.select(F.lit("all").alias("label"), F.col("source").alias("result_id"), normalised(F.transform("c", lambda p: p["m"])).alias("v")), "sources")
    k = vectors.groupBy("label").agg(F.least(F.count("*"), F.lit(max(3, wanted))).cast("int").alias("k"))
    return keyed_kmeans(vectors, k, max(3, wanted), seed=seed).select(F.col("result_id").alias("source"), "cluster")
