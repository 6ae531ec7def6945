"""Sequence decoding of OCR model output: arg-max, collapse, confidence, regions, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the character set; the class after the last character is the blank.
CHARSET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 /-,.:<&()#;"
LEAST_PROBABILITY = 0.000001
STRIDE, HEIGHT, LEAST_WIDTH = 4.0001, 32, 41


def argmax(softmax: Column) -> Column:
    """The first largest class of each timestep."""
    return F.transform(softmax, lambda r: (F.array_position(r, F.array_max(r)) - 1).cast("int"))


def starts(labels: Column, blank: int) -> Column:
    """Timesteps (from 0) at which a run of a class other than the blank begins."""
    at = F.sequence(F.lit(0), F.size(labels) - 1)
    return F.filter(at, lambda i: (F.get(labels, i) != blank) & ((i == 0) | (F.get(labels, i) != F.get(labels, i - 1))))


def decoded(labels: Column, charset: str = CHARSET) -> Column:
    """Equal neighbours collapse first, then blanks go."""
    return F.array_join(F.transform(starts(labels, len(charset)), lambda i: F.substring(F.lit(charset), F.get(labels, i) + 1, F.lit(1))), "")


def confidence(softmax: Column, labels: Column, blank: int) -> Column:
    """Geometric mean of the probabilities at the first timestep of each run; 0 without any."""
    logs = F.transform(starts(labels, blank), lambda i: F.ln(F.greatest(F.get(F.get(softmax, i), F.get(labels, i)).cast("double"), F.lit(LEAST_PROBABILITY))))
    return F.when(F.size(logs) == 0, 0.0).otherwise(F.exp(F.aggregate(logs, F.lit(0.0), lambda s, x: s + x) / F.size(logs)))


def regions(labels: Column, img_width: Column, blank: int) -> Column:
    """array<struct<x1, x2>>: pixel columns of each run of a class other than the blank."""
    n = F.size(labels)
    at = F.sequence(F.lit(0), n - 1)
    ends = F.filter(at, lambda i: (F.get(labels, i) != blank) & ((i == n - 1) | (F.get(labels, i) != F.get(labels, i + 1))))
    width = img_width / n
    return F.zip_with(starts(labels, blank), ends, lambda a, b: F.struct((a * width).cast("int").alias("x1"), ((b + 1) * width).cast("int").alias("x2")))


def process(crops: DataFrame, charset: str = CHARSET) -> DataFrame:
    """crop_id, text, confidence, regions of crops (crop_id, img_width, softmax): one projection, no shuffle."""
    blank = len(charset)
    rows = crops.withColumn("labels", argmax(F.col("softmax")))
    return rows.select("crop_id", decoded(F.col("labels"), charset).alias("text"), confidence(F.col("softmax"), F.col("labels"), blank).alias("confidence"), regions(F.col("labels"), F.col("img_width"), blank).alias("regions"))


def sequence_length(width: Column) -> Column:
    return (width / STRIDE).cast("int")


def scaled_width(width: Column, height: Column) -> Column:
    """Width of an image brought to the model's height."""
    return F.greatest(F.lit(LEAST_WIDTH), (width * HEIGHT / height).cast("int"))


def crop_names(files: DataFrame) -> DataFrame:
    """Image names among files (path): those that hold neither txt nor pkl, in order."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.contains("txt") & ~name.contains("pkl")).select(name.alias("name")).orderBy("name")


def grid(low: float = 0.4, high: float = 1.0, steps: int = 100) -> list[float]:
    """Evenly spaced thresholds, each the index times the step added to the lowest, and the last exact."""
    step = (high - low) / (steps - 1)
    return [*(i * step + low for i in range(steps - 1)), high]


def metrics_at(predictions: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, tn, fn, precision, recall, accuracy, f1 over predictions (correct, confidence).

    Each row counts once, by the number of thresholds that its confidence reaches, and the counts are summed from above:
    rows are never multiplied by thresholds, and what is shuffled is one row for each step and task.
    """
    limits = sorted(thresholds)
    held = F.lit(",".join(map(repr, limits)))
    reached = F.size(F.filter(F.split(held, ",").cast("array<double>"), lambda t: t <= F.col("confidence")))
    counts = predictions.groupBy(F.when(F.col("confidence").isNull(), 0).otherwise(reached).alias("step")).agg(F.count_if(F.col("correct")).alias("good"), F.count_if(~F.coalesce("correct", F.lit(False))).alias("bad"))
    spark = predictions.sparkSession
    steps = spark.range(0, len(limits) + 1, 1, 1).select(F.col("id").cast("int").alias("step"))
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(1))
    rows = steps.join(counts, "step", "left").fillna(0)
    rows = rows.select("step", F.sum("good").over(above).alias("tp"), F.sum("bad").over(above).alias("fp"), F.sum("good").over(every).alias("goods"), F.sum("bad").over(every).alias("bads")).where("step > 0")
    limit = F.element_at(F.split(held, ",").cast("array<double>"), F.col("step"))
    rows = rows.select(limit.alias("threshold"), "tp", "fp", (F.col("bads") - F.col("fp")).alias("tn"), (F.col("goods") - F.col("tp")).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = rows.withColumn("precision", p).withColumn("recall", r).withColumn("accuracy", share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")))
    return rows.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """objective, threshold, best: the lowest threshold with the highest f1, precision and accuracy; (0, 0) where none is above zero."""
    rows = sweep.select("threshold", F.explode(F.array(*[F.struct(F.lit(m).alias("objective"), F.col(m).alias("best")) for m in ("f1", "precision", "accuracy")])).alias("x")).select("threshold", "x.objective", "x.best")
    first = Window.partitionBy("objective").orderBy(F.desc("best"), "threshold")
    top = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    return top.select("objective", F.when(F.col("best") > 0, F.col("threshold")).otherwise(0.0).alias("threshold"), "best")
