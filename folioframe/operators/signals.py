"""Model outputs and pixel rows as tables: line bands, CTC and token decoding, softmax, probability maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_MARKS = ("Ġ", "Ā")
SKIPPED = ("<pad>", "<s>", "</s>", "<unk>", "<mask>")
EOS = 2


def first_argmax(logits: str) -> Column:
    """Place (from 0) of the first largest element."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def last_argmax(logits: str) -> Column:
    """Place (from 0) of the last largest element."""
    return (F.size(logits) - F.array_position(F.reverse(logits), F.array_max(logits))).cast("int")


def softmax(logits: str) -> Column:
    """Stable softmax of an array."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(logits, lambda x: F.exp(x - top) / total)


def steps(cells: DataFrame) -> DataFrame:
    """(seq_id, t, logits array) of cells (seq_id, t, v, x)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("v", "x"))), lambda c: c.x)
    return cells.groupBy("seq_id", "t").agg(ordered.alias("logits"))


def ctc(step: DataFrame, keys: dict[int, str], blank: int = 0, offset: int = 0) -> DataFrame:
    """Greedy CTC text of (seq_id, t, logits): blanks and repeats of the step before go, ids without a key are skipped."""
    best = step.select("seq_id", "t", first_argmax("logits").alias("id"))
    before = F.lag("id", 1, -1).over(Window.partitionBy("seq_id").orderBy("t"))
    kept = best.withColumn("before", before)
    key = F.create_map(*[F.lit(x) for k, v in keys.items() for x in (k + offset, v)])
    letter = F.when((F.col("id") != blank) & (F.col("id") != F.col("before")), F.try_element_at(key, F.col("id")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", letter.alias("c")))), lambda x: x.c), "")
    made = kept.groupBy("seq_id").agg(text.alias("text"))
    return made.withColumn("confidence", F.when(F.col("text") != "", 1.0).otherwise(0.0))


def detokenize(tokens: DataFrame, vocabulary: DataFrame, eos: int = EOS) -> DataFrame:
    """Text of (seq_id, pos, id) up to the first end token; special tokens are skipped, prefix marks become spaces. Every sequence has a row.

    The vocabulary (id, token) is a model's own list, of bounded size, and is broadcast.
    """
    ended = F.max((F.col("id") == eos).cast("int")).over(Window.partitionBy("seq_id").orderBy("pos"))
    open_ = tokens.withColumn("ended", ended).join(F.broadcast(vocabulary), "id", "left")
    said = (F.col("ended") == 0) & ~F.col("token").isin(*SKIPPED)
    shown = F.col("token")
    for mark in PREFIX_MARKS:
        shown = F.replace(shown, F.lit(mark), F.lit(" "))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(said, F.struct("pos", shown.alias("s"))))), lambda x: x.s), "")
    return open_.groupBy("seq_id").agg(text.alias("text"))


def recognition_width(w: Column, h: Column, height: int = 48, base: int = 320) -> tuple[Column, Column]:
    """(width of the tensor, width of the resized crop) for a crop of w x h."""
    target = F.floor(height * F.greatest(F.lit(base / height), w / h) + 0.5).cast("int")
    return target, F.least(F.ceil(height * w / h).cast("int"), target)


def ink_rows(gray: DataFrame, margin: int = 28, low: int = 80, high: int = 245, border: bool = True) -> DataFrame:
    """(image_id, r, height, width, ink): inked pixels of each row of images (image_id, r, c, gray).

    Ink is darker than the 95th percentile less a margin, within limits; border: the outermost pixels have none. The
    percentile comes from counts of at most 256 levels an image.
    """
    levels = gray.groupBy("image_id", "gray").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r"), F.max("c").alias("c"))
    image = Window.partitionBy("image_id")
    upto, all_ = F.sum("n").over(image.orderBy("gray")), F.sum("n").over(image)
    back = F.min(F.when(F.col("upto") > F.floor(F.col("all") * 0.95), F.col("gray")))
    sizes = [(F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width")]
    found = levels.withColumns({"upto": upto, "all": all_}).groupBy("image_id").agg(back.alias("back"), *sizes)
    limits = found.select("image_id", "height", "width", F.least(F.greatest(F.col("back") - margin, F.lit(low)), F.lit(high)).alias("limit"))
    edge = F.greatest(F.floor(F.least("height", "width") / 80), F.lit(1))
    within = lambda c, size: (F.col(c) >= edge) & (F.col(c) < F.col(size) - edge)
    inked = F.col("gray") < F.col("limit")
    inked = inked & within("r", "height") & within("c", "width") if border else inked
    return gray.join(limits, "image_id").groupBy("image_id", "r", "height", "width").agg(F.count_if(inked).alias("ink"))


def bands(rows: DataFrame, least: int = 3, share: float = 0.006) -> DataFrame:
    """Runs of neighbouring rows with so many inked pixels, or that share of the width: (image_id, height, top, bottom). Gaps and islands."""
    order = Window.partitionBy("image_id").orderBy("r")
    inked = rows.where(F.col("ink") >= F.greatest(F.lit(least), F.floor(F.col("width") * share))).withColumn("island", F.col("r") - F.row_number().over(order))
    return inked.groupBy("image_id", "height", "island").agg(F.min("r").alias("top"), F.max("r").alias("bottom")).drop("island")


def merge_bands(found: DataFrame, gap: int | None = None) -> DataFrame:
    """Bands that follow within the gap become one; by default it is 1.8 % of the height, from 3 to 14 rows."""
    order = Window.partitionBy("image_id").orderBy("top")
    near = F.greatest(F.least(F.floor(F.col("height") * 0.018), F.lit(14)), F.lit(3)) if gap is None else F.lit(gap)
    new = found.withColumn("new", F.coalesce((F.col("top") > F.lag("bottom").over(order) + near).cast("int"), F.lit(1)))
    part = new.withColumn("part", F.sum("new").over(order))
    return part.groupBy("image_id", "height", "part").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom")).drop("part")


def line_bands(gray: DataFrame) -> DataFrame:
    """(image_id, top, bottom) of the lines of images: merged bands of four rows to half the height."""
    tall = F.col("bottom") - F.col("top") + 1
    return merge_bands(bands(ink_rows(gray))).where((tall >= 4) & (tall <= F.col("height") / 2)).drop("height")


def mean_inside(cells: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Mean of a half-open window of maps (seq_id, t, v, x); 0 where it is empty."""
    inside = (F.col("v") >= x0) & (F.col("v") < x1) & (F.col("t") >= y0) & (F.col("t") < y1)
    return cells.groupBy("seq_id").agg(F.coalesce(F.avg(F.when(inside, F.col("x"))), F.lit(0.0)).alias("score"))


def greedy_tokens(step, start: int, most: int = 256, eos: int = EOS, pad: int = 0) -> list[int]:
    """Autoregressive decoding: step(ids) gives the next scores; the last largest wins; stops at the end or padding token."""
    ids = [start]
    for _ in range(most):
        scores = list(step(ids))
        best = len(scores) - 1 - scores[::-1].index(max(scores))
        if best in (eos, pad):
            break
        ids.append(best)
    return ids[1:]


def greedy_sequences(found: DataFrame, eos: int = EOS, pad: int = 0) -> DataFrame:
    """(seq_id, ids): greedy decoding where the scores of all steps (seq_id, t, logits) are known beforehand."""
    best = found.select("seq_id", "t", last_argmax("logits").alias("id"))
    stop = F.min(F.when(F.col("id").isin(eos, pad), F.col("t"))).over(Window.partitionBy("seq_id"))
    said = F.when(stop.isNull() | (F.col("t") < stop), F.struct("t", "id"))
    marked = best.withColumn("said", said)
    return marked.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list("said")), lambda x: x.id).alias("ids"))


def beam_tokens(step, start: int, beams: int = 3, top: int = 5, most: int = 256, eos: int = EOS) -> list[int]:
    """Beam search over log probabilities of the last position; ties keep the earlier beam."""
    import math

    alive, done = [(0.0, [start])], []
    for _ in range(most):
        grown = []
        for score, ids in alive:
            x = list(step(ids))
            peak = max(x)
            total = math.log(sum(math.exp(v - peak) for v in x)) + peak
            for i in sorted(range(len(x)), key=lambda k: -x[k])[:top]:
                grown.append((score + x[i] - total, [*ids, i]))
        grown.sort(key=lambda g: -g[0])
        done += [g for g in grown[:beams] if g[1][-1] == eos]
        alive = [g for g in grown[:beams] if g[1][-1] != eos]
        if not alive:
            break
    best = max(done or alive, key=lambda g: g[0])[1][1:]
    return best[:-1] if best and best[-1] == eos else best
