"""Layer chains of a network as strings, rewritten into blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# One letter per layer type, and what a run of letters is drawn as; of several that fit, the first in this order.
LETTERS = {"Conv2d": "c", "MaxPool2d": "p", "ConvTranspose2d": "u", "Flatten": "f", "Linear": "l", "ReLU": "r", "add_": "a"}
BLOCKS = [("(?:cr){2,}", "C"), ("lr", "L>"), ("p", "P>"), ("l", "l"), ("u", ">U"), ("Cr", "C"), ("cr", "C"), ("a", "}A}"), ("c", "C")]


def chain(layers: DataFrame, group: str, order: str) -> DataFrame:
    """(group, chain): one letter per layer in order; a convolution whose size differs from the first of its run, or that follows
    such a one, is a capital. Pooling, upsampling, flattening, linear and adding layers end a run; unknown types are `x`."""
    letter = F.coalesce(F.create_map(*[F.lit(x) for p in LETTERS.items() for x in p])[F.col("type")], F.lit("x"))
    rows = layers.select(group, F.struct(F.col(order).alias("o"), letter.alias("c"), "height", "width").alias("s")).groupBy(group).agg(F.array_sort(F.collect_list("s")).alias("s"))
    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("int").alias("h"), F.lit(None).cast("int").alias("w"))

    def step(state: Column, s: Column) -> Column:
        conv = s["c"] == "c"
        other = state["h"].isNotNull() & (~(state["h"].eqNullSafe(s["height"]) & state["w"].eqNullSafe(s["width"])) | state["out"].endswith("C"))
        ends = s["c"].isin("p", "u", "f", "l", "a")
        keep = lambda old, new: F.when(ends, F.lit(None).cast("int")).when(conv & state["h"].isNull(), new.cast("int")).otherwise(old)
        return F.struct(F.concat(state["out"], F.when(conv & other, "C").otherwise(s["c"])).alias("out"), keep(state["h"], s["height"]).alias("h"), keep(state["w"], s["width"]).alias("w"))

    return rows.select(group, F.aggregate("s", start, step)["out"].alias("chain"))


def blocks(text: Column) -> Column:
    """array<struct(part, block)>: the chain cut from left to right into the runs of BLOCKS, everything else one letter by itself."""
    either = "|".join(p for p, _ in BLOCKS)
    parts = F.regexp_extract_all(text, F.lit(f"(?:{either}|.)"), F.lit(0))
    named = lambda p: reduce(lambda acc, b: F.when(p.rlike(f"^(?:{b[0]})$"), b[1]).otherwise(acc), reversed(BLOCKS), p)
    return F.transform(parts, lambda p: F.struct(p.alias("part"), named(p).alias("block")))


def block_text(text: Column) -> Column:
    return F.array_join(F.transform(blocks(text), lambda b: b["block"]), "")


def numbered(df: DataFrame, group: str, order: str, kind: str) -> DataFrame:
    """With the running number of each block among those of its kind."""
    return df.withColumn("number", F.row_number().over(Window.partitionBy(group, kind).orderBy(order)))


def node_info(label: Column) -> Column:
    """struct(type, channels, height, width) of a node label like `<b>Conv2d</b> ... (1, 64, 570, 570)`: the last shape in it counts."""
    shapes = F.regexp_extract_all(label, F.lit(r"\((?:\d+,\s*){2,3}\d+\)"), F.lit(0))
    last = F.element_at(F.concat(F.array(F.lit("(0)")), shapes), -1)
    sizes = F.transform(F.regexp_extract_all(last, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    at = lambda i: F.when(F.size(sizes) >= 3, F.try_element_at(sizes, F.lit(i)))
    kind = F.nullif(F.regexp_extract(label, r"([A-Z][A-Za-z]+\d?d?|add_)", 1), F.lit(""))
    return F.struct(kind.alias("type"), at(-3).alias("channels"), at(-2).alias("height"), at(-1).alias("width"))


def path_blocks(layers: DataFrame, group: str, order: str, skips: DataFrame | None = None) -> DataFrame:
    """(group, block_no, block, number, first, last, skip_to): the blocks of a layer chain with the layers that each covers and, for
    `skips(group, src, dst)` given by layer position, the block that a skip edge of the block leads to."""
    parts = chain(layers, group, order).select(group, F.posexplode(blocks(F.col("chain"))).alias("block_no", "b"))
    w = Window.partitionBy(group).orderBy("block_no")
    end = F.sum(F.length("b.part")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = parts.select(group, "block_no", F.col("b.block").alias("block"), (end - F.length("b.part")).alias("first"), (end - 1).alias("last"))
    out = numbered(out, group, "block_no", "block")
    if skips is None:
        return out.withColumn("skip_to", F.lit(None).cast("int"))
    ends = out.select(group, F.col("block_no").alias("to"), F.col("first").alias("f"), F.col("last").alias("l"))
    led = skips.join(ends, group).where("dst between f and l").select(group, "src", "to")
    return out.join(led.withColumnRenamed(group, "_g"), (F.col(group) == F.col("_g")) & F.col("src").between(F.col("first"), F.col("last")), "left").groupBy(group, "block_no", "block", "number", "first", "last").agg(F.min("to").alias("skip_to"))


def chain_nodes(path: DataFrame, nodes: DataFrame, skips: DataFrame) -> DataFrame:
    """(pos, v, type, channels, height, width, skip_from): the vertices of a path `(pos, v)` with what `nodes(v, label)` says of each and, for
    `skips(dst, src)`, the position from which a skip edge leads there. ReLU and unknown layers have no sizes and no skips."""
    sized = ["Conv2d", "MaxPool2d", "ConvTranspose2d", "Flatten", "Linear", "add_"]
    said = path.join(nodes.select("v", node_info(F.col("label")).alias("i")), "v", "left").select("pos", "v", "i.*")
    led = skips.join(path.select(F.col("v").alias("src"), F.col("pos").alias("skip_from")), "src").select(F.col("dst").alias("v"), "skip_from")
    has = F.col("type").isin(*sized)
    return said.join(led, "v", "left").select("pos", "v", "type", *[F.when(has, F.col(c)).alias(c) for c in ("channels", "height", "width", "skip_from")])


def document(blocks_: DataFrame, group: str) -> DataFrame:
    """(group, document): one line per block of `path_blocks`, in order: name and number, the layers it covers, the block a skip leads to."""
    name = F.concat(F.col("block"), F.lit("_"), F.col("number").cast("string"))
    skip = F.when(F.col("skip_to").isNotNull(), F.concat(F.lit(" -> "), F.col("skip_to").cast("string"))).otherwise("")
    line = F.concat(name, F.lit(" ["), F.col("first").cast("string"), F.lit(".."), F.col("last").cast("string"), F.lit("]"), skip)
    lines = blocks_.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("block_no", line.alias("l")))).alias("x"))
    return lines.select(group, F.array_join(F.transform("x", lambda s: s["l"]), "\n").alias("document"))
