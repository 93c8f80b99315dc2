"""Operator 3: mixing sources to target weights by a multivariate-hypergeometric splitting tree (native).

Every source is cut into blocks of whole documents by a hash.  Its target in words becomes an exact quota of block
copies: its blocks in permuted order, a second pass after the first where the target exceeds the source, and the last
block cut at the word.  A binary tree over output shards splits the quotas of all sources: at every node the left half
gets its share of the node's blocks by a multivariate hypergeometric draw (source after source, each a hypergeometric
given what is left), the right half the rest, so shards have equal numbers of blocks and quotas are met exactly.  Each
shard then takes the next blocks of each source's permutation - disjoint sets - and orders its documents by hash.

The one block that a source's target cuts is taken in hash order of its documents: the order's first 12 bits make 4,096
parts whose sizes are summed, so only the documents of the one part that is cut are ever sorted, by id and size alone.

All sources are one row of the tree, and windows over sources run in one task: their number must fit there (100,000 do).
A source has at most ``max_blocks`` blocks, one row each, which then grow instead.  Documents are joined to their block.
All randomness is a hash of ids, texts and ``seed``: reruns agree.

Defined results: null text has size 0; a null source is a source of its own, last; sources of size 0 have target 0; rows
that share a doc_id (or have none) are documents of their own, told apart by their text; rows equal in both take equally
many words; empty tables give no rows; ``mixed_documents`` keeps all columns whatever their names, ``mix`` puts its own,
which begin with mix_, in place of columns of these names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.common import materialize, row_hash, whole_row, word_array, word_count

WEIGHTS, SHARE, MAX_REPEAT = (5, 2, 1), 1.5, 2
BLOCK_WORDS, MAX_BLOCKS, SHARD_BLOCKS, SHARD_WORDS, SEED = 200_000, 65_536, 64, 50_000_000, 11
BROADCAST_ROWS = 100_000


def _key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: skey, source_size, target; weights in code point order, targets capped at MAX_REPEAT times
    the size and the excess shared again by weight.

    With sources in order of cap by weight, the first k are capped and the rest share what is left by weight; k is
    the first place where that share stays below the cap.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    weighted = sources.select(
        _key().alias("skey"), "source_size",
        F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(listed) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double").alias("w"),
        (F.lit(SHARE) * F.sum("source_size").over(everything)).alias("total"),
    ).withColumn("cap", (F.lit(MAX_REPEAT) * F.col("source_size")).cast("double"))
    ascending = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    before = ascending.rowsBetween(Window.unboundedPreceding, -1)
    rest = ascending.rowsBetween(0, Window.unboundedFollowing)
    shared = weighted.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)).withColumn("place", F.row_number().over(ascending))
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("place", "level"))).over(everything)["level"]
    return shared.select("skey", "source_size", F.least("cap", F.col("w") * F.coalesce(level, F.col("cap") / F.col("w"))).alias("target"))


def _unit(*parts: Column | int) -> Column:
    """A number in [0, 1) from a hash."""
    h = F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts])
    return h.bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53))


def hypergeometric(everything: Column, good: Column, drawn: Column, unit: Column) -> Column:
    """How many of ``good`` among ``everything`` are in a random draw of ``drawn``: inversion over 8 deviations."""
    n, k, m = everything.cast("double"), good.cast("double"), drawn.cast("double")
    mean = F.when(n > 0, m * k / n).otherwise(0.0)
    deviation = F.when(n > 1, F.sqrt(F.greatest(mean * (1 - k / n) * (n - m) / (n - 1), F.lit(0.0)))).otherwise(0.0)
    low = F.greatest(F.lit(0.0), m - (n - k), F.floor(mean - 8 * deviation - 3)).cast("long")
    high = F.greatest(F.least(m, k, F.ceil(mean + 8 * deviation + 3)).cast("long"), low)

    def after(w: Column, x: Column) -> Column:
        return w * (k - x) * (m - x) / ((x + 1) * F.greatest(n - k - m + x + 1, F.lit(1.0)))

    def add(a: Column, x: Column) -> Column:
        return F.struct(after(a["w"], x.cast("double")).alias("w"), (a["sum"] + a["w"]).alias("sum"))

    def find(a: Column, x: Column, edge: Column) -> Column:
        return F.struct(after(a["w"], x.cast("double")).alias("w"), (a["sum"] + a["w"]).alias("sum"), F.when(a["sum"] <= edge, x).otherwise(a["at"]).alias("at"))

    total = F.aggregate(F.sequence(low, high), F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")), add)["sum"]
    return F.aggregate(F.sequence(low, high), F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), low.alias("at")), lambda a, x: find(a, x, unit * total))["at"]


def _draw_next(seed: int, depth: int) -> Callable[[Column, Column], Column]:
    def step(a: Column, s: Column) -> Column:
        got = hypergeometric(a["left"], s["quota"], a["room"], _unit(seed, depth, F.col("shard"), s["skey"]))
        return F.struct((a["left"] - s["quota"]).alias("left"), (a["room"] - got).alias("room"), F.concat(a["got"], F.array(got)).alias("got"))

    return step


def splitting_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """quotas: one row with ``sources`` array<struct<skey, quota>> -> skey, shard, quota; shards is a power of two."""
    nodes = quotas.select(F.lit(0).cast("long").alias("shard"), "sources")
    for depth in range(shards.bit_length() - 1):
        total = F.aggregate("sources", F.lit(0).cast("long"), lambda a, s: a + s["quota"])
        start = F.struct(total.alias("left"), F.floor((total + F.xxhash64(F.lit(seed), F.lit(depth), F.col("shard")).bitwiseAND(1)) / 2).cast("long").alias("room"), F.array().cast("array<bigint>").alias("got"))

        halves = nodes.withColumn("got", F.aggregate("sources", start, _draw_next(seed, depth))["got"])
        kept = F.zip_with("sources", "got", lambda s, g: F.struct(s["skey"].alias("skey"), g.alias("quota")))
        rest = F.zip_with("sources", "got", lambda s, g: F.struct(s["skey"].alias("skey"), (s["quota"] - g).alias("quota")))
        nodes = halves.select(F.explode(F.array(F.struct((F.col("shard") * 2).alias("shard"), kept.alias("sources")), F.struct((F.col("shard") * 2 + 1).alias("shard"), rest.alias("sources")))).alias("n")).select("n.*")
    return nodes.select("shard", F.explode("sources").alias("s")).select("s.skey", "shard", "s.quota")


def _block(seed: int, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("id")), blocks)


def _order(seed: int) -> Column:
    """A document's place in its block, as an unsigned number; its first 12 bits name the part of the block."""
    return F.xxhash64(F.lit(seed + 3), F.col("id"))


def _part(seed: int) -> Column:
    return F.shiftrightunsigned(_order(seed), 52).cast("int")


def block_plan(sizes: DataFrame, block_words: int = BLOCK_WORDS, max_blocks: int = MAX_BLOCKS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """From (id, source, size): skey, block, source_size, target, n_blocks and ``copies``, an array of
    (epoch, take, whole, shard) for the times the block is in the mix."""
    targets = source_targets(sizes).withColumn("n_blocks", F.greatest(F.lit(1), F.least(F.lit(max_blocks), F.ceil(F.col("source_size") / block_words))).cast("long"))
    targets = materialize(targets, "targets")
    own = sizes.withColumn("skey", _key()).join(targets.select("skey", "n_blocks"), "skey").withColumn("block", _block(seed, F.col("n_blocks")))
    blocks = own.groupBy("skey", "block").agg(F.sum("size").alias("words")).join(targets, "skey")
    twice = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEAT - 1))))
    stream = Window.partitionBy("skey").orderBy("epoch", F.xxhash64(F.lit(seed + 1), "skey", "epoch", "block"), "block")
    wanted = F.floor(F.col("target") + 0.5) - (F.sum("words").over(stream) - F.col("words"))
    taken = twice.withColumn("take", F.greatest(F.lit(0), F.least("words", wanted)).cast("long"))
    permuted = Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(seed + 2), "skey", "epoch", "block"), "block", "epoch")
    used = materialize(taken.where("take > 0").withColumn("rank", F.row_number().over(permuted).cast("long")), "blocks")
    n, words = used.agg(F.count("*"), F.coalesce(F.sum("take"), F.lit(0))).first()
    shards = 1 << max(0, max(n // shard_blocks, min(n, words // SHARD_WORDS)).bit_length() - 1)
    quotas = used.groupBy("skey").agg(F.count("*").alias("quota")).agg(F.array_sort(F.collect_list(F.struct("skey", "quota"))).alias("sources"))
    drawn = splitting_tree(quotas, shards, seed)
    last = F.sum("quota").over(Window.partitionBy("skey").orderBy("shard"))
    places = drawn.withColumn("last", last).where("quota > 0").select("skey", "shard", F.explode(F.sequence(F.col("last") - F.col("quota") + 1, F.col("last"))).alias("rank"))
    placed = used.join(places, ["skey", "rank"]).groupBy("skey", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "take", (F.col("take") == F.col("words")).alias("whole"), "shard"))).alias("copies"))
    return blocks.select("skey", "block", "source_size", "target", "n_blocks").join(placed, ["skey", "block"], "left")


def _few(table: DataFrame) -> DataFrame:
    """Sent to all tasks where its counted rows are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _cut_parts(sizes: DataFrame, plan: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Parts of cut blocks (skey, block, part, start, words), and of the parts that a cut goes through the documents
    (skey, id, inside, twins): words before, and how many equal rows share them."""
    cut = plan.where(F.exists(F.coalesce("copies", F.array()), lambda c: ~c["whole"])).select("skey", "block", "n_blocks", F.transform("copies", lambda c: c["take"]).alias("takes"))
    within = sizes.withColumn("skey", _key()).join(F.broadcast(cut.select("skey", "n_blocks").distinct()), "skey").withColumn("block", _block(seed, F.col("n_blocks"))).drop("n_blocks")
    within = within.join(F.broadcast(cut.drop("n_blocks")), ["skey", "block"]).withColumn("part", _part(seed))
    before = F.sum("words").over(Window.partitionBy("skey", "block").orderBy("part")) - F.col("words")
    parts = materialize(within.groupBy("skey", "block", "part").agg(F.sum("size").alias("words")).withColumn("start", before), "parts")
    open_ = within.join(parts, ["skey", "block", "part"]).where(F.exists("takes", lambda t: (t > F.col("start")) & (t < F.col("start") + F.col("words"))))
    rows = open_.groupBy("skey", "block", "part", "id").agg(F.sum("size").alias("all"), F.count("*").alias("twins"))
    inside = F.sum("all").over(Window.partitionBy("skey", "block", "part").orderBy(_order(seed), "id")) - F.col("all")
    return parts, materialize(rows.select("skey", "id", inside.alias("inside"), "twins"), "inside")


def _placed(docs: DataFrame, size: Column | None, identity: Column | None, seed: int, **options: int) -> DataFrame:
    """doc (all columns of docs as one struct), id, size, source_size, target and copies (array of (epoch, words, shard))."""
    size = word_count(F.col("text")) if size is None else size
    identity = row_hash() if identity is None else identity
    rows = docs.select(whole_row(docs).alias("doc"), identity.alias("id"), "source", size.alias("size"))
    sizes = materialize(rows.select("id", "source", "size"), "sizes")
    plan = materialize(block_plan(sizes, seed=seed, **options), "plan")
    parts, open_rows = _cut_parts(sizes, plan, seed)
    own = rows.withColumn("skey", _key()).join(_few(plan.select("skey", "n_blocks").distinct()), "skey").withColumn("block", _block(seed, F.col("n_blocks"))).drop("source", "n_blocks")
    placed = own.join(_few(plan.drop("n_blocks")), ["skey", "block"]).withColumn("part", _part(seed))
    placed = placed.join(_few(parts), ["skey", "block", "part"], "left").join(_few(open_rows), ["skey", "id"], "left")
    def words(c: Column) -> Column:
        left = F.floor(F.greatest(F.lit(0), F.least(F.col("size") * F.col("twins"), c["take"] - F.col("start") - F.col("inside"))) / F.col("twins"))
        return F.when(c["whole"] | (F.col("start") + F.col("words") <= c["take"]), F.col("size")).when(F.col("start") >= c["take"], 0).otherwise(left).cast("long")

    made = F.transform(F.coalesce("copies", F.array()), lambda c: F.struct(c["epoch"].alias("epoch"), words(c).alias("words"), c["shard"].alias("shard")))
    return placed.select("doc", "id", "size", "source_size", "target", F.filter(made, lambda c: c["words"] > 0).alias("copies"))


def mix(docs: DataFrame, size: Column | None = None, identity: Column | None = None, seed: int = SEED, **options: int) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_taken and mix_copies (array of (epoch, words, shard)), one
    row a document.  size and identity may say where its words and its hash stand already."""
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    own = {"mix_size": F.col("size"), "mix_source_size": F.col("source_size"), "mix_target": F.col("target"), "mix_taken": taken, "mix_copies": F.col("copies")}
    kept = [F.col("doc")[c].alias(c) for c in docs.columns if c.lower() not in own]
    return _placed(docs, size, identity, seed, **options).select(*kept, *[v.alias(k) for k, v in own.items()])


def mixed_documents(docs: DataFrame, seed: int = SEED, **options: int) -> DataFrame:
    """The mix itself: a row for each copy with the columns of docs, dealt to shards and shuffled within each.

    The one document a source's target cuts keeps its first words, joined by single spaces.
    """
    copies = _placed(docs, None, None, seed, **options).withColumn("copy", F.explode("copies"))
    text = F.when(F.col("copy.words") < F.col("size"), F.array_join(F.slice(word_array(F.col("doc.text")), 1, F.col("copy.words").cast("int")), " ")).otherwise(F.col("doc.text"))
    order = F.xxhash64(F.lit(seed + 4), "id", "copy.epoch")
    ready = copies.select("doc", text.alias("text"), F.col("copy.shard").alias("shard"), order.alias("place")).repartition("shard").sortWithinPartitions("shard", "place")
    return ready.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
