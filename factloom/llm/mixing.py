"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents, in a pseudorandom order, form one stream of words, packed into blocks of
`block` words; a source's last block may be shorter. A source's target fixes how many words it gives: whole passes over its blocks,
then as many blocks as the rest fills, the last one cut, so its total is the target to a word. Slot j of a source maps
to block p(j) of its B blocks, p(j) = (a * (j - s) - 1) mod B with a prime a and a slot s of its own for each pass: a
permutation, so a pass takes every block once, and the short block stands in slot s. Slots are then joined with
blocks by (source, block).

Output shards hold `shard_slots` slots each (the last one the rest): all sources' slots are put in one pseudorandom order and cut.
So a shard's source counts are a multinomial draw of fixed size by the sources' shares, with the totals of all
shards fixed (a multivariate hypergeometric one): shards are alike in mixture, and targets are still met exactly.

Draws are MD5 of keys, so other engines can repeat them. Sums over a whole order are taken in three steps, over coarse
buckets, over fine buckets in each, and inside these, so no task holds a source or all slots. Products of block
numbers are taken in decimals where they could pass 64 bits.

Cases: a null text has no words; documents without words are never taken; null sources are one source,
last in order; rows with a null doc_id are ordered by where they lie; repeated rows are documents of their own; an
empty table gives no rows; extra columns are ignored by mix() and kept by mix_documents().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.llm.common import packed, staged, word_count

#: Primes near 10**18 and 2**61: each is coprime to any smaller number of blocks.
PRIMES = (2305843009213693951, 1000000000000000009, 1000000000000000003, 999999999999999989)
WEIGHTS = (3, 1, 2)
#: A table of sources up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 20_000
ROWS_PER_BUCKET, SLOTS_PER_CHUNK = 256, 1024
BLOCK, SHARD_SLOTS = 256, 4096
#: Bits of a draw.
BITS = 60


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, rank, target) from (source, size) rows, one row a source.

    Sources by code point, null last, weigh `weights` in turn and share `share` of all words; none gets
    over `most` times its own, and what is over goes to the others by weight until none is above. In order
    of capacity a weight, a source is full exactly if the level reached with all before it full covers it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("rank", F.row_number().over(order).cast("long"))
    turn = F.array(*(F.lit(float(w)) for w in weights))
    per = per.withColumn("weight", F.element_at(turn, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("room", F.col("source_size") * F.lit(float(most)))
    everything = W.partitionBy()
    before = W.orderBy(F.col("room") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(everything) * F.lit(share)).withColumn("weights", F.sum("weight").over(everything))
    left = F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0.0))
    open_weight = F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("full", F.col("room") * open_weight <= left * F.col("weight"))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(everything), F.lit(0.0))
    shared = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("room")).otherwise(F.least("room", rest * F.col("weight") / shared))
    return per.select("source", "source_size", "rank", target.alias("target"))


def _draw(*of: Column | str) -> Column:
    """BITS pseudorandom bits of the columns' texts."""
    key = F.concat_ws("|", *(c if isinstance(c, Column) else F.lit(c) for c in of))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _turn(j: Column, blocks: Column) -> Column:
    return ((j - F.pmod(j, blocks)) / blocks).cast("long")


def _short_slot(turn: Column, blocks: Column, rank: Column) -> Column:
    """The slot of a pass that its last block, which may be short, stands in."""
    return F.pmod(_draw("short", rank, turn), blocks)


def _permuted(j: Column, blocks: Column, rank: Column) -> Column:
    """Block of slot j: each pass over [0, blocks) is a permutation, for any number of blocks below 10**17."""
    turn = _turn(j, blocks)
    prime = F.element_at(F.array(*(F.lit(p) for p in PRIMES)), (F.pmod(_draw("prime", rank, turn), F.lit(len(PRIMES))) + 1).cast("int"))
    step = F.pmod(prime, blocks)
    away = F.pmod(F.pmod(j, blocks) - _short_slot(turn, blocks, rank), blocks)
    wide = lambda c: c.cast("decimal(18,0)")
    # 38 digits hold the product of two numbers of 18.
    far = (wide(step) * wide(away) % wide(blocks)).cast("long")
    product = F.when(blocks < F.lit(2**31), F.pmod(step * away, blocks)).otherwise(far)
    return F.pmod(product + blocks - 1, blocks)


def _bits(rows: int) -> int:
    """Bits of the draw that name a bucket of about ROWS_PER_BUCKET of so many rows."""
    return max(0, (rows // ROWS_PER_BUCKET).bit_length())


def _placed(df: DataFrame, by: list[str], bits: int, weight: Column, ties: list[str]) -> DataFrame:
    """df (with draw) and `before`: the sum of weight over the rows of the same `by` that stand before, by draw and ties."""
    df = df.withColumn("bucket", F.shiftright("draw", BITS - bits))
    fine = df.groupBy(*by, "bucket").agg(F.sum(weight).alias("w")).withColumn("coarse", F.shiftright("bucket", bits // 2))
    earlier = lambda keys, order: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    coarse = fine.groupBy(*by, "coarse").agg(F.sum("w").alias("w")).select(*by, "coarse", F.coalesce(F.sum("w").over(earlier(by, "coarse")), F.lit(0)).alias("far"))
    near = F.coalesce(F.sum("w").over(earlier([*by, "coarse"], "bucket")), F.lit(0))
    base = fine.join(coarse, [*by, "coarse"]).select(*by, "bucket", (F.col("far") + near).alias("base"))
    inside = W.partitionBy(*by, "bucket").orderBy("draw", *ties).rowsBetween(W.unboundedPreceding, -1)
    return df.join(base, [*by, "bucket"]).withColumn("before", F.col("base") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).drop("bucket", "base")


def mix(rows: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """rows (row, doc_id, source, size), row unique -> (documents, pieces).

    row only tells rows of one doc_id and size apart.

    documents adds source_size and target to rows; pieces has a row for each stretch of a document's words in
    an output slot: shard, place (in it), rank (of its source), slot, turn (0: first pass), row, first (word), n (words).
    """
    sources = staged(targets(rows.select("source", "size")), "sources")
    n_sources, n_docs = sources.count(), rows.count()
    small = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    docs = rows.join(small.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # The order depends on the documents alone, not on how the table lies in files: reruns agree.
    drawn = docs.where("size > 0").withColumn("draw", _draw("document", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), "row")), F.col("size")))
    streams = _placed(drawn, ["rank"], _bits(n_docs), F.col("size"), ["doc_id", "size", "row"]).withColumnRenamed("before", "start")
    length = F.lit(block).cast("long")
    stop = F.col("start") + F.col("size")
    covers = F.sequence(F.floor(F.col("start") / length), F.floor((stop - 1) / length))
    blocks = streams.select("rank", "row", "start", stop.alias("stop"), F.explode(covers).alias("block")).select(
        "rank", "block", "row",
        (F.greatest("start", F.col("block") * length) - F.col("start")).alias("first"),
        (F.greatest("start", F.col("block") * length) - F.col("block") * length).alias("at"),
        (F.least("stop", (F.col("block") + 1) * length) - F.greatest("start", F.col("block") * length)).alias("n"),
    )
    slots = staged(_slots(sources, block), "slots")
    n_slots = slots.count()
    # A slot weighs 1, so what stands before it is its place among all.
    ordered = _placed(slots.withColumn("draw", _draw("shard", F.col("rank"), F.col("slot"))), [], _bits(n_slots), F.lit(1).cast("long"), ["rank", "slot"])
    size = F.lit(shard_slots).cast("long")
    dealt = ordered.select("rank", "slot", "turn", "block", "words", F.floor(F.col("before") / size).alias("shard"), F.pmod("before", size).alias("place"))
    # Spark may take the slots for small and broadcast them: forbidden, they grow with the data.
    met = dealt.hint("merge").join(blocks, ["rank", "block"]).withColumn("n", F.least(F.col("n"), F.col("words") - F.col("at"))).where("n > 0")
    return docs, met.select("shard", "place", "rank", "slot", "turn", "row", "first", "n")


def _slots(sources: DataFrame, block: int) -> DataFrame:
    """(rank, slot, turn, block, words): every slot of every source, its block and how many of its words it takes."""
    length = F.lit(block).cast("long")
    filled = sources.where("source_size > 0").select(
        "rank", "source_size", F.ceil(F.col("source_size") / length).alias("blocks"), F.floor(F.col("target") + 0.5).cast("long").alias("total")
    )
    passes = filled.select("*", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("total") > F.col("source_size")).cast("long"))).alias("turn"))
    mine = F.least(F.col("source_size"), F.col("total") - F.col("turn") * F.col("source_size"))
    # One slot more than the words fill, for the words that the short block lacks.
    passes = passes.withColumn("mine", mine).where("mine > 0").withColumn("many", F.least(F.col("blocks"), F.ceil(F.col("mine") / length) + 1))
    # A pass's slots are counted out in chunks, dealt to all tasks before each grows into its rows.
    chunk = F.lit(SLOTS_PER_CHUNK).cast("long")
    passes = passes.withColumn("last", F.floor((F.col("many") - 1) / chunk))
    total = passes.agg(F.coalesce(F.sum(F.col("last") + 1), F.lit(1))).first()[0]
    # A number of tasks by the rows to come: by the few bytes of the chunks Spark would deal them to one.
    tasks = min(-(-total // 64), max(200, -(-total // 4096)))
    chunks = passes.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).repartition(tasks, "rank", "turn", "chunk")
    places = F.explode(F.sequence(F.col("chunk") * chunk, F.least(F.col("many"), (F.col("chunk") + 1) * chunk) - 1)).alias("j")
    lacking = F.col("blocks") * length - F.col("source_size")
    slots = chunks.select("*", places).withColumn("slot", F.col("turn") * F.col("blocks") + F.col("j"))
    slots = slots.withColumn("block", _permuted(F.col("slot"), F.col("blocks"), F.col("rank"))).withColumn("short", _short_slot(F.col("turn"), F.col("blocks"), F.col("rank")))
    ahead = F.col("j") * length - F.when(F.col("short") < F.col("j"), lacking).otherwise(0)
    own = length - F.when(F.col("short") == F.col("j"), lacking).otherwise(0)
    return slots.select("rank", "slot", "turn", "block", F.least(own, F.col("mine") - ahead).alias("words")).where("words > 0")


def shard_counts(pieces: DataFrame) -> DataFrame:
    """The multinomial draws: slots of each source in each output shard."""
    return pieces.groupBy("shard", "rank").agg(F.countDistinct("slot").alias("slots"))


def op8_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target (of its source), taken (words the mix takes, repeats counted), first_shard that
    holds words of it (null: none) and n_shards."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("row", F.monotonically_increasing_id())
    documents, pieces = mix(staged(rows, "sizes"))
    # A document has a row a shard at most between the two sums: the second is small.
    per_shard = pieces.groupBy("row", "shard").agg(F.sum("n").alias("n"))
    taken = per_shard.groupBy("row").agg(F.sum("n").alias("taken"), F.min("shard").alias("first_shard"), F.count("*").alias("n_shards"))
    return documents.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", F.coalesce("n_shards", F.lit(0)).cast("long").alias("n_shards")
    )


def mix_documents(docs: DataFrame, in_shards: bool = False) -> DataFrame:
    """The mix as documents in their own columns: a row for each document and pass that takes words of it.

    Its text is those words in their order with the white space after each kept; n_chars, where it is a
    column, is that text's length. A document's words come at most twice, so it has at most two rows. With in_shards
    rows lie in the order of the shard and place of their first words, whole shards in a partition; that shuffles the texts
    once more, in vain where the next step sorts by something else.
    """
    numbered = staged(packed(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")
    rows = numbered.select("row", "_doc.doc_id", "_doc.source", word_count(F.col("_doc.text")).alias("size"))
    _, pieces = mix(staged(rows, "sizes"))
    spans = pieces.groupBy("row", "turn").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("spans"), F.min(F.struct("shard", "place")).alias("at"))
    whole = numbered.join(spans.drop("turn"), "row")
    words = F.regexp_extract_all("_doc.text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.element_at(
        F.transform(
            F.array(words),
            lambda w: F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(w, (s["first"] + 1).cast("int"), s["n"].cast("int")))), ""),
        ),
        1,
    )
    out = whole.select("_doc", "at", cut.alias("cut")).withColumn("_doc", F.col("_doc").withField("text", F.col("cut")))
    if "n_chars" in docs.columns:
        out = out.withColumn("_doc", F.col("_doc").withField("n_chars", F.char_length("cut").cast(docs.schema["n_chars"].dataType)))
    if in_shards:
        out = out.repartition("at.shard").sortWithinPartitions("at.shard", "at.place", "_doc.doc_id")
    return out.select("_doc.*")


def oracle() -> str:
    """The same in DuckDB: targets, streams, blocks, permuted slots, shards."""
    draw = lambda *of: f"('0x' || md5(concat_ws('|', {', '.join(of)}))[1:{BITS // 4}])::BIGINT"
    primes = f"([{', '.join(map(str, PRIMES))}]::BIGINT[])"
    return f"""
WITH sized AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, ([{', '.join(f'{w}.0' for w in WEIGHTS)}]::DOUBLE[])[((rank - 1) % {len(WEIGHTS)}) + 1] AS weight, source_size * 2.0::DOUBLE AS room FROM per),
summed AS (SELECT *, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS total, sum(weight) OVER () AS weights,
  coalesce(sum(room) OVER early, 0) AS room_before, coalesce(sum(weight) OVER early, 0) AS weight_before
  FROM weighed WINDOW early AS (ORDER BY room / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, room * (weights - weight_before) <= (total - room_before) * weight AS is_full FROM summed),
sources AS (SELECT source, source_size, rank, CASE WHEN is_full THEN room ELSE least(room,
  (total - coalesce(sum(room) FILTER (is_full) OVER (), 0)) * weight / sum(weight) FILTER (NOT is_full) OVER ()) END AS target FROM judged),
docs AS (SELECT sized.*, rank, source_size, target FROM sized JOIN sources ON sized.source IS NOT DISTINCT FROM sources.source),
streams AS (SELECT rank, rid, size, coalesce(sum(size) OVER (PARTITION BY rank ORDER BY {draw("'document'", "doc_id::VARCHAR", "size::VARCHAR")}, doc_id, size, rid
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM docs WHERE size > 0),
blocks AS (SELECT rank, rid, block, greatest(start, block * {BLOCK}) - block * {BLOCK} AS skipped, least(start + size, (block + 1) * {BLOCK}) - greatest(start, block * {BLOCK}) AS n
  FROM (SELECT *, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS block FROM streams)),
passes AS (SELECT *, least(source_size, total - turn * source_size) AS mine FROM (
  SELECT rank, source_size, ((source_size + {BLOCK} - 1) // {BLOCK})::BIGINT AS blocks, floor(target + 0.5)::BIGINT AS total, unnest([0, 1])::BIGINT AS turn FROM sources WHERE source_size > 0)),
places AS (SELECT *, turn * blocks + j AS slot, {draw("'short'", "rank::VARCHAR", "turn::VARCHAR")} % blocks AS short, {primes}[{draw("'prime'", "rank::VARCHAR", "turn::VARCHAR")} % {len(PRIMES)} + 1] AS prime
  FROM (SELECT *, unnest(range(blocks)) AS j FROM passes WHERE mine > 0)),
slots AS (SELECT rank, slot, turn, (((prime % blocks)::HUGEINT * ((j - short + blocks) % blocks) + blocks - 1) % blocks)::BIGINT AS block,
  least({BLOCK} - CASE WHEN short = j THEN blocks * {BLOCK} - source_size ELSE 0 END, mine - (j * {BLOCK} - CASE WHEN short < j THEN blocks * {BLOCK} - source_size ELSE 0 END)) AS words FROM places),
dealt AS (SELECT *, (row_number() OVER (ORDER BY {draw("'shard'", "rank::VARCHAR", "slot::VARCHAR")}, rank, slot) - 1) // {SHARD_SLOTS} AS shard FROM slots WHERE words > 0),
pieces AS (SELECT rid, shard, least(n, words - skipped) AS n FROM dealt JOIN blocks ON dealt.rank = blocks.rank AND dealt.block = blocks.block),
taken AS (SELECT rid, sum(n)::BIGINT AS taken, min(shard)::BIGINT AS first_shard, count(DISTINCT shard)::BIGINT AS n_shards FROM pieces WHERE n > 0 GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_shard, coalesce(n_shards, 0)::BIGINT AS n_shards FROM docs LEFT JOIN taken USING (rid)"""
