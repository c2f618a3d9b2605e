"""Token counts, with huge documents counted by overlapping chunks.

A huge document is cut about every ``chunk`` characters. Neighbouring chunks overlap and
both are encoded with offsets. The vocabulary's pattern has no memory: where two scans both
start a pre-token at one place, they agree from there on. So a place at which both chunks
start a pre-token, and whose pre-token the first chunk sees to its end, is proven, and the
counts are spliced there. An overlap in which scans from two starts do not align is doubled
before the chunks are encoded; chunks whose encodings still share no proven place are
widened to their neighbours, as far as needed, and encoded again. The place may be any
boundary, so texts without spaces are cut too; only one pre-token is never divided.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import library_table, slices
from .common import cut, documents, text_or_empty

#: Characters before a chunk's end in which a special string may have been cut off.
MARGIN = 32
_SIDE = "array<struct<p:long,n:long>>"
_ENCODED = f"row long, chunk int, n long, left {_SIDE}, right {_SIDE}, left_at long, right_at long"
_PATTERN = regex.compile(public_tokenizers.PATTERN)


def _proven(starts: list[int], end: int) -> list[int]:
    """Places among sorted pre-token starts whose pre-token ends before ``end``, for certain."""
    return [p for p, after in zip(starts, starts[1:], strict=False) if after < end and p + MARGIN <= end]


def plan_chunks(text: str, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Cuts of a text: (place, reach of the overlap to either side). A cut at which scans from two
    starts do not align in less than half a chunk is left out."""
    cuts: list[tuple[int, int]] = []
    for place in range(chunk, len(text) - chunk // 2, chunk):
        reach = max(overlap, MARGIN)
        while reach < chunk // 2:
            low, high = place - reach, place + reach
            near = {low + m.start() for m in _PATTERN.finditer(text[low:high])} - {low}
            first = max(0, low - reach)
            far = [first + m.start() for m in _PATTERN.finditer(text[first:high])]
            if near.intersection(_proven(far, high)):
                cuts.append((place, reach))
                break
            reach *= 2
    return cuts


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", chunk: int = 16_384, overlap: int = 128, name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each text, as the tokenizers library counts.

    A null or empty text has 0. Texts of over twice ``chunk`` characters are counted by
    overlapping chunks, which any number of tasks share; shorter ones by their chunks
    between single spaces, each of which a worker encodes once. Every row counts, repeated rows too; an
    empty table stays empty; the text column is dropped and all others are kept (a
    column named like ``name`` is replaced).
    """
    rest = [c for c in docs.columns if c not in (text_col, name)]
    # The struct keeps the caller's columns apart from ours, whatever their names.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*rest).alias("own"), text_or_empty(text_col).alias("text"))
    own = rows.schema["own"].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = library_table(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in slices(texts, [len(t) for t in texts]):
                mine = texts[part]
                counts = iter(table.counts([t for t in mine if len(t) <= 2 * chunk]).tolist())
                out = []
                for i, t in enumerate(mine, part.start):
                    if len(t) <= 2 * chunk:
                        out.append((i, i, next(counts), None, None, None, None, None, None, None))
                        continue
                    cuts = [(0, 0), *plan_chunks(t, chunk, overlap), (len(t), 0)]
                    for k, ((a, u), (b, v)) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        out.append((i, None if k else i, None, k, t[max(0, a - u) : b + v], max(0, a - u), a, u, b, v))
                index, owner, *columns = zip(*out, strict=True) if out else ([] for _ in range(10))
                kinds = (pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(pa.array(at, pa.int64())) for c, at in (("row", index), ("own", owner))] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["row", "own", "n_tokens", "chunk", "text", "base", "left_at", "left_reach", "right_at", "right_reach"],
                )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(vocabulary)
        for batch in batches:
            for r in batch.to_pylist():
                e = library.encode(r["text"], add_special_tokens=False)

                starts, at = [], []
                for k, (word, (place, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
                    if not starts or word != held:
                        starts.append(place)
                        at.append(k)
                    held = word
                base, index = r["base"], dict(zip(starts, at, strict=True))

                def within(places: list[int], place: int, reach: int, base=base, index=index) -> list[dict]:
                    return [{"p": base + p, "n": index[p]} for p in places if abs(base + p - place) <= reach]

                left, right = within(starts[1:], r["left_at"], r["left_reach"]), within(_proven(starts, len(r["text"])), r["right_at"], r["right_reach"])
                yield pa.RecordBatch.from_pylist(
                    [{"row": r["row"], "chunk": r["chunk"], "n": len(e), "left": left, "right": right, "left_at": r["left_at"], "right_at": r["right_at"]}],
                    schema=pa.schema([("row", pa.int64()), ("chunk", pa.int32()), ("n", pa.int64()), *[(c, pa.list_(pa.struct([("p", pa.int64()), ("n", pa.int64())]))) for c in ("left", "right")], ("left_at", pa.int64()), ("right_at", pa.int64())]),
                )

    pieces = cut(rows.mapInArrow(first, f"row long, own {own}, n_tokens long, chunk int, text string, base long, left_at long, left_reach long, right_at long, right_reach long"))
    chunks = pieces.where(F.col("chunk").isNotNull())
    usual = pieces.where(F.col("chunk").isNull()).select("own", "n_tokens")
    tasks = max(12, 2 * spark_parallelism(docs.sparkSession))
    agreed, open_ = [], chunks.drop("own", "n_tokens")
    while True:
        # Written out: rounds and counts read it, and a lost executor must not encode again.
        encoded = cut(splice(cut(open_.repartition(tasks).mapInArrow(encode, _ENCODED))))
        counted = encoded.groupBy("row").agg(F.when(F.count("n") == F.count(F.lit(1)), F.sum("n")).alias("n_tokens"))
        agreed.append(counted.where("n_tokens is not null"))
        if encoded.where("n is null").isEmpty():
            break
        open_ = cut(widened(open_, encoded))
    spliced = agreed[0]
    for more in agreed[1:]:
        spliced = spliced.unionByName(more)
    huge = chunks.where(F.col("chunk") == 0).select("row", "own").join(spliced, "row").select("own", "n_tokens")
    return usual.unionByName(huge).select(*[F.col("own")[c].alias(c) for c in rest], F.col("n_tokens").alias(name))


def spark_parallelism(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def splice(chunks: DataFrame) -> DataFrame:
    """(row, chunk, n, failed): the tokens of each chunk between its splices, null where one is not
    proven; ``failed``: the chunk and the next share no proven place."""
    order = Window.partitionBy("row").orderBy("chunk")
    both = chunks.withColumn("next_left", F.lead("left").over(order)).withColumn("is_last", F.lead("chunk").over(order).isNull())
    common = F.array_intersect(F.transform("right", lambda x: x["p"]), F.transform("next_left", lambda x: x["p"]))
    near = F.array_min(F.transform(common, lambda p: F.struct(F.abs(p - F.col("right_at")).alias("d"), p.alias("p"))))["p"]

    def tokens(side: str, place: str):
        return F.when(F.col(place).isNotNull(), F.get(F.transform(F.filter(side, lambda x: x["p"] == F.col(place)), lambda x: x["n"]), F.lit(0)))

    joined = both.withColumn("end_p", near)
    joined = joined.withColumn("start_p", F.lag("end_p").over(order)).withColumn("is_first", F.lag("chunk").over(order).isNull())
    start = F.when(F.col("is_first"), F.lit(0)).otherwise(tokens("left", "start_p"))
    end = F.when(F.col("is_last"), F.col("n")).otherwise(tokens("right", "end_p"))
    return joined.select("row", "chunk", (end - start).alias("n"), (~F.col("is_last") & F.col("end_p").isNull()).alias("failed"))


def widened(chunks: DataFrame, spliced: DataFrame) -> DataFrame:
    """Chunks of the rows that have a failed splice, those that it parts joined to one."""
    order = Window.partitionBy("row").orderBy("chunk")
    bad = spliced.where("n is null").select("row").distinct()
    group = F.sum((~F.coalesce(F.lag("failed").over(order), F.lit(False))).cast("int")).over(order) - 1
    number = spliced.join(bad, "row", "left_semi").select("row", "chunk", "failed").withColumn("group", group).select("row", "chunk", "group")

    def part(a: str, b: str):
        return F.expr(f"substring(text, cast({a} + 1 as int), cast({b} as int))")

    own = part("left_at - base", "right_at - left_at")
    joined = chunks.join(number, ["row", "chunk"]).select(
        "row", "group", F.struct("chunk", own.alias("own"), part("0", "left_at - base").alias("head"), part("right_at - base", "char_length(text)").alias("tail"), "base", "left_at", "left_reach", "right_at", "right_reach").alias("c")
    )
    # The members of a group are what one encoding has to see at once.
    held = joined.groupBy("row", "group").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    first, last = F.element_at("cs", 1), F.element_at("cs", -1)
    text = F.concat(first["head"], F.array_join(F.transform("cs", lambda c: c["own"]), ""), last["tail"])
    return held.select("row", F.col("group").cast("int").alias("chunk"), text.alias("text"), first["base"].alias("base"), first["left_at"].alias("left_at"), first["left_reach"].alias("left_reach"), last["right_at"].alias("right_at"), last["right_reach"].alias("right_reach"))


def op10_resynchronised_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; nulls, repeated rows and empty tables as in ``count_tokens``."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
