"""Line dedup by a segment-partition edit join (DataFrame operations only).

A line of n characters may differ from another by one edit for every ``per`` characters of
the shorter, up to ``most``. A line that allows t edits is cut into t + 1 segments (threshold
plus one), indexed by (n, which, segment): t edits leave one of them whole. A line of n to
n + t characters probes with its substrings at the places that the length difference and
the segments on either side allow. What meets is verified by a banded edit distance on
bits; before, lines go whose characters' parities differ in more bits than twice the edits.
Segments that very many lines share are not paired: their lines are compared with the
nearest of those chosen under their segments, and only those that stay in different
components are then paired.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, cut, documents, lookup, text_or_empty
from .components import components, key_links

#: A segment with more lines is handled by components.
PAIRED = 32
#: Columns after which the edit distance of a pair is given up if no bit is left.
HEAD = 16


@dataclass(frozen=True)
class Places:
    """How a line's place packs its document's id, its row and its line number into one decimal.

    place = id * 10^19 + row * lines + line number; a null id is 2^63, so it comes last. Rows are numbered
    by their partition and place in the input, which must be read the same way each time (a table or a
    written frame), so rows with equal or null ids have places of their own.
    """

    rows: int  # rows of a partition at most
    lines: int  # lines of a text at most

    @classmethod
    def of(cls, docs: DataFrame, text_col: str) -> Places:
        row = docs.select(F.monotonically_increasing_id().alias("r"), F.octet_length(text_or_empty(text_col)).alias("b"))
        found = row.agg(F.max(F.col("r").bitwiseAND(F.lit(_IN_PART))).alias("r"), F.max("b").alias("b"), F.max(F.shiftright("r", 33)).alias("p")).first()
        out = cls((found["r"] or 0) + 1, (found["b"] or 0) + 2)
        if ((found["p"] or 0) + 1) * out.rows * out.lines >= 10**19:
            raise ValueError("places of the lines of so many rows and so long texts need more than 19 digits")
        return out

    def of_row(self, doc_id: Column, row: Column) -> Column:
        """The place of a row's line 0, to which a line's number is added: decimals are multiplied once a row."""
        dense = _wide(F.shiftright(row, 33) * F.lit(self.rows) + row.bitwiseAND(F.lit(_IN_PART)))
        return (F.coalesce(_wide(doc_id), _wide(F.lit(_NULL_ID))) * F.lit(_ID) + dense * F.lit(Decimal(self.lines))).cast(_WIDE)

    def doc_id(self, place: Column) -> Column:
        rest = F.pmod(place, F.lit(_ID))
        number = ((place - rest) / F.lit(_ID)).cast(_WIDE)
        return F.when(number < F.lit(_NULL_ID), number).cast("long")

    def line_no(self, place: Column) -> Column:
        return F.pmod(F.pmod(place, F.lit(_ID)), F.lit(Decimal(self.lines))).cast("int")


_WIDE, _ID, _NULL_ID, _IN_PART = "decimal(38,0)", Decimal(10**19), Decimal(1 << 63), (1 << 33) - 1


def _wide(c: Column) -> Column:
    return c.cast(_WIDE)


def _not_blank(line: Column) -> Column:
    return F.length(F.trim(line)) > 0


def _line_key() -> Column:
    """96 bits of hashes of the column line."""
    key = F.xxhash64("line").cast(_WIDE) * F.lit(4294967296).cast("decimal(10,0)") + F.hash("line").cast("decimal(10,0)")
    return key.cast(_WIDE)


def _lines(docs: DataFrame, places: Places, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, line_no, line, line_key, place) of all lines but blank ones."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("base", places.of_row(F.col("doc_id"), F.col("row")))
    rows = rows.select("doc_id", "row", "base", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.where(_not_blank(F.col("line")))
    return rows.withColumns({"line_key": _line_key(), "place": (F.col("base") + F.col("line_no").cast("decimal(10,0)")).cast(_WIDE)}).drop("base")


def edits(n: Column, per: int, most: int) -> Column:
    """Edits that a line of n characters allows."""
    return F.least(F.lit(most), F.floor(n / per).cast("int"))


def within(x: Column, y: Column, t: Column, most: int) -> Column:
    """Whether two arrays of characters are at most ``t`` (up to ``most``) edits apart.

    A bit for each of the 2 x most + 1 diagonals, a word for each number of edits: the
    words of a column follow from those before by the mask of matching characters and shifts.
    A pair whose word for ``t`` has no bit left after the first ``HEAD`` columns goes no further.
    """
    names, full = [f"e{k}" for k in range(most + 1)], (1 << (2 * most + 1)) - 1

    def mask(c: Column, j: Column) -> Column:
        return sum((F.when(F.get(x, j + o) == c, 1 << (o + most)).otherwise(0) for o in range(-most, most + 1)), F.lit(0))

    def step(acc: Column, same: Column) -> Column:
        words = [acc["e0"].bitwiseAND(same)]
        for k in range(1, most + 1):
            less = acc[f"e{k - 1}"]
            word = acc[f"e{k}"].bitwiseAND(same).bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(words[-1], 1))
            words.append(word.bitwiseAND(F.lit(full)))
        return F.struct(*[w.alias(n) for w, n in zip(words, names, strict=True)])

    start = F.struct(*[F.lit(sum(1 << (most + i) for i in range(k + 1))).alias(n) for k, n in enumerate(names)])

    def reached(part: Column) -> Column:
        """The word for t after the columns of ``part``, the start of y; a column's mask is made once, then used by each word."""
        end = F.aggregate(F.transform(part, mask), start, step)
        return F.element_at(F.array(*[end[n] for n in names]), F.greatest(F.lit(0), F.least(F.lit(most), t)) + 1)

    apart = F.size(x) - F.size(y)
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(2 * most + 1)]), F.least(F.lit(most), F.greatest(F.lit(-most), apart)) + most + 1)
    return (F.abs(apart) <= t) & (reached(F.slice(y, 1, HEAD)) != 0) & (reached(y).bitwiseAND(bit) != 0)


def _probes(t: int, shorter: int) -> list[tuple[int, int]]:
    """(segment, shift) of the substrings with which a line probes lines ``shorter`` characters shorter
    that allow t edits: at most i edits before segment i, and at most t - i after it. Own segments come first."""
    own = [(i, 0) for i in range(t + 1)] if not shorter else []
    return own + [(i, s) for i in range(t + 1) for s in range(max(-i, shorter - t + i), min(i, shorter + t - i) + 1) if (i, s) not in own]


def _keys(most: int) -> list[tuple[int, int, int, list[int], bool]]:
    """(shorter, segment, shift, the t that use it, own) of each key of a line: its own segments
    (index and probe), and what it probes lines of its length and ``shorter`` characters less with."""
    out = []
    for shorter in range(most + 1):
        allowed = {k: _probes(k, shorter) for k in range(max(1, shorter), most + 1)}
        for i, shift in dict.fromkeys(p for probes in allowed.values() for p in probes):
            out.append((shorter, i, shift, [k for k, probes in allowed.items() if (i, shift) in probes], not shorter and not shift))
    return out


def _segment_keys(lines: DataFrame, per: int, most: int) -> DataFrame:
    """``lines`` with k0, k1, ... for ``line``: the keys of ``_keys``, null where not used.

    Lengths, edits and bounds of segments are columns of steps of their own, used more than once and so
    not put into each key again: the keys of two edits then fit into a method that the JVM compiles (of
    8,000 bytes at most; those of three and more do not, and are slower).
    """

    def div(x: Column, y: Column) -> Column:
        return F.call_function("div", x, y)

    shorters = range(most + 1)
    steps = lines.withColumn("_n", F.char_length("line"))
    steps = steps.withColumns({f"_t{d}": F.least(F.lit(most), div(F.col("_n") - d, F.lit(per)).cast("int")) for d in shorters})
    # Segment i begins after i / (t + 1) of the characters; the last one that is used ends with the line.
    steps = steps.withColumns({f"_b{d}_{i}": div((F.col("_n") - d).cast("long") * i, F.col(f"_t{d}") + 1).cast("int") for d in shorters for i in range(1, most + 1)})

    def bound(d: int, i: int) -> Column:
        return F.lit(0) if not i else F.col(f"_b{d}_{i}") if i <= most else F.col("_n") - d

    made = {}
    for at, (d, i, shift, used, _) in enumerate(_keys(most)):
        t, start = F.col(f"_t{d}"), bound(d, i)
        key = F.xxhash64(F.col("_n") - d, F.lit(i), F.substring("line", start + (shift + 1), bound(d, i + 1) - start))
        made[f"k{at}"] = F.when(t >= used[0] if used == list(range(used[0], most + 1)) else t.isin(used), key)
    return steps.select(*lines.columns, *[k.alias(c) for c, k in made.items()])


def _trimmed(x: Column, y: Column) -> Column:
    """Struct (x, y) of two strings without the start, then the end, that both have in common.

    Edits that make them equal need touch nothing else. Common parts are found by halving.
    """
    least = F.least(F.char_length(x), F.char_length(y))
    powers = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(least, F.lit(1)))).cast("int"))), lambda k: F.pow(F.lit(2), k).cast("int"))

    def common(part) -> Column:
        return F.aggregate(F.reverse(powers), F.lit(0), lambda p, k: F.when(part(p, k), p + k).otherwise(p))

    def bound(value: Column, then) -> Column:
        return F.element_at(F.transform(F.array(value), then), 1)

    start = common(lambda p, k: (p + k <= least) & (F.substring(x, p + 1, k) == F.substring(y, p + 1, k)))
    end = bound(start, lambda s: F.struct(s.alias("s"), common(lambda p, k: (p + k <= least - s) & (F.substring(x, F.char_length(x) - p - k + 1, k) == F.substring(y, F.char_length(y) - p - k + 1, k))).alias("e")))
    return bound(end, lambda c: F.struct(*[F.substring(z, c["s"] + 1, F.char_length(z) - c["s"] - c["e"]).alias(name) for z, name in ((x, "x"), (y, "y"))]))


def _classes(lines: DataFrame, per: int, most: int) -> DataFrame:
    """One row per different line: line_key, place of the first, n, and its keys."""
    keys = [F.max(f"k{i}").alias(f"k{i}") for i in range(len(_keys(most)))]
    return _segment_keys(lines.select("line_key", "place", "line"), per, most).groupBy("line_key").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"), *keys)


def _texts(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, line) of the first line of each of ``nodes`` (node, place)."""
    wanted = cut(nodes.select("node", F.col("place").alias("_place")).distinct())
    met = among(lines.select("place", "line"), "place", wanted, "_place").withColumn("line_key", _line_key()).join(wanted, (F.col("place") == F.col("_place")) & (F.col("line_key") == F.col("node")))
    return met.select("node", "line").dropDuplicates(["node"])


def near_links(lines: DataFrame, classes: DataFrame, per: int, most: int) -> DataFrame:
    """(u, v): pairs of line_keys within their edits, enough to join all that chains of such pairs join."""
    own = [at for at, (*_, mine) in enumerate(_keys(most)) if mine]
    entries = F.array(*[F.col(f"k{i}") for i in range(len(_keys(most)))])
    keyed = classes.select(F.col("line_key").alias("node"), "place", F.posexplode(entries).alias("at", "key")).where("key is not null").select("node", "place", "key", F.col("at").isin(own).alias("own"))
    counts = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.count_if("own").alias("owners")).where("members > 1 and owners > 0").drop("owners"))
    total = counts.agg(F.sum("members")).first()[0] or 0
    met = cut(lookup(among(keyed, "key", counts, "key"), counts, "key", "members", total, "node").where("members is not null"))
    # A bit for each character, by whether it occurs an odd number of times; an edit changes two at most.
    odd = F.aggregate(F.split("line", ""), F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c).bitwiseAND(F.lit(63)))))
    texts = cut(_texts(lines, met).select("node", "line", F.char_length("line").alias("n"), odd.alias("mask")))

    met = cut(met.select("key", "node", "own", "members").join(texts.select("node", "n", "mask"), "node"))
    allowed = edits(F.least("n", "n2"), per, most)
    apart = F.bit_count(F.col("mask").bitwiseXOR(F.col("mask2")))
    possible = (F.col("own") | F.col("own2")) & (F.abs(F.col("n") - F.col("n2")) <= allowed) & (apart <= 2 * allowed)

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = (texts.select(F.col("node").alias(side), F.col("line").alias(name)) for side, name in (("u", "x"), ("v", "y")))
        # Pairs are few bytes but much work: an explicit number of partitions is not coalesced by size.
        pairs = pairs.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "u", "v")
        # The lambda binds the characters once; a plain column would be split again at each step.
        allowed = edits(F.least(F.char_length("x"), F.char_length("y")), per, most)
        rest = F.transform(F.array(_trimmed(F.col("x"), F.col("y"))), lambda c: F.struct(*[F.filter(F.split(c[z], ""), lambda a: a != "").alias(z) for z in "xy"]))
        near = F.exists(rest, lambda c: within(c["x"], c["y"], allowed, most))
        return cut(pairs.join(x, "u").join(y, "v").where(near).select("u", "v"))

    return key_links(met, possible, apart, verify, ~F.col("own"), PAIRED)


def _found(docs: DataFrame, id_col: str, text_col: str, per: int, most: int) -> tuple[Places, DataFrame, DataFrame, int]:
    """The places, the lines, the different lines that are not alone (line_key, first_place of the class, n), and the number of all lines."""
    if per <= most:
        raise ValueError("a line must have more characters than edits")
    places = Places.of(docs, text_col)
    lines = _lines(docs, places, id_col, text_col)
    classes = cut(_classes(lines, per, most))
    found = components(near_links(lines, classes, per, most))
    linked = found.join(classes, F.col("node") == F.col("line_key")).select("line_key", "root", "place", "n")
    first = linked.groupBy("root").agg(F.min("place").alias("first_place"))
    named = linked.join(first, "root").select("line_key", "first_place", "n")
    alone = classes.where("n > 1").join(named.select("line_key"), "line_key", "left_anti").select("line_key", F.col("place").alias("first_place"), "n")
    table = cut(named.unionByName(alone))
    return places, lines, table, classes.agg(F.sum("n")).first()[0] or 0


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per: int = 24, most: int = 2) -> DataFrame:
    """One row per line that is not blank: ``id_col``, row, line_no, first_id, first_line, copies, kept.

    Lines are parted by line feeds and taken as they stand. Equal lines, and lines within
    one edit for every ``per`` characters of the shorter (up to ``most`` edits), form a class
    (chains included); its first line by (id, row, line number) is kept. ``row`` numbers the
    rows of the input, so rows with equal or null ids, repeated rows too, are documents of
    their own, of whose lines one is kept. ``copies`` counts the equal lines. Null texts
    have no lines; a null id comes last, and is null as first_id too. An empty table gives
    no rows; other columns are ignored. A line of less than ``most`` + 1 characters can
    allow none.
    """
    places, lines, table, total = _found(docs, id_col, text_col, per, most)
    joined = lookup(lines.select("doc_id", "row", "line_no", "place", "line_key"), table, "line_key", "n", total, "place")
    first_place = F.coalesce("first_place", "place")
    return joined.select(
        F.col("doc_id").alias(id_col), "row", "line_no", places.doc_id(first_place).alias("first_id"), places.line_no(first_place).alias("first_line"),
        F.coalesce("n", F.lit(1)).alias("copies"), (first_place == F.col("place")).alias("kept"),
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **opts) -> DataFrame:
    """(id_col, text) of each row without the lines that ``line_classes`` does not keep."""
    gone = line_classes(docs, id_col, text_col, **opts).where("not kept").groupBy(F.col("row").alias("_row")).agg(F.collect_set("line_no").alias("gone"))
    rows = docs.select(id_col, F.monotonically_increasing_id().alias("row"), text_or_empty(text_col).alias("t"))
    both = rows.join(gone, F.col("row") == F.col("_row"), "left")
    kept = F.filter(F.split("t", "\n"), lambda _, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    return both.select(id_col, F.array_join(kept, "\n").alias("text"))


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per: int = 24, most: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_lines, n_dropped, n_near (dropped without an equal line), and
    ``dropped``: each line that is not kept, by line number, as (line_no, first_id, first_line, copies).

    (first_id, first_line) names the class: its first line. Documents without lines have
    a row of zeros; rows with equal or null ids have rows of their own.
    """
    places, lines, table, _ = _found(docs, id_col, text_col, per, most)
    # Lines that are alone in their class stay where they are: only those that the table may name are dealt.
    named = among(lines.select("row", "line_no", "place", "line_key"), "line_key", table, "line_key")
    met = lookup(named, table, "line_key", "n", table.agg(F.sum("n")).first()[0] or 0, "place").where(F.col("first_place") < F.col("place"))
    gone = F.struct("line_no", places.doc_id(F.col("first_place")).alias("first_id"), places.line_no(F.col("first_place")).alias("first_line"), F.col("n").alias("copies"))
    found = met.groupBy(F.col("row").alias("_row")).agg(
        F.count(F.lit(1)).alias("n_dropped"), F.count_if(F.col("n") == 1).alias("n_near"), F.array_sort(F.collect_list(gone)).alias("dropped"),
    )
    n_lines = F.size(F.filter(F.split(text_or_empty(text_col), "\n"), _not_blank)).cast("long")
    every = docs.select(F.col(id_col).cast("long").alias(id_col), F.monotonically_increasing_id().alias("row"), n_lines.alias("n_lines"))
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_dropped", "n_near")]
    dropped = F.coalesce("dropped", F.array().cast(found.schema["dropped"].dataType)).alias("dropped")
    return every.join(found, F.col("row") == F.col("_row"), "left").select(id_col, "n_lines", *zeros, dropped)


def op5_segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those that repeat or nearly repeat an earlier one, how many of these
    have no equal line, and each of them with its class."""
    return document_lines(documents(spark, sf_dir))
