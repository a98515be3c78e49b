"""Fuzzy line dedup by MinHash, in DataFrame functions only.

A line is the set of its runs of ``WIDTH`` characters, lower-cased.  Its signature has ``MINIMA`` minima:
the smallest ``hash xor c`` over its runs, for as many constants ``c`` - the run whose hash lies nearest
to ``c``, so two lines agree with the probability of their Jaccard similarity.  ``BANDS`` bands of
four minima each (every minimum is in two bands) send a pair of similarity 0.8 to a common
bucket with a probability of about 0.99, and pairs of unlike lines to none.

Equal lines are one row, with the place of the first, as soon as they meet in a task.  A bucket compares its
lines with its smallest one first, then with ``PIVOTS`` others; lines so linked need no comparison among
themselves, and the last round compares the lines of a bucket that are in different components yet.  A pair
becomes a row only if the parities of its lines allow the similarity (``_parities``), and once, however many
buckets it shares.  Every link is verified by the exact Jaccard similarity; a distributed union-find gives components,
and the first line of each stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import Shared, components

WIDTH = 8
MINIMA, BANDS = 24, 12
# which minima a band takes, from twice its number on: two even and two odd ones
OFFSETS = (0, 1, 5, 12)
SIMILARITY = 0.8
# lines of a bucket that all its lines are compared with, before those in different components are
PIVOTS = 8
# words of 64 parities that stand for the runs of a line
PARITIES = 16
_ODD = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1


def _constant(i: int) -> int:
    x = (i + 1) * _ODD % (1 << 64)
    x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    return x - (1 << 64) if x >> 63 else x


def runs_of(line: Column) -> Column:
    """The runs of a line, repeats included; a shorter line is a run itself."""
    low = F.lower(line)
    return F.when(F.char_length(line) < WIDTH, F.array(low)).otherwise(F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{WIDTH}}}))"), F.lit(1)))


def _spelled(line: Column) -> Column:
    """A line lower-cased, in four bytes a character, so that a run is cut in constant time; where its last run begins, and the bytes of a run.

    A line shorter than a run is a run itself.  An array of one, to be exploded: the optimizer does not look through
    generators, so this is made once and not for every run.
    """
    wide, short = F.encode(F.lower(line), "UTF-32"), F.char_length(line) < WIDTH
    return F.array(F.struct(wide.alias("wide"), F.when(short, 0).otherwise(F.shiftright(F.octet_length(wide), 2) - WIDTH).alias("last"), F.when(short, F.octet_length(wide)).otherwise(4 * WIDTH).alias("size")))


def _run_places(spelled: str) -> Column:
    return F.sequence(F.lit(0), F.col(f"{spelled}.last"))


def _run_hash(spelled: str, place: Column) -> Column:
    """64 bits that stand for the run at a place."""
    return F.xxhash64(F.substring(F.col(f"{spelled}.wide"), place * 4 + 1, F.col(f"{spelled}.size")))


def _lines(docs: DataFrame) -> DataFrame:
    """``(id, text_hash, line_no, line)`` of the lines that hold more than blanks."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = rows.select("id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("id", "text_hash", "line_no", F.trim("line").alias("line")).where("line != ''")


def _named(lines: DataFrame) -> DataFrame:
    """With two independent hashes of 64 bits that stand for the line."""
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64("line", F.lit(WIDTH))})


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose texts (line_id, line) are similar enough."""
    left = texts.select(F.col("line_id").alias("a"), F.col("line").alias("line_a"))
    right = texts.select(F.col("line_id").alias("b"), F.col("line").alias("line_b"))
    runs = F.struct(F.array_distinct(runs_of(F.col("line_a"))).alias("a"), F.array_distinct(runs_of(F.col("line_b"))).alias("b"))
    # a generator, so that the runs of a pair are made once and not for every use of them
    met = pairs.join(left, "a").join(right, "b").select("a", "b", F.explode(F.array(runs)).alias("runs"))
    # before the sets are compared: sizes too far apart cannot be similar
    low, high = F.least(F.size("runs.a"), F.size("runs.b")), F.greatest(F.size("runs.a"), F.size("runs.b"))
    sized = met.where(low >= SIMILARITY * high).select("a", "b", (F.size("runs.a") + F.size("runs.b")).alias("sizes"), F.explode(F.array(F.size(F.array_intersect("runs.a", "runs.b")))).alias("both"))
    return sized.where(F.col("both") >= SIMILARITY * (F.col("sizes") - F.col("both"))).select("a", "b")


def _parities(texts: DataFrame) -> DataFrame:
    """``(line_id, runs, p0, p1, ...)``: how many different runs a line has, and whether an odd number of them falls on each of 64 * ``PARITIES`` places.

    A run that only one of two lines has changes one parity, so parities that differ are never more than such runs.
    """
    # dealt by line, so that a line's runs are made distinct and added up where they are cut
    dealt = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "line_id")
    cut = dealt.select("line_id", F.explode(_spelled(F.col("line"))).alias("spelled")).select("line_id", "spelled", F.explode(_run_places("spelled")).alias("at"))
    hashed = cut.select("line_id", _run_hash("spelled", F.col("at")).alias("h")).distinct()
    word, bit = F.col("h").bitwiseAND(PARITIES - 1), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 32) & 63 as int))")
    return hashed.groupBy("line_id").agg(F.count(F.lit(1)).alias("runs"), *[F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"p{i}") for i in range(PARITIES)])


def _of(rows: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return rows.withColumnsRenamed({c: f"{c}_{side}" for c in columns})


def _may_be_similar() -> Column:
    """False for a pair with more parities that differ than two lines similar enough have runs of one only."""
    differ = sum((F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))).cast("long") for i in range(PARITIES)), F.lit(0).cast("long"))
    both, few, many = F.col("runs_a") + F.col("runs_b"), F.least("runs_a", "runs_b"), F.greatest("runs_a", "runs_b")
    # at most (1 - s) / (1 + s) of the runs of both; a little more, so that rounding drops none
    return (few >= (SIMILARITY - 1e-9) * many) & (differ <= ((1 - SIMILARITY) / (1 + SIMILARITY) + 1e-9) * both)


def _first_bucket_of_pair() -> Column:
    """Of the buckets that two lines share, the first one."""
    before = [(F.col("band") <= i) | (F.col(f"band{i}_a") != F.col(f"band{i}_b")) for i in range(BANDS)]
    out = F.lit(True)
    for x in before:
        out = out & x
    return out


def duplicate_lines(docs: DataFrame) -> tuple[DataFrame, Shared]:
    """``(h1, h2, first_id, first_line)`` of every line that has copies or near copies, and where the one that stays is."""
    shared = Shared(docs.sparkSession)
    named = _named(_lines(docs))
    # once a line and not once a run
    place = F.col("id").cast("decimal(38,0)") * (1 << 31) + F.col("line_no")
    places = named.select("h1", "h2", place.alias("place")).groupBy("h1", "h2").agg(F.min("place").alias("place"), F.max("place").alias("last"))
    runs = named.select("h1", "h2", F.explode(_spelled(F.col("line"))).alias("spelled")).select("h1", "h2", "spelled", F.explode(_run_places("spelled")).alias("at"))
    hashed = runs.select("h1", "h2", _run_hash("spelled", F.col("at")).alias("h"))
    minima = [F.min(F.col("h").bitwiseXOR(F.lit(_constant(i)))).alias(f"m{i}") for i in range(MINIMA)]
    signed = hashed.groupBy("h1", "h2").agg(*minima).join(places, ["h1", "h2"])
    bands = F.array(*[F.xxhash64(F.lit(b), *[f"m{(2 * b + j) % MINIMA}" for j in OFFSETS]) for b in range(BANDS)])
    lines = shared.put("lines", signed.select(F.monotonically_increasing_id().alias("line_id"), "h1", "h2", "place", (F.col("last") > F.col("place")).alias("again"), bands.alias("bands")))
    buckets = lines.select("line_id", F.posexplode("bands").alias("band", "bucket")).repartition("bucket")
    least = buckets.groupBy("bucket").agg(F.min("line_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # exploded rows are many more than Spark takes them for: never sent whole to every task
    held = shared.put("buckets", buckets.hint("merge").join(least, "bucket"))
    wanted = held.select("line_id").distinct().join(lines.select("line_id", "h1", "h2"), "line_id")
    texts = shared.put("texts", _named(_lines(docs)).select("h1", "h2", "line").join(wanted, ["h1", "h2"]).groupBy("line_id").agg(F.max("line").alias("line")))
    parities = shared.put("parities", _parities(texts))
    sketch = [c for c in parities.columns if c != "line_id"]

    def similar(pairs: DataFrame) -> DataFrame:
        left = _of(parities.withColumnRenamed("line_id", "a"), "a", sketch)
        right = _of(parities.withColumnRenamed("line_id", "b"), "b", sketch)
        return _similar(pairs.join(left, "a").join(right, "b").where(_may_be_similar()).select("a", "b"), texts)

    def labels(links: DataFrame, name: str) -> DataFrame:
        first = components(shared, links, name).withColumnRenamed("node", "line_id").withColumnRenamed("component", "label")
        return held.select("bucket", "band", "line_id").join(first, "line_id", "left").select("bucket", "band", "line_id", F.coalesce("label", "line_id").alias("label"))

    def undecided(labelled: DataFrame) -> DataFrame:
        """The buckets with several components: no others have anything left to compare."""
        mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        return labelled.join(mixed.drop("high"), "bucket")

    stars = shared.put("stars", similar(held.where("line_id != a").select("a", F.col("line_id").alias("b")).distinct()))
    rest = shared.put("first", undecided(labels(stars, "ones")))
    some = rest.withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("line_id"), "line_id"))).where(F.col("nth") <= PIVOTS)
    pivots = some.select("bucket", F.col("line_id").alias("a"), F.col("label").alias("label_a"))
    more = rest.join(pivots, "bucket").where("label != label_a").select(F.least("a", "line_id").alias("a"), F.greatest("a", "line_id").alias("b")).distinct()
    links = shared.put("more", stars.unionByName(similar(more)))
    bands = lines.select("line_id", *[F.get("bands", F.lit(i)).alias(f"band{i}") for i in range(BANDS)])
    rest = shared.put("rest", undecided(labels(links, "some")).join(bands, "line_id").join(parities, "line_id"))
    # the lines outside the first component meet all lines of the bucket
    columns = ["label", *[f"band{i}" for i in range(BANDS)], *sketch]
    odd = _of(rest.where("label != low").drop("low").withColumnRenamed("line_id", "a"), "a", columns)
    every = _of(rest.drop("band").withColumnRenamed("line_id", "b"), "b", columns)
    left = odd.join(every, "bucket").where(((F.col("label_b") == F.col("low")) | (F.col("label_b") > F.col("label_a"))) & _first_bucket_of_pair() & _may_be_similar())
    links = links.unionByName(_similar(left.select("a", "b"), texts))
    joined = components(shared, links, "all").withColumnRenamed("node", "line_id")
    placed = lines.join(joined, "line_id", "left").where(F.col("again") | F.col("component").isNotNull()).select("h1", "h2", "place", F.coalesce("component", "line_id").alias("component"))
    kept = placed.groupBy("component").agg(F.min("place").alias("kept"))
    return shared.put("decided", placed.join(kept, "component").select("h1", "h2", "kept", "component")), shared


def removed_lines(docs: DataFrame) -> DataFrame:
    """``(id, text_hash, gone)``: the numbers of the lines that go, of documents that lose any."""
    decided, shared = duplicate_lines(docs)
    place = F.col("id").cast("decimal(38,0)") * (1 << 31) + F.col("line_no")
    met = _named(_lines(docs)).select("id", "text_hash", "line_no", "h1", "h2").join(decided.select("h1", "h2", "kept"), ["h1", "h2"]).where(place > F.col("kept"))
    return shared.put("gone", met.groupBy("id", "text_hash").agg(F.collect_set("line_no").alias("gone")))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with ``text`` less the lines that have a copy or near copy before them.

    Lines are parted by ``\\n`` and compared without blanks at their ends; blank lines stay.  "Before" means in a
    document of smaller ``doc_id`` (null ids come last) or earlier in the document; rows equal in id and text count
    as one document.  ``n_chars``, if there, is counted anew.  A document all of whose lines go stays, with an
    empty text; null texts stay null.
    """
    gone = removed_lines(docs)
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)).eqNullSafe(gone["id"]) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(gone["text_hash"])
    lines = F.split(docs["text"].cast("string"), "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone["gone"]), lambda i: F.get(lines, i))
    text = F.when(gone["gone"].isNull(), docs["text"]).otherwise(F.array_join(left, "\n"))
    columns = [(text.alias(c) if c == "text" else F.when(gone["gone"].isNull(), docs[c]).otherwise(F.char_length(text)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else docs[c]) for c in docs.columns]
    return docs.join(gone, key, "left").select(*columns)
