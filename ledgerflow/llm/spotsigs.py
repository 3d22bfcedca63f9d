"""Document fingerprints by spot signatures.

Common words are anchors. Each anchor is followed by a chain of the next content words; the
chains of a text, as hashes, are its signature set. Likeness is the Jaccard measure of two
sets. For a search, sets are partitioned by length, so that only sets whose lengths allow the
threshold meet, and are compared through their rarest signatures first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Anchor words of English, French, German and Spanish (fixed values).
ANCHORS = (
    "the of and to in is that it was for "
    "le la les de des et est un une que "
    "der die das und ist ein den von mit nicht "
    "el los las y en es del por para con"
).split()
CHAIN = 3
BUCKET_BYTES = 4_000_000
MOST_BUCKETS = 4096
LEAST_BUCKETS = 64
_MARK = "\x01"


def signatures(text: Column) -> Column:
    """Sorted distinct signatures (longs of 32 bits) of a text without nulls. A text without
    anchors takes every word for one; without words its signature is the text itself, an empty
    text has none."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    words = F.replace(words, F.lit("  "), F.lit(" "))
    chain = f"([^ ]+(?: [^ ]+){{0,{CHAIN - 1}}})"
    hashed = lambda a: F.transform(a, lambda m: F.xxhash64(F.rtrim(F.translate(m, _MARK, ""))).bitwiseAND(0xFFFFFFFF))
    whole = F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(text).bitwiseAND(0xFFFFFFFF)))

    def behind(words: Column, marked: Column) -> Column:
        """Chains behind the marks; a text of anchors alone has marks but no chain."""
        spots = F.regexp_extract_all(marked, F.lit(f"{_MARK}(?={chain})"), F.lit(1))
        every = F.regexp_extract_all(words, F.lit(f" (?={chain})"), F.lit(1))
        some = lambda found: F.when(F.size(found) > 0, hashed(found)).when(words.rlike("[^ ]"), hashed(every)).otherwise(whole)
        return _once(spots, some)

    marked = lambda w: F.regexp_replace(w, f"(?<= )(?:(?:{'|'.join(ANCHORS)}) )++", _MARK)
    out = _once(words, lambda w: _once(marked(w), lambda m: behind(w, m)))
    return F.array_sort(F.array_distinct(out))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard measure of two signature sets; two empty ones are equal."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 1.0).otherwise(shared / union)


def fingerprint(signatures: Column) -> Column:
    """The signature set as text: eight hexadecimal digits each, in ascending order."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, signatures) with ``next`` and ``next_signatures``: those of the row that
    follows in the order of (doc_id, text), null ids first; after the last comes the first. Null
    text is empty. Signatures are worked out before the rows are moved, once per text.

    Rows are bucketed by quantiles of the id, at most MOST_BUCKETS; each bucket also gets the
    first row of the next one, so that no order spans a task more than a bucket. The driver
    reads the quantiles and each bucket's first id.
    """
    own = docs.select(
        F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("o"), F.coalesce("text", F.lit("")).alias("text")
    )
    size = own.agg(F.sum(F.octet_length("text"))).first()[0]
    if size is None:
        own = own.select("doc_id", "text", signatures(F.col("text")).alias("signatures"))
        return own.select("*", F.lit("").alias("next"), F.col("signatures").alias("next_signatures"))
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)))
    shares = [F.lit((i + 1) / buckets) for i in range(buckets - 1)]
    edges = sorted(set(own.agg(F.percentile_approx("o", F.array(*shares), 20 * buckets)).first()[0]))
    steps = F.array(*[F.lit(e) for e in edges])
    # the number of edges below the id, by halving
    placed = own.withColumn("bucket", _rank(F.col("o"), steps, len(edges)))
    first = sorted((r["bucket"], r["o"]) for r in placed.groupBy("bucket").agg(F.min("o").alias("o")).collect())
    after = [F.struct(F.lit(b).alias("b"), F.lit(first[(i + 1) % len(first)][1]).cast("long").alias("follows")) for i, (b, _) in enumerate(first)]
    follows = docs.sparkSession.range(1).select(F.inline(F.array(*after)))
    extra = own.join(F.broadcast(follows), F.col("o") == F.col("follows")).select(
        F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "o", "text", F.col("b").alias("bucket"), F.lit(1).alias("extra")
    )
    both = placed.withColumn("extra", F.lit(0)).select("doc_id", "o", "text", "bucket", "extra").union(extra)
    both = both.withColumn("signatures", signatures(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("extra", "o", "text")
    following = [F.lead(c).over(order).alias(n) for c, n in (("text", "next"), ("signatures", "next_signatures"))]
    return both.select("*", *following).filter("extra = 0").select("doc_id", "text", "signatures", "next", "next_signatures")


def _rank(value: Column, steps: Column, count: int) -> Column:
    """How many of the ascending steps are below a value."""
    low, high = F.lit(0), F.lit(count)
    span = F.struct(low.alias("low"), high.alias("high"))
    halves = F.sequence(F.lit(1), F.lit(max(1, count.bit_length() + 1)))

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = (s["low"] < s["high"]) & (F.element_at(steps, F.least(middle + 1, F.lit(count))) < value)
        return F.struct(
            F.when(below, middle + 1).otherwise(s["low"]).alias("low"),
            F.when(below | (s["low"] >= s["high"]), s["high"]).otherwise(middle).alias("high"),
        )

    return F.aggregate(halves, span, step, lambda s: s["low"]).cast("int") if count else F.lit(0)


def edited(text: Column, following: Column) -> Column:
    """The last quarter of a text (code points, rounded down) replaced by the start of another."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))


def compared(docs: DataFrame) -> DataFrame:
    """For every row of documents (doc_id, text): doc_id, text, edited, signatures,
    edited_signatures, near_edited and near_next, likenesses (double) to the edited text and to
    the next document. Rows that repeat follow each other. Other columns are not read."""
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next")))
    rows = rows.withColumn("edited_signatures", signatures(F.col("edited")))
    return rows.select(
        "doc_id", "text", "edited", "signatures", "edited_signatures",
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


def near_pairs(sets: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Pairs of different signature sets that are alike: (a, b, likeness), a < b.

    ``sets`` has id and signatures; of ids with equal sets the smallest stands for all (join on
    the set for the others), null ids and empty sets take no part. Sets are partitioned by
    length: partition k holds lengths from threshold^-k to threshold^-(k+1), so alike sets lie in
    one partition or in neighbouring ones. Within them, sets meet through a signature among their
    rarest few, as many as a pair at the threshold must share one of, and a pair is dropped
    before its sets are fetched if the lengths rule it out.
    """
    classes = sets.filter(F.col("id").isNotNull() & (F.size("signatures") > 0)).groupBy("signatures").agg(F.min("id").alias("id"))
    size = F.size("signatures")
    rows = classes.select("id", "signatures", size.alias("n"), F.floor(F.log(size.cast("double")) / -F.log(F.lit(threshold)) + 1e-9).alias("part"))
    each = rows.select("id", "n", "part", F.explode("signatures").alias("s"))
    rarity = each.groupBy("s").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "s"))
    prefix = each.join(rarity, "s").withColumn("rank", rank).filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "s", "part")
    meet = left.join(right, ["s", "part"]).filter((F.col("na") <= F.col("nb")) & (F.col("a") != F.col("b")) & (F.col("na") >= threshold * F.col("nb") - 1e-9))
    pairs = meet.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one, two = (rows.select(F.col("id").alias(x), F.col("signatures").alias(f"s{x}")) for x in "ab")
    out = pairs.join(one, "a").join(two, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return out.filter(F.col("likeness") >= threshold)
