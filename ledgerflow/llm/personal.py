"""Personal data by patterns, and by bootstrapping from where they were found.

Base entities (mail and network addresses, card and phone numbers) are found by regular
expressions. They are the seeds: the word before each occurrence is a lexical pattern, the
words with digits or an at sign that occur behind it are its instances. Patterns and instances form a graph
over the whole corpus whose two sides score each other in rounds. Instances behind patterns
of high confidence that no expression knows become entities of the pattern's kind. All of it
is DataFrame expressions; what is exchanged is the few words with digits, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.sources.readers import materialise

KINDS = ("email", "ip", "card", "phone")
#: Base expressions. They are those of the contract, written so that no start is tried twice:
#: a match starts at the start of a run or where the last match ended, and what can't be given
#: back is possessive.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WHITE = r"\x20\x09-\x0D"
#: A word without digits, white space, and a word with a digit or an at sign.
CANDIDATE = rf"(?<![^{_WHITE}])[^{_WHITE}0-9@]++[{_WHITE}]++[^{_WHITE}0-9@]*+[0-9@][^{_WHITE}]*+"
#: What an instance of a kind has to look like, whatever its pattern says.
SHAPES = {
    "email": r"^[^\s@]+(@|\[at\]|\(at\))[^\s@]+$",
    "ip": r"^([0-9]{1,3}([.:_-][0-9]{1,3}){3}(:[0-9]+)?|[0-9a-f]{0,4}(:[0-9a-f]{0,4}){3,7})$",
    "card": r"^[0-9]([-._]?[0-9]){11,18}$",
    "phone": r"^[+(]?[0-9]([-.()/]*[0-9]){6,14}$",
}
ROUNDS = 2
CONFIDENCE = 0.8
SUPPORT = 5.0  # instances that must back a pattern
_FOUND = "array<struct<start:int,stop:int,value:string>>"


def _matches(text: Column, pattern: str, matches: Column) -> Column:
    """Places (code points, end exclusive) of ``matches``, which are all matches of the pattern:
    they lie between the pieces the text is split into."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))
    pieces = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("p"), matches.alias("m"))

    def step(done: Column, x: Column) -> Column:
        begin = done["at"] + F.length(x["p"])
        stop = begin + F.length(x["m"])
        one = F.struct(begin.alias("start"), stop.alias("stop"), x["m"].alias("value"))
        return F.struct(stop.alias("at"), F.array_append(done["out"], one).alias("out"))

    return F.when(F.size(matches) > 0, F.aggregate(pieces, start, step, lambda d: d["out"])).otherwise(F.array().cast(_FOUND))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (i % 2 + 1))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        # a part is above 255 if it has, zeros aside, more than three digits or is larger
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        small = lambda p: F.coalesce(F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255, F.lit(False))
        return F.forall(F.split(value, r"\."), lambda p: part(p) & small(p))
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_entities(docs: DataFrame) -> DataFrame:
    """Adds to every row its entities by the base expressions, array<struct<kind int (place in
    KINDS), start, stop, value>> ``base`` in the order of kind and start, and ``candidates``,
    array<struct<start, stop, value>> of words with digits and the word before."""
    out = docs
    for kind, pattern in [*BASE.items(), ("candidate", CANDIDATE)]:
        own = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))
        out = out.withColumn(f"m_{kind}", own)

    def entities(i: int, kind: str) -> Column:
        found = F.filter(_matches(F.col("text"), BASE[kind], F.col(f"m_{kind}")), lambda x: _valid(kind, x["value"]))
        return F.transform(found, lambda x: F.struct(F.lit(i).alias("kind"), x["start"], x["stop"], x["value"]))

    spans = [entities(i, kind) for i, kind in enumerate(KINDS)]
    # a card number needs 13 digits in a row but for single spaces and dashes: shorter numbers
    # are matched all the same, to keep the places of the others right
    candidates = _matches(F.col("text"), CANDIDATE, F.col("m_candidate"))
    out = out.withColumn("base", F.concat(*spans)).withColumn("candidates", candidates)
    return out.drop(*[f"m_{k}" for k in (*KINDS, "candidate")])


def _occurrences(found: DataFrame) -> DataFrame:
    """(doc_id, h, left, instance, start, stop, kind): at a base entity's place its whole
    value and kind, else the word and null."""
    rows = found.select("doc_id", "h", "base", F.explode("candidates").alias("c"))
    word = F.regexp_extract(F.col("c.value"), rf"[{_WHITE}]([^{_WHITE}]+)$", 1)
    rows = rows.withColumn("word", word).withColumn("kept", F.regexp_replace("word", r"^[(\[\"']+(?=[^()]*$)|[.,;:!?\"'\])]+$", ""))
    rows = rows.withColumn("at", F.instr("word", F.col("kept")) - 1)
    start = F.col("c.stop") - F.length("word") + F.col("at")
    rows = rows.withColumn("start", start).withColumn("stop", start + F.length("kept"))
    over = F.filter("base", lambda b: (b["start"] < F.col("stop")) & (F.col("start") < b["stop"]))
    left = F.regexp_replace(F.lower(F.regexp_extract(F.col("c.value"), rf"^[^{_WHITE}]+", 0)), r"[.,;!?\"']+$", "")
    return rows.filter(F.col("kept") != "").select(
        "doc_id", "h", left.alias("left"), F.lower(F.when(F.size(over) > 0, over[0]["value"]).otherwise(F.col("kept"))).alias("instance"),
        "start", "stop", F.when(F.size(over) > 0, over[0]["kind"]).alias("kind"),
    )


def learn(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(left, instance, kind) of instances no base expression knows, behind patterns that
    the graph trusts.

    A pattern's confidence for a kind is the mean score of its distinct instances, counted only
    if their scores add up to SUPPORT. An instance scores 1 for the kind it was found as; else,
    if it has that kind's shape, one minus the product of its patterns' doubts.
    """
    known = F.max(F.col("kind")).alias("known")
    edges = materialise(occurrences.groupBy("left", "instance").agg(known))
    sizes = edges.groupBy("left").agg(F.count("*").alias("size"))
    looks = F.array(*[F.when(F.col("instance").rlike(SHAPES[k]), F.lit(i)) for i, k in enumerate(KINDS)])
    seeds = edges.filter(F.col("known").isNotNull()).groupBy("instance").agg(F.max("known").alias("kind")).withColumn("score", F.lit(1.0))
    scores, patterns = seeds, None
    for _ in range(rounds):
        backed = edges.join(scores, "instance").groupBy("left", "kind").agg(F.sum("score").alias("sum"))
        patterns = backed.filter(F.col("sum") >= SUPPORT).join(sizes, "left").withColumn("confidence", F.col("sum") / F.col("size"))
        patterns = materialise(patterns.filter(F.col("confidence") >= CONFIDENCE).select("left", "kind", "confidence"))
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))))
        derived = edges.join(patterns, "left").filter(F.col("known").isNull() & F.array_contains(looks, F.col("kind")))
        derived = derived.groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("score"))
        scores = seeds.unionByName(derived.join(seeds.select("instance"), "instance", "left_anti"))
    trusted = scores.filter(F.col("score") >= CONFIDENCE)
    out = edges.filter(F.col("known").isNull()).join(patterns, "left").join(trusted.select("instance", "kind"), ["instance", "kind"])
    return out.filter(F.array_contains(looks, F.col("kind"))).select("left", "instance", "kind").distinct()


def find_personal(docs: DataFrame) -> DataFrame:
    """Personal data in documents (doc_id, text), null text is empty.

    Returns a row per input row: doc_id, base and spans, both array<struct<kind int, start int,
    stop int>> with kind the place in KINDS, in the order of kind and start; places are code
    points, the end exclusive. ``spans`` holds ``base`` and what the method adds; added ones
    overlap no base entity. Of spans with one start and kind the longer stays. Rows that repeat
    each get theirs; null ids are ids like others. Other columns are not read.
    """
    own = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = materialise(base_entities(own.withColumn("h", F.xxhash64("text"))).select("doc_id", "h", "base", "candidates"))
    occurrences = _occurrences(found)
    new = occurrences.filter(F.col("kind").isNull()).drop("kind").join(learn(occurrences), ["left", "instance"])
    added = new.groupBy("doc_id", "h").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("added"))
    added = added.select(F.col("doc_id").alias("d"), F.col("h").alias("hh"), "added")
    base = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["stop"].alias("stop")))
    out = found.join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh")), "left")
    return out.select("doc_id", "h", base.alias("base"), F.when(F.col("added").isNull(), base).otherwise(
        F.array_sort(F.concat(base, F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,stop:int>>"))))
    ).alias("spans"))


def counted(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of spans that overlap,
    the one that starts first (then the longer) stands for what they cover together."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("last"), s["kind"].alias("kind"))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        fresh = F.concat(done["out"], F.array(gap, F.element_at(names, s["kind"] + 1)))
        return F.struct(
            F.greatest(done["at"], -s["last"]).alias("at"), F.when(s["start"] >= done["at"], fresh).otherwise(done["out"]).alias("out")
        )

    cut = F.aggregate(by_start, first, step, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, cut).otherwise(text)
