"""Frozen column mappings as JSON documents: written, read, checked.

A mapping says which source column feeds each target field. Two formats are known: the
field-first one (``fields``: field -> source or null, so that a source may feed several fields, with
the reverse lists and the unfilled fields declared next to it), and the older one-to-one
``mapping``: source -> field. The names of the members are a parameter, since files of other
producers use their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.operators.match import mapping_violations
from ledgerflow.sources.readers import materialise


@dataclass(frozen=True)
class MappingFormat:
    version: str = "column-mapping-v1"
    version_key: str = "format_version"
    fields: str = "fields"
    sources: str = "sources"
    unfilled: str = "unfilled_fields"
    dropped: str = "dropped_sources"
    legacy: str = "mapping"

    def schema(self) -> str:
        lists = "array<string>"
        return (
            f"`{self.version_key}` string, `{self.fields}` map<string,string>, `{self.sources}` map<string,{lists}>, "
            f"`{self.unfilled}` {lists}, `{self.dropped}` {lists}, `{self.legacy}` map<string,string>, _broken string"
        )


STANDARD = MappingFormat()


def _sources(catalogue: DataFrame) -> list[str]:
    """The source columns of a catalogue: as many as the table has columns."""
    return sorted({r[0] for r in catalogue.where("side = 'source'").select("column").collect()})


def encode_mappings(mappings: DataFrame, catalogue: DataFrame, fmt: MappingFormat = STANDARD) -> DataFrame:
    """(mapping_id, document) of mappings (mapping_id, legacy, field, source or NULL).

    ``catalogue`` (side 'field'|'source', column, kind) tells which sources exist: the reverse
    lists name all of them, the dropped ones are those that feed nothing. A field must
    occur once per mapping, in the legacy format a source too."""
    known = F.array(*map(F.lit, _sources(catalogue))).cast("array<string>")
    # a mapping's pairs, as many as it has fields, come together once; the rest is said of that list
    pairs = mappings.where("mapping_id IS NOT NULL").groupBy("mapping_id").agg(
        F.array_sort(F.collect_list(F.struct("field", "source", "legacy"))).alias("_pairs"))
    fed = F.filter("_pairs", lambda p: p["source"].isNotNull())
    own = F.array_distinct(F.transform(fed, lambda p: p["source"]))
    lists = F.transform(
        F.array_sort(F.array_union(known, own)),
        lambda s: F.struct(s.alias("key"), F.transform(F.filter("_pairs", lambda p: p["source"] == s), lambda p: p["field"]).alias("value")))
    rows = pairs.withColumn("_lists", lists).withColumn("legacy", F.explode(F.array_distinct(F.transform("_pairs", lambda p: p["legacy"]))))
    used = F.filter("_lists", lambda e: F.size(e["value"]) > 0)
    legacy = F.map_from_entries(F.transform(used, lambda e: F.struct(e["key"].alias("key"), F.get(e["value"], F.lit(0)).alias("value"))))
    forward = F.map_from_entries(F.transform(F.filter("_pairs", lambda p: ~p["legacy"]), lambda p: F.struct(p["field"].alias("key"), p["source"].alias("value"))))
    new = ~F.col("legacy")
    document = F.to_json(F.struct(
        F.when(new, F.lit(fmt.version)).alias(fmt.version_key), F.when(new, forward).alias(fmt.fields),
        F.when(new, F.map_from_entries("_lists")).alias(fmt.sources), F.when(~new, legacy).alias(fmt.legacy),
        F.transform(F.filter("_lists", lambda e: F.size(e["value"]) == 0), lambda e: e["key"]).alias(fmt.dropped),
        F.transform(F.filter("_pairs", lambda p: p["source"].isNull()), lambda p: p["field"]).alias(fmt.unfilled),
    ))
    return rows.select("mapping_id", document.alias("document"))


@dataclass(frozen=True)
class Decoded:
    """``documents`` (mapping_id, sha256, legacy, problem or NULL), ``mappings`` (mapping_id, legacy,
    field, source or NULL), ``reverse`` (mapping_id, source, field), ``unfilled`` (mapping_id,
    field) and ``catalogued`` (mapping_id, source): the sources that the reverse lists name."""

    documents: DataFrame
    mappings: DataFrame
    reverse: DataFrame
    unfilled: DataFrame
    catalogued: DataFrame


def decode_mappings(documents: DataFrame, fmt: MappingFormat = STANDARD) -> Decoded:
    """Tables of the documents (mapping_id, document). What a document does not declare (always
    so in the legacy format: reverse lists and unfilled fields) is taken from its mapping and so
    can't disagree. Problems: 'malformed' JSON or member types, 'version' unknown, 'no mapping'.
    Documents are read here, once; all tables come of what was read."""
    parsed = F.from_json("document", fmt.schema(), {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
    own = documents.select("mapping_id", F.sha2("document", 256).alias("sha256"), parsed.alias("_d")).select("mapping_id", "sha256", "_d.*")
    forward, back, old = F.col(fmt.fields), F.col(fmt.sources), F.col(fmt.legacy)
    legacy = forward.isNull()
    problem = (
        F.when(F.col("_broken").isNotNull(), "malformed")
        .when(~legacy & ~F.col(fmt.version_key).eqNullSafe(F.lit(fmt.version)), "version")
        .when(F.coalesce(F.size(F.coalesce(forward, old)), F.lit(0)) <= 0, "no mapping")
    )
    facts = materialise(own.select("*", legacy.alias("legacy"), problem.alias("problem")))
    fine = facts.where("problem IS NULL")
    new = fine.where("NOT legacy").select("mapping_id", "legacy", F.explode(forward).alias("field", "source"))
    one = fine.where("legacy").select("mapping_id", "legacy", F.explode(old).alias("source", "field")).select("mapping_id", "legacy", "field", "source")
    mappings = new.unionByName(one)
    declared = fine.where(~F.col("legacy") & back.isNotNull()).select("mapping_id", F.explode(back).alias("source", "_fields"))
    implied = mappings.where("source IS NOT NULL").join(fine.where(F.col("legacy") | back.isNull()).select("mapping_id"), "mapping_id", "left_semi")
    gaps = mappings.where("source IS NULL").join(fine.where(F.col(fmt.unfilled).isNull()).select("mapping_id"), "mapping_id", "left_semi")
    stated = fine.where("NOT legacy").select("mapping_id", F.explode(fmt.unfilled).alias("field"))
    return Decoded(
        facts.select("mapping_id", "sha256", "legacy", "problem"), mappings,
        declared.select("mapping_id", "source", F.explode("_fields").alias("field")).unionByName(implied.select("mapping_id", "source", "field")),
        stated.unionByName(gaps.select("mapping_id", "field")), declared.select("mapping_id", "source"),
    )


def check_documents(documents: DataFrame, catalogue: DataFrame, time_field: str, time_source: str, fmt: MappingFormat = STANDARD) -> DataFrame:
    """Per document its problem and the violation counts of what it says (NULL where it says
    nothing): those of ``mapping_violations``, and ``catalogue_disagreements``, the sources
    that its reverse lists leave out or invent. A valid document has no problem and zeros."""
    return check_decoded(decode_mappings(documents, fmt), catalogue, time_field, time_source)


def check_decoded(d: Decoded, catalogue: DataFrame, time_field: str, time_source: str) -> DataFrame:
    """``check_documents`` of documents that are read already."""
    counts = mapping_violations(d.mappings, d.reverse, d.unfilled, catalogue, time_field, time_source)
    known = F.array(*map(F.lit, _sources(catalogue))).cast("array<string>")
    named = d.catalogued.where("mapping_id IS NOT NULL").groupBy("mapping_id").agg(F.collect_set("source").alias("_named"))
    apart = named.select("mapping_id", (F.size(F.array_except(known, "_named")) + F.size(F.array_except("_named", known))).cast("bigint").alias("_apart"))
    out = d.documents.join(counts, "mapping_id", "left").join(apart, "mapping_id", "left")
    found = F.when(F.col("problem").isNull(), F.coalesce("_apart", F.lit(0).cast("bigint")))
    return out.select(*d.documents.columns, *[c for c in counts.columns if c != "mapping_id"], found.alias("catalogue_disagreements"))


def write_documents(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON file per mapping, below ``mapping_id=...``."""
    rows = documents.select(F.col("document").alias("value"), "mapping_id")
    rows.hint("rebalance", "mapping_id").write.mode(mode).partitionBy("mapping_id").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(mapping_id, document) of files laid out by ``write_documents``; a file may span lines."""
    return spark.read.option("wholetext", True).text(path).select("mapping_id", F.col("value").alias("document"))


def load_mapping(
    documents: DataFrame, mapping_id, catalogue: DataFrame, time_field: str, time_source: str, fmt: MappingFormat = STANDARD
) -> dict[str, str | None]:
    """Field -> source or None of one valid document, for ``apply_mapping``; raises with what is
    wrong otherwise. The driver reads one row per field."""
    one = documents.where(F.col("mapping_id") == F.lit(mapping_id))
    found = check_documents(one, catalogue, time_field, time_source, fmt).collect()
    if len(found) != 1:
        raise ValueError(f"mapping {mapping_id}: {len(found)} documents")
    facts = found[0].asDict()
    wrong = [facts["problem"]] if facts["problem"] else [f"{n} = {v}" for n, v in facts.items() if n.endswith(("s", "fields", "errors")) and isinstance(v, int) and not isinstance(v, bool) and v]
    if wrong:
        raise ValueError(f"mapping {mapping_id}: {', '.join(wrong)}")
    rows = decode_mappings(one, fmt).mappings.select("field", "source").collect()
    return {r["field"]: r["source"] for r in rows}
