"""Problems 3 and 4: orphan references and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import references, shredding
from tallyforge.operators.references import Reference
from tallyforge.plans.registry import Registry
from tallyforge.sources import load

R = Registry()

GRAPH = [
    Reference("corrections", "record_id", "plugins"),
    Reference("corrections", "evidence_ids", "evidence"),
    Reference("corrections", "source_ids", "sources"),
    Reference("sources", "record_ids", "plugins"),
]
#: evidence names plugins too; its own orphans are inherited by corrections but are no rows of p3_found.
FULL_GRAPH = [*GRAPH, Reference("evidence", "record_id", "plugins")]

# Arrays by name, and fields that may hold JSON text.
ARRAYS = ["labels", "assignees", "runs", "files", "findings", "related", "history", "nodes", "edits", "changes"]
PACKED = ["validation", "reactions", "edits", "runs"]


def _cascade(spark: SparkSession, folder: str) -> DataFrame:
    tables = {
        "plugins": (load(spark, folder, "plugins").select("record_id", "loaded_at", "removed_at"), "record_id"),
        "evidence": (load(spark, folder, "evidence").select("evidence_id", "record_id", "loaded_at", "removed_at"), "evidence_id"),
        "sources": (load(spark, folder, "sources").select("source_id", "record_ids", "loaded_at", "removed_at"), "source_id"),
        "corrections": (
            load(spark, folder, "corrections").select("correction_id", "record_id", "evidence_ids", "source_ids", "loaded_at"),
            "correction_id",
        ),
    }
    return references.orphan_cascade(tables, FULL_GRAPH)


_KEY = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"
_LIVES = " union all ".join(
    f"select '{t}' t, {_KEY.format(k)} ref_id, min(loaded_at) arrived, min(removed_at) removed from {t} where {k} is not null group by all"
    for t, k in (("plugins", "record_id"), ("evidence", "evidence_id"), ("sources", "source_id"))
)
_P3_REFS = """
    select 'corrections' child_table, correction_id child_id, 'record_id' field, 'plugins' t, record_id id, loaded_at from corrections
    union all select 'corrections', correction_id, 'evidence_ids', 'evidence', unnest(evidence_ids), loaded_at from corrections
    union all select 'corrections', correction_id, 'source_ids', 'sources', unnest(source_ids), loaded_at from corrections
    union all select 'sources', source_id, 'record_ids', 'plugins', unnest(record_ids), loaded_at from sources"""
_P3_SQL = f"""
with lives as ({_LIVES}),
raw as ({_P3_REFS}),
arrivals as (select child_table, child_id, min(loaded_at) arrived from raw group by all),
refs as (select distinct child_table, child_id, field, t, {_KEY.format('id')} ref_id from raw),
seen as (
    select r.*, a.arrived born,
        case when l.ref_id is null then 'missing' when l.arrived > a.arrived then 'late' when l.removed <= a.arrived then 'deleted' end kind
    from refs r join arrivals a using (child_table, child_id) left join lives l on l.t = r.t and l.ref_id = r.ref_id
    where r.ref_id <> '')
select child_table, child_id, field, ref_id, kind, strftime(born at time zone 'UTC', '%Y-%m') period from seen where kind is not null"""


@R.add(_P3_SQL)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference of corrections and sources without a living target."""
    direct = _cascade(spark, folder).where("depth = 0 and child_table <> 'evidence'")
    return direct.select("child_table", "child_id", "field", "ref_id", "kind", F.date_format("arrived", "yyyy-MM").alias("period")).distinct()


@R.add()
def p3_orphan_report(spark: SparkSession, folder: str) -> DataFrame:
    """Direct and inherited orphan references by table, field and month."""
    return references.orphan_counts(_cascade(spark, folder))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return (
        load(spark, folder, "issues").select(F.lit("issues").alias("src"), F.col("number").alias("row_id"), "raw_json")
        .unionByName(load(spark, folder, "comments").select(F.lit("comments").alias("src"), F.col("id").alias("row_id"), "raw_json"))
        .where("row_id is not null and raw_json is not null")
    )


def _nested(records: DataFrame) -> shredding.Records:
    return shredding.Records(records, "raw_json", ARRAYS, PACKED)


IDS = ["src", "row_id"]


@R.add()
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every object that is an element of an array in raw_json."""
    return shredding.elements(_nested(_records(spark, folder)), IDS).select(*IDS, "path", "idx").distinct()


@R.add()
def p4_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every array element with its parent element."""
    return shredding.elements(_nested(_records(spark, folder)), IDS).distinct()


@R.add()
def p4_children(spark: SparkSession, folder: str) -> DataFrame:
    """All flat tables in one: every array element of issues and comments with its parent and all its values."""
    return shredding.child_values(_nested(_records(spark, folder)), IDS).distinct()


# The kinds of children, with the table, array and fields of each.
KINDS = {
    "labels": ("issues", "labels[]", ["id", "name", "color"]),
    "assignees": ("issues", "assignees[]", ["id", "login", "type"]),
    "issue_reactions": ("issues", "reactions.nodes[]", ["content", "user.id", "user.login", "user.type"]),
    "runs": ("issues", "validation.runs[]", ["run_id", "commit", "result.ok"]),
    "history": ("issues", "validation.runs[].history[]", ["state", "at"]),
    "files": ("issues", "validation.runs[].result.files[]", ["path", "mode", "size"]),
    "findings": ("issues", "validation.runs[].result.files[].findings[]", ["rule_id", "severity", "line", "notes"]),
    "related": ("issues", "validation.runs[].result.files[].findings[].related[]", ["path", "span.from", "span.to"]),
    "comment_reactions": ("comments", "reactions.nodes[]", ["content", "user.id", "user.login", "user.type"]),
    "edits": ("comments", "edits[]", ["edited_at", "editor.id", "editor.login", "editor.type"]),
    "changes": ("comments", "edits[].changes[]", ["field", "size.before", "size.after"]),
}


def _flat(kind: str):
    src, path, fields = KINDS[kind]

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return shredding.child_table(_nested(_records(spark, folder).where(F.col("src") == src)), IDS, path, fields).distinct()

    query.__name__, query.__doc__ = f"p4_{kind}", f"The flat table of {path} of {src}, each row with the place of its parent."
    return query


for _kind in KINDS:
    R.add()(_flat(_kind))
