"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.corpus import corpus, corpus_tasks
from scriptloom.functions.prompts import TEMPLATES, build_prompt
from scriptloom.functions.text import base_name, title_case
from scriptloom.operators import chat, lineage
from scriptloom.operators.classify import (
    classification_rejects,
    classify_scripts,
    parse_classification,
    usable,
)
from scriptloom.operators.complete import complete
from scriptloom.operators.ingest import (
    apply_translation,
    first_per_key,
    new_scripts,
    registry_rows,
)
from scriptloom.operators.levels import view_levels
from scriptloom.operators.sqlapi import SqlMemo
from scriptloom.operators.stats import object_type_stats, stmt_type_stats
from scriptloom.operators.tasks import answer_task
from scriptloom.operators.translate import (
    TRANSLATORS,
    copy_statements,
    translate_registry,
    trigger_headers,
)
from scriptloom.operators.worklist import worklist
from scriptloom.plans.assistant import answer_pending
from scriptloom.plans.migration import completed_translation, migrate_worklist
from scriptloom.plans.onboarding import onboard
from scriptloom.schema import (
    BATCH_LIMIT,
    CLASS_KEYS,
    KEY,
    PREVIEW_LIMIT,
    WORKLIST_KINDS,
    WORKLIST_LIMITS,
)
from scriptloom.session import work_dir
from scriptloom.sources import stage
from scriptloom.sources.registry import read_inventory, read_registry, registry_insert, write_snapshot
from scriptloom.sources.stage import first_scripts, matches_pattern, tabulate, with_file_name

Query = Callable[[SparkSession, str], DataFrame]

BATCH_TS = datetime(2024, 5, 2, 12, 0, 0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- frames several queries start from ---------------------------------------------


def _scanned(spark: SparkSession, sf_dir: str, variant: str = "plain") -> DataFrame:
    scripts = corpus(spark, sf_dir, variant).where(matches_pattern(F.col("path")))
    return with_file_name(scripts)


def _classified(spark: SparkSession, sf_dir: str, variant: str = "plain") -> DataFrame:
    return classify_scripts(_scanned(spark, sf_dir, variant))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification replies, some of them damaged the way a service would."""
    reply, kind = F.col("response"), F.col("k") % 11
    damaged = (
        F.when(kind == 1, F.concat(reply, F.lit(" as asked")))
        .when(kind == 2, F.regexp_replace(reply, r',"object_name":[^}]*', ""))
        .when(kind == 3, F.concat(reply, F.lit("}")))
        .otherwise(reply)
    )
    return _classified(spark, sf_dir).withColumn("response", damaged)


def _good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable(parse_classification(_replies(spark, sf_dir)))


def _already_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry_rows(_good(spark, sf_dir).where(F.col("k") % 5 == 0))


def _registry(spark: SparkSession, sf_dir: str, variant: str = "plain") -> DataFrame:
    """Every script of the corpus, classified by rules and inserted into an empty registry."""
    parsed = parse_classification(_classified(spark, sf_dir, variant))
    return registry_rows(first_per_key(usable(parsed).drop("k"), determined=CLASS_KEYS))


def _stored_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stored table, for queries that read it more than once."""
    root = work_dir(spark, "registry")
    write_snapshot(_registry(spark, sf_dir), root)
    return read_registry(spark, root)


def _translated(spark: SparkSession, sf_dir: str, kind: str, variant: str) -> DataFrame:
    return TRANSLATORS[kind](worklist(_registry(spark, sf_dir, variant), kind))


# --- scans --------------------------------------------------------------------------


def scan_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).select("path", "load_ts", "md5", "sql_body")


def preview_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_scripts(scan_scripts(spark, sf_dir), PREVIEW_LIMIT)


def batch_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_scripts(scan_scripts(spark, sf_dir), BATCH_LIMIT)


_MARK = b"\xef\xbb\xbf"


def _staged(spark: SparkSession, sf_dir: str) -> str:
    """The corpus as one file per script below a new folder, every third with a byte-order mark."""
    root = work_dir(spark, "stage")

    def write(batches):
        made = set()
        for batch in batches:
            for k, path, body in zip(*[c.to_pylist() for c in batch.columns]):
                fs, name = pafs.FileSystem.from_uri(f"{root}/{path}")
                folder = name.rpartition("/")[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(name) as out:
                    out.write((_MARK if k % 3 == 0 else b"") + body.encode())
            yield batch.select([0]).slice(0, 0)

    # A number that ends in 9 is written under the name of the one before it.
    keys = _table(spark, sf_dir, "part").count()
    scripts = corpus(spark, sf_dir).repartition(corpus_tasks(spark, keys), "path").dropDuplicates(["path"])
    scripts = scripts.select((F.length("sql_body") % 3).alias("k"), "path", "sql_body")
    scripts.mapInArrow(write, "k int").count()
    return root


def _tails(files: DataFrame) -> DataFrame:
    tail = F.regexp_extract("path", "stage/[ab]/[^/]*$", 0).alias("path")
    return files.select(tail, "md5", "sql_body", F.col("load_ts").isNotNull().alias("has_load_ts"))


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same corpus read back from files through the stage source."""
    return _tails(stage.scan_scripts(spark, _staged(spark, sf_dir)))


def scan_files_in_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, listed and read in tasks."""
    return _tails(stage.scan_in_tasks(spark, _staged(spark, sf_dir)))


def onboarded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus onboarded from files: half of the stage, then all of it, then once more."""
    root, registry = _staged(spark, sf_dir), work_dir(spark, "registry")
    opened = []
    for part in ("stage/a", "stage", "stage"):
        counter = spark.sparkContext.accumulator(0)
        onboard(spark, f"{root}/{part}", registry, opened=counter)
        opened.append(counter.value)
    rows = read_registry(spark, registry)
    tail = F.regexp_extract("_stg_sql_file_name", "stage/[ab]/[^/]*$", 0).alias("path")
    return rows.select(
        *KEY, tail, *CLASS_KEYS, *[F.lit(n).cast("long").alias(f"opened_{k}") for k, n in enumerate(opened, 1)]
    )


def preview_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tails(stage.preview_scripts(spark, _staged(spark, sf_dir)))


def batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tails(stage.batch_scripts(spark, _staged(spark, sf_dir)))


def tabulate_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabulate(scan_scripts(spark, sf_dir))


def base_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = corpus(spark, sf_dir)
    return scripts.select("path", base_name(F.col("path")).alias("sql_file_name"))


def load_time_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return events.select("event_id", F.col("ts").cast("string").alias("load_ts"))


def title_cased(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    label = F.concat_ws("_", "p_type", "p_name")
    return part.select("p_partkey", title_case(label).alias("title"))


# --- registry -----------------------------------------------------------------------


def classify(variant: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _classified(spark, sf_dir, variant).select(
            "sql_file_name", "path", "md5", "response"
        )

    return run


def parsed_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_classification(_replies(spark, sf_dir)).select(
        "path",
        "stmt_type",
        "object_type",
        "operation_type",
        "schema_name",
        "object_name",
        "fault",
    )


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classification_rejects(parse_classification(_replies(spark, sf_dir)))


def new_script_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _good(spark, sf_dir)
    return new_scripts(good, _already_loaded(spark, sf_dir)).select(
        "sql_file_name", "md5", "path", "sql_body", "stmt_type", "object_type"
    )


def document_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-if-absent over whole documents: one per source and content."""
    documents = _table(spark, sf_dir, "documents")
    scripts = documents.select(
        F.col("source").alias("sql_file_name"),
        F.md5("text").alias("md5"),
        F.format_string("%s/%012d", "source", "doc_id").alias("path"),
        F.col("text").alias("sql_body"),
        "doc_id",
    )
    loaded = scripts.where(F.col("doc_id") % 5 == 0).select(
        "sql_file_name", F.col("md5").alias("_stg_sql_file_md5")
    )
    return new_scripts(scripts, loaded).select("sql_file_name", "md5", "path", "sql_body")


def inserted_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inserts into a stored registry, the second of what the first left out."""
    root, replied = work_dir(spark, "registry"), work_dir(spark, "replied")
    # Read four times: the text work on it is done once.
    _good(spark, sf_dir).write.parquet(replied)
    good = spark.read.parquet(replied)
    for batch in (good.where(F.col("k") % 5 == 0), good):
        fresh = new_scripts(batch, read_registry(spark, root))
        registry_insert(registry_rows(fresh), root)
    return read_registry(spark, root).drop("updated_ts")


def translated_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All translations of all work lists written back to the registry."""
    registry = _stored_registry(spark, sf_dir)
    updates = None
    for kind, translate in TRANSLATORS.items():
        part = translate(worklist(registry, kind)).select(
            *KEY, "target_sql", "target_object_type", "needs_review"
        )
        updates = part if updates is None else updates.unionByName(part)
    return _translation_report(apply_translation(registry, updates, BATCH_TS))


def translated_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result without work lists: every row translated where it is."""
    return _translation_report(translate_registry(_registry(spark, sf_dir), batch_ts=BATCH_TS))


def _translation_report(registry: DataFrame) -> DataFrame:
    return registry.select(
        *KEY,
        "stmt_type",
        "object_type",
        "target_sql",
        "target_object_type",
        F.col("updated_ts").cast("string").alias("updated_ts"),
        "needs_review",
    )


def translated_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One work list translated and recorded, taken into the next stored version."""
    root = work_dir(spark, "registry")
    write_snapshot(_registry(spark, sf_dir), root)
    migrate_worklist(spark, root, "table", batch_ts=BATCH_TS)
    write_snapshot(read_registry(spark, root), root)
    return read_registry(spark, root).select(
        *KEY, "object_type", "operation_type", "target_sql", "target_object_type", "needs_review"
    )


def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole registry as it is read back from storage."""
    return _stored_registry(spark, sf_dir).select(
        *KEY, "_stg_sql_file_name", "sql_body", "completion_response", *CLASS_KEYS
    )


def object_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return object_type_stats(_registry(spark, sf_dir))


def stmt_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stmt_type_stats(_registry(spark, sf_dir))


def kept_inventory(stats) -> Query:
    """Statistics from the counts of two inserts, translations and a snapshot."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = work_dir(spark, "registry")
        rows = _stored_registry(spark, sf_dir)
        half = F.crc32(F.col("sql_file_name").cast("binary")) % 2
        registry_insert(rows.where(half == 0), root)
        migrate_worklist(spark, root, "table", batch_ts=BATCH_TS)
        write_snapshot(read_registry(spark, root), root)
        registry_insert(rows.where(half == 1), root)
        return stats(read_inventory(spark, root), "n")

    return run


def work(kind: str, limit: int | None = 0) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return worklist(_registry(spark, sf_dir), kind, limit)

    return run


# --- translation and lineage --------------------------------------------------------


def translate(kind: str, variant: str = "plain") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _translated(spark, sf_dir, kind, variant)

    return run


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_statements(_translated(spark, sf_dir, "table", "plain"))


def triggers(variant: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return trigger_headers(worklist(_registry(spark, sf_dir, variant), "trigger"))

    return run


def _views(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    registry = _registry(spark, sf_dir, variant)
    return registry.where((F.col("object_type") == "view") & (F.col("operation_type") == "create"))


def dependencies(variant: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lineage.view_dependencies(_views(spark, sf_dir, variant))

    return run


def dependency_counts(spark: SparkSession, sf_dir: str, variant: str = "plain") -> DataFrame:
    return lineage.view_dependency_counts(_views(spark, sf_dir, variant))


def exported_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependency_counts(spark, sf_dir, "exported")


def levels(variant: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view_levels(_views(spark, sf_dir, variant))

    return run


def complexity(variant: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lineage.script_complexity(_registry(spark, sf_dir, variant))

    return run


def _replied(spark: SparkSession, sf_dir: str, reply: str) -> DataFrame:
    return _scanned(spark, sf_dir).select(
        "sql_file_name", F.col("md5").alias("_stg_sql_file_md5"), F.expr(reply).alias("response")
    )


# Reply texts as expressions that both engines evaluate.
DEPENDENCY_REPLY = (
    "'This depends on' || chr(10) || '1. Table-' || k || chr(10) || '2. View-' || (k % 7) || "
    "case when k % 3 = 0 then chr(10) || ' 3.  dbo.extra ' || chr(10) || 'done' else '' end"
)
SUMMARY_REPLY = (
    "case when k % 5 = 0 then 'No idea' else 'Summary: reads part ' || k || "
    "repeat(' and more', case when k % 4 = 0 then 60 else 1 end) || chr(10) || "
    "'Expected Output: rows' || chr(10) || 'Query Complexity: ' || "
    "case k % 3 when 0 then 'very complex.' when 1 then 'Simple' else 'Hard' end end"
)


def dependency_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.parse_dependency_reply(_replied(spark, sf_dir, DEPENDENCY_REPLY))


def summary_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.parse_summary_reply(_replied(spark, sf_dir, SUMMARY_REPLY))


# --- completion ---------------------------------------------------------------------


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All request texts of every script."""
    scripts = _scanned(spark, sf_dir)
    texts = F.array(
        *[
            F.struct(
                F.lit(task).alias("task"), build_prompt(task, F.col("sql_body")).alias("prompt")
            )
            for task in TEMPLATES
        ]
    )
    return scripts.select("path", F.explode(texts).alias("t")).select("path", "t.task", "t.prompt")


def digest_backend():
    """Stands in for a service: answers with a digest, and refuses some prompts."""
    import hashlib

    def answer(batch):
        digests = [hashlib.md5(prompt.encode()).hexdigest() for prompt in batch]
        if any(d.startswith("f") for d in digests):
            raise RuntimeError("refused")
        return digests

    return answer


def completed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per distinct text over whole documents, answers on every row."""
    documents = _table(spark, sf_dir, "documents")
    rows = documents.select("doc_id", build_prompt("view_summary", F.col("text")).alias("prompt"))
    return complete(rows, digest_backend).select("doc_id", "response", "error")


def completed_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification requests of all scripts, a second run answered by the ledger."""
    ledger = work_dir(spark, "ledger")
    rows = _scanned(spark, sf_dir).select(
        "path", build_prompt("classify", F.col("sql_body")).alias("prompt")
    )
    complete(rows.where(F.col("path").contains("/a/")), digest_backend, ledger)
    return complete(rows, digest_backend, ledger).select("path", "response", "error")


def ruled_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency lists of all views, answered by rules in the form of a service reply."""
    return answer_task(worklist(_registry(spark, sf_dir), "view"), "view_dependency")


def completed_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View translations asked from a service; failed ones are left out."""
    work = worklist(_registry(spark, sf_dir), "view")
    return completed_translation(work, "view", digest_backend)


# --- conversations ------------------------------------------------------------------

SMALL_BUDGET = 300


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations")


def prompt_per_chat(budget: int = chat.BUDGET) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chat.chat_prompt(_history(spark, sf_dir), budget)

    return run


def budget_per_chat(budget: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chat.chat_budget(_history(spark, sf_dir), budget)

    return run


def pending_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_pending(_history(spark, sf_dir))


def appended_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _history(spark, sf_dir)
    replies = chat.chat_pending(history).select(
        "conv_id",
        F.lit("assistant").alias("role"),
        F.concat(F.lit("reply to turn "), F.col("last_turn")).alias("text"),
    )
    return chat.chat_append(history, replies)


def answered_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history after one round of answers to all pending conversations."""
    return answer_pending(_history(spark, sf_dir), digest_backend).history


def seeded_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as conversations to be: those without history get a greeting."""
    ids = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("conv_id"))
    return chat.chat_seed(_history(spark, sf_dir), ids)


# --- SQL text -----------------------------------------------------------------------

SQL_TEXT = (
    "select p_brand, count(*) as n_parts, max(p_size) as max_size from part group by p_brand"
)
COLUMN_TEXT = "select distinct p_name as name from part"


def sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    _table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return SqlMemo(spark).query(SQL_TEXT)


def column_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    _table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return SqlMemo(spark).single_column(COLUMN_TEXT)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "scan_scripts": scan_scripts,
        "preview_scripts": preview_scripts,
        "batch_scripts": batch_scripts,
        "scan_files": scan_files,
        "scan_files_in_tasks": scan_files_in_tasks,
        "onboard_files": onboarded_files,
        "preview_files": preview_files,
        "batch_files": batch_files,
        "tabulate_scripts": tabulate_scripts,
        "base_name": base_names,
        "load_time_text": load_time_text,
        "title_case": title_cased,
        "classify_scripts": classify("plain"),
        "classify_scripts_annotated": classify("annotated"),
        "parse_classification": parsed_classification,
        "classification_rejects": rejects,
        "new_scripts": new_script_keys,
        "new_scripts_documents": document_copies,
        "registry_insert": inserted_registry,
        "registry_scan": stored_rows,
        "apply_translation": translated_registry,
        "apply_translation_snapshot": translated_snapshot,
        "translate_registry": translated_in_place,
        "object_type_stats": object_stats,
        "stmt_type_stats": stmt_stats,
        "object_type_stats_kept": kept_inventory(object_type_stats),
        "stmt_type_stats_kept": kept_inventory(stmt_type_stats),
        "copy_statement": copies,
        "translate_view_nested": translate("view", "nested"),
        "trigger_headers": triggers("plain"),
        "trigger_headers_annotated": triggers("annotated"),
        "trigger_headers_exported": triggers("exported"),
        "view_dependencies_exported": dependencies("exported"),
        "view_dependency_counts_exported": exported_counts,
        "script_complexity_exported": complexity("exported"),
        "view_levels": levels("plain"),
        "view_levels_linked": levels("linked"),
        "view_dependencies": dependencies("plain"),
        "view_dependencies_annotated": dependencies("annotated"),
        "view_dependency_counts": dependency_counts,
        "script_complexity": complexity("plain"),
        "script_complexity_annotated": complexity("annotated"),
        "parse_dependency_reply": dependency_replies,
        "parse_summary_reply": summary_replies,
        "build_prompt": prompts,
        "complete": completed_scripts,
        "complete_documents": completed_documents,
        "complete_translation": completed_views,
        "complete_by_rules": ruled_replies,
        "chat_prompt": prompt_per_chat(),
        "chat_prompt_small_budget": prompt_per_chat(SMALL_BUDGET),
        "chat_budget": budget_per_chat(chat.BUDGET),
        "chat_budget_small": budget_per_chat(SMALL_BUDGET),
        "chat_pending": pending_chats,
        "chat_append": appended_chats,
        "chat_answer": answered_chats,
        "chat_seed": seeded_chats,
        "sql_query": sql_text,
        "single_column": column_text,
    }
    for kind in WORKLIST_KINDS:
        found[f"worklist_{kind}"] = work(kind)
        if WORKLIST_LIMITS[kind]:
            found[f"worklist_{kind}_limit"] = work(kind, WORKLIST_LIMITS[kind])
        found[f"translate_{kind}"] = translate(kind)
        found[f"translate_{kind}_annotated"] = translate(kind, "annotated")
        found[f"translate_{kind}_exported"] = translate(kind, "exported")
    return found


