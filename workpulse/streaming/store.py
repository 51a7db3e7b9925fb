"""The store of reports: facts with their owners, outcomes of documents, runs, and what is derived of each owner.

A batch is staged, then committed. Staging reads and judges its documents and writes the rows with their routes; a preview
and the commit both read what was staged, so they say the same. A commit writes by overwriting what the same batch wrote
before, so a batch that runs again gives the same rows.

Facts lie in cells: owner, month of the work, and the first characters of the fingerprint, which is made of the day among
others. A batch looks its fingerprints up in its own cells only; a small table of cells says which exist. So its work grows
with the batch, not with what is stored. Earlier batches alone are asked, which makes a batch's rows a function of what
came before it.

    facts/owner_user_id=/month=/prefix=/batch=    cells/batch=    rejected/batch=    outcomes/batch=    runs/batch=
    skipped/batch=    messages/batch=    stage/batch=/rows, documents    derived/facts/owner_user_id=    derived/groups/owner_user_id=
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import fingerprint, keyify, short_hash
from ..operators import evidence, parts, repeats, slow
from ..operators.evidence import Masters
from ..operators.ingest import IngestConfig, header_maps, numbered_rows, validated

CELL = ("owner_user_id", "month", "prefix")
#: Cells of a batch whose folders are named one by one; a batch of more reads the table with its cells joined to it.
MOST_CELLS = 10_000
#: Landed files that one micro-batch takes.
FILES = 60

DOCUMENTS_SQL = "owner_user_id int, document_id string, html string, text string, attachment_name string, subject string, sender string, context_text string, received_at timestamp, stated_employee string, stated_date date"
# what parts of messages have beside it
PARTS_SQL = f"{DOCUMENTS_SQL}, message_id string, thread_id string, branch string, place int, content binary, attachment_id string, reason string, detail string"
FACTS_SQL = "task_id string, fingerprint string, document_id string, version string, table_index int, row_index int, task_date date, employee_id string, employee_name string, department string, task string, task_normalized string, task_category string, task_status string, work_kind string, priority string, expected_duration double, actual_duration double, link string, notes string, data_quality_notes string"
CELLS_SQL = "owner_user_id int, month string, prefix string, batch long"
OUTCOMES_SQL = "owner_user_id int, document_id string, version string, received_at timestamp, status string, tables_found long, rows_extracted long, inserted long, skipped long, rejected long, outside long, over_cap long, first_reason string, error string, batch long"
RUNS_SQL = "started_at timestamp, finished_at timestamp, documents long, failed long, rows_extracted long, inserted long, skipped long, rejected long, outside long, over_cap long, batch long"
REJECTED_SQL = "owner_user_id int, document_id string, version string, table_index int, row_index int, reason string, batch long"
SKIPPED_SQL = "owner_user_id int, report_id string, document_id string, table_index int, row_index int, rejection_reason string, rejection_detail string, raw_row string, batch long"
MESSAGES_SQL = "owner_user_id int, message_id string, thread_id string, subject string, sender string, received_at timestamp, parts long, documents long, inserted long, skipped long, rejected long, parts_skipped long, classification string, evidence string, batch long"


@dataclass(frozen=True)
class Store:
    """Where reports are kept, and by which rules they are read."""

    spark: SparkSession
    folder: str
    config: IngestConfig = field(default_factory=IngestConfig)
    masters: Masters = field(default_factory=Masters)
    prefix: int = 1

    # --- files ---------------------------------------------------------------------------------------------------

    def path(self, *parts: str) -> str:
        return "/".join([self.folder.rstrip("/"), *parts])

    def _files(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def exists(self, *parts: str) -> bool:
        files, at = self._files(self.path(*parts))
        return files.exists(at)

    def delete(self, *parts: str) -> None:
        files, at = self._files(self.path(*parts))
        files.delete(at, True)

    def table(self, name: str, schema: str) -> DataFrame:
        """All batches of a table; empty before the first."""
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def facts(self, owner: int | None = None) -> DataFrame:
        rows = self.table("facts", f"{FACTS_SQL}, {CELLS_SQL}")
        return rows if owner is None else rows.where(F.col("owner_user_id") == owner)

    def outcomes(self) -> DataFrame:
        return self.table("outcomes", OUTCOMES_SQL)

    def runs(self) -> DataFrame:
        return self.table("runs", RUNS_SQL)

    def rejected(self) -> DataFrame:
        return self.table("rejected", REJECTED_SQL)

    def skipped(self) -> DataFrame:
        """Parts of messages that became no document, with the reason."""
        return self.table("skipped", SKIPPED_SQL)

    def messages(self) -> DataFrame:
        """What each batch made of each message. Of one that was sent again, the last batch says what it is now."""
        return self.table("messages", MESSAGES_SQL)

    # --- ownership -----------------------------------------------------------------------------------------------

    def known(self, cells: DataFrame, batch: int) -> DataFrame:
        """(owner_user_id, fingerprint, owner_document) that batches before ``batch`` stored in some cells; folders of
        other cells are neither listed nor read."""
        schema = f"{FACTS_SQL}, {CELLS_SQL}"
        names = ["owner_user_id", "fingerprint", F.col("document_id").alias("owner_document")]
        there = self.table("cells", CELLS_SQL).where(F.col("batch") < batch).join(cells.select(*CELL).distinct(), list(CELL), "left_semi")
        found = there.select(*CELL, "batch").limit(MOST_CELLS + 1).collect()
        if not found:
            return self.spark.createDataFrame([], schema).select(*names)
        if len(found) > MOST_CELLS:  # the join's side prunes partitions as the job runs
            return self.facts().join(there, [*CELL, "batch"], "left_semi").select(*names)
        paths = [self.path("facts", *(f"{c}={r[c]}" for c in (*CELL, "batch"))) for r in found]
        return self.spark.read.schema(schema).option("basePath", self.path("facts")).parquet(*paths).select(*names)

    # --- a batch -------------------------------------------------------------------------------------------------

    def stage(self, documents: DataFrame, batch: int, transcripts: DataFrame | None = None) -> None:
        """Reads and judges a batch's documents (of ``DOCUMENTS_SQL`` or ``PARTS_SQL``; columns that are missing are null)
        and writes rows and documents with what is to become of them.

        Parts of messages (``parts.message_parts``) are documents only if they are reports; the others are skipped with a
        reason, and a message has an outcome of its own. ``transcripts``: tables of pictures.

        A document is known by owner and id, its version by its content: the same content again counts once, another
        content is another version, in order of arrival. Rows that an earlier version or batch of the document brought
        are skipped; rows that another document brought are rejected. A document that can't be read fails alone.
        """
        given = [f"{'' if (name := c.split()[0]) in documents.columns else 'cast(null as ' + c.split()[1] + ') as '}{name}" for c in PARTS_SQL.split(", ")]
        docs = documents.selectExpr(*given).where("document_id is not null")
        content = [F.coalesce(F.col(c), F.lit("")) for c in ("html", "text", "attachment_name", "stated_employee")] + [F.coalesce(F.col("stated_date").cast("string"), F.lit(""))]
        content.append(F.sha2("content", 256))  # null for what is no file, which leaves the version as it is
        docs = docs.withColumns({"owner_user_id": F.coalesce("owner_user_id", F.lit(1)), "version": short_hash(F.concat_ws("\u0001", *content), 16)})
        arrival = [F.col("received_at").asc_nulls_last(), F.col("document_id"), F.col("version")]
        first = F.row_number().over(Window.partitionBy("owner_user_id", "document_id", "version").orderBy("received_at"))
        docs = docs.withColumn("nth", first).where("nth = 1").drop("nth")
        docs = docs.withColumn("part_id", F.concat_ws("|", F.col("owner_user_id").cast("string"), "document_id", "version"))
        docs.write.mode("overwrite").parquet(self.path("stage", f"batch={batch}", "documents"))
        docs = self._staged(batch, "documents")

        as_parts = docs.drop("document_id").withColumnRenamed("part_id", "document_id")
        evidence.document_evidence(as_parts.drop("html", "text", "content"), self.masters, self.config).write.mode("overwrite").parquet(self.path("stage", f"batch={batch}", "evidence"))
        parts.part_grids(as_parts, transcripts).write.mode("overwrite").parquet(self.path("stage", f"batch={batch}", "grids"))
        as_parts = self._staged(batch, "evidence")
        grids = self._staged(batch, "grids").where("table_index >= 0")
        header_maps(grids, self.config, as_parts).write.mode("overwrite").parquet(self.path("stage", f"batch={batch}", "maps"))
        parts.judged_parts(as_parts, self._staged(batch, "grids"), self._staged(batch, "maps")).write.mode("overwrite").parquet(self.path("stage", f"batch={batch}", "parts"))
        maps = self._staged(batch, "maps").join(self._staged(batch, "parts").where("is_document").select("document_id"), "document_id", "left_semi")
        rows = evidence.resolved(validated(numbered_rows(grids, self.config, maps=maps), as_parts, self.config), self.masters, as_parts, self.config)
        over = F.col("place") > self.config.max_rows_per_document
        rows = rows.withColumn("outcome", F.when(over, "over_cap").otherwise(F.col("outcome"))).withColumnRenamed("document_id", "part_id")
        # written before anything is filtered by what was worked out, or the filter would work it out again
        rows.drop("raw", "version").write.mode("overwrite").parquet(self.path("stage", f"batch={batch}", "judged"))
        rows = self._staged(batch, "judged").join(docs.select("part_id", "owner_user_id", "document_id", "version", "received_at"), "part_id")

        identity = [F.col("task_date"), keyify(F.col("employee_name")), keyify(F.col("department")), F.col("task_normalized"), F.col("task_status")]
        sound = rows.where("outcome = 'accepted'")
        ordinal = F.row_number().over(Window.partitionBy("part_id", *identity).orderBy("table_index", "row_index"))
        printed = sound.withColumn("fingerprint", fingerprint(*identity, ordinal))
        printed = printed.withColumns({"month": F.date_format("task_date", "yyyy-MM"), "prefix": F.substring("fingerprint", 1, self.prefix)})
        task_id = F.concat(F.lit("TSK-"), F.upper(short_hash(F.concat_ws("|", "document_id", "table_index", "row_index", "task"), 10)))
        printed.withColumn("task_id", task_id).write.mode("overwrite").parquet(self.path("stage", f"batch={batch}", "accepted"))
        printed = self._staged(batch, "accepted")

        turn = F.row_number().over(Window.partitionBy("owner_user_id", "fingerprint").orderBy(*arrival))
        owner = F.first("document_id").over(Window.partitionBy("owner_user_id", "fingerprint").orderBy(*arrival))
        routed = printed.withColumns({"turn": turn, "first_document": owner}).join(self.known(printed, batch), ["owner_user_id", "fingerprint"], "left")
        holder = F.coalesce("owner_document", "first_document")
        fresh = F.col("owner_document").isNull() & (F.col("turn") == 1)
        route = F.when(fresh, "inserted").when(holder == F.col("document_id"), "skipped").otherwise("rejected")
        routed = routed.withColumns({"route": route, "reason": F.when(route == "rejected", "DUPLICATE_ACROSS_DOCUMENTS")})
        others = rows.where("outcome <> 'accepted'").withColumns({"route": F.col("outcome"), "reason": F.when(F.col("outcome") == "rejected", F.col("reject_reason")).when(F.col("outcome") == "outside", F.col("employee_name"))})
        kept = [c.split()[0] for c in FACTS_SQL.split(", ")] + ["owner_user_id", "month", "prefix", "route", "reason"]
        empty = {"task_id": "string", "fingerprint": "string", "month": "string", "prefix": "string"}
        staged = routed.select(*kept).unionByName(others.withColumns({c: F.lit(None).cast(kind) for c, kind in empty.items()}).select(*kept))
        staged.write.mode("overwrite").parquet(self.path("stage", f"batch={batch}", "rows"))

    def _staged(self, batch: int, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path("stage", f"batch={batch}", name))

    def preview(self, batch: int) -> DataFrame:
        """What becomes of each version of each document of a staged batch; the commit writes just this."""
        count = lambda route: F.count_if(F.col("route") == route).cast("long").alias(route)
        of_rows = self._staged(batch, "rows").groupBy("owner_user_id", "document_id", "version").agg(
            F.countDistinct("table_index").alias("tables_found"), F.count("*").alias("rows_extracted"), *(count(r) for r in ("inserted", "skipped", "rejected", "outside", "over_cap")),
            F.min_by("reason", F.when(F.col("route") == "rejected", F.struct("table_index", "row_index"))).alias("first_reason"),
        )
        failed = self._staged(batch, "grids").where("table_index < 0").select(F.col("document_id").alias("part_id"), F.col("source").alias("error"))
        of_parts = self._staged(batch, "parts").where("is_document").select(F.col("document_id").alias("part_id"))
        rows = self._staged(batch, "documents").join(of_parts, "part_id", "left_semi").join(failed, "part_id", "left").join(of_rows, ["owner_user_id", "document_id", "version"], "left")
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("tables_found", "rows_extracted", "inserted", "skipped", "rejected", "outside", "over_cap")}
        rows = rows.withColumns(zero)
        status = F.when(F.col("error").isNotNull(), "FAILED").when(F.col("rejected") + F.col("over_cap") > 0, "PARTIAL").when(F.col("inserted") + F.col("skipped") == 0, "NO_DATA").otherwise("SUCCESS")
        return rows.withColumn("status", status).select(*(c.split()[0] for c in OUTCOMES_SQL.split(", ")[:-1]))

    def message_preview(self, batch: int) -> DataFrame:
        """What becomes of each message of a staged batch; the commit writes just this."""
        of_documents = self.preview(batch).select(F.concat_ws("|", F.col("owner_user_id").cast("string"), "document_id", "version").alias("document_id"), "inserted", "skipped", "rejected")
        return parts.message_rollup(self._staged(batch, "parts"), of_documents).select(*(c.split()[0] for c in MESSAGES_SQL.split(", ")[:-1]))

    def commit(self, batch: int, started: datetime.datetime | None = None) -> None:
        """Writes a staged batch: facts, cells, rejections, outcomes, and last the run with its counters."""
        started = started or datetime.datetime.now(datetime.timezone.utc)
        rows = self._staged(batch, "rows")
        fresh = rows.where("route = 'inserted'")
        if self.exists("cells", f"batch={batch}"):  # what the same batch wrote before it was interrupted
            for r in self.table("cells", CELLS_SQL).where(F.col("batch") == batch).collect():
                self.delete("facts", *(f"{c}={r[c]}" for c in CELL), f"batch={batch}")
        fresh.select(*CELL).distinct().write.mode("overwrite").parquet(self.path("cells", f"batch={batch}"))
        facts = fresh.select(*(c.split()[0] for c in FACTS_SQL.split(", ")), *CELL, F.lit(batch).cast("long").alias("batch"))
        facts.repartition(*CELL).sortWithinPartitions(*CELL, "fingerprint").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*CELL, "batch").parquet(self.path("facts"))
        rejected = rows.where("route = 'rejected'").select(*(c.split()[0] for c in REJECTED_SQL.split(", ")[:-1]))
        rejected.write.mode("overwrite").parquet(self.path("rejected", f"batch={batch}"))
        parts.skipped_parts(self._staged(batch, "parts")).write.mode("overwrite").parquet(self.path("skipped", f"batch={batch}"))
        self.message_preview(batch).write.mode("overwrite").parquet(self.path("messages", f"batch={batch}"))
        counted = Observation(f"outcomes of batch {batch}")
        sums = ("rows_extracted", "inserted", "skipped", "rejected", "outside", "over_cap")
        outcomes = self.preview(batch).observe(counted, F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "FAILED").alias("failed"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums))
        outcomes.write.mode("overwrite").parquet(self.path("outcomes", f"batch={batch}"))
        found = counted.get
        run = (started, datetime.datetime.now(datetime.timezone.utc), *(int(found[c]) for c in ("documents", "failed", *sums)))
        self.spark.createDataFrame([run], RUNS_SQL.removesuffix(", batch long")).coalesce(1).write.mode("overwrite").parquet(self.path("runs", f"batch={batch}"))

    def ingest(self, documents: DataFrame, batch: int, transcripts: DataFrame | None = None) -> None:
        """Stages and commits a batch."""
        started = datetime.datetime.now(datetime.timezone.utc)
        self.stage(documents, batch, transcripts)
        self.commit(batch, started)

    # --- a stream ------------------------------------------------------------------------------------------------

    def landed(self, folder: str, files: int = FILES, schema: str = DOCUMENTS_SQL) -> DataFrame:
        """A stream of documents landed as JSON, ``files`` files a micro-batch, oldest first."""
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)

    def landed_messages(self, folder: str, files: int = FILES) -> DataFrame:
        """A stream of messages landed as JSON, one a line, ``files`` files a micro-batch, oldest first."""
        return self.spark.readStream.option("maxFilesPerTrigger", files).text(folder)

    def stream(self, landed: DataFrame, documents: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> StreamingQuery:
        """Ingests all that has landed in bounded batches, then stops; run again, it goes on behind the last batch.
        ``documents`` makes documents of what landed, such as parts of messages."""
        write = landed.writeStream.foreachBatch(lambda rows, batch: self.ingest(documents(rows), batch))
        return write.option("checkpointLocation", self.path("checkpoint")).trigger(availableNow=True).start()

    # --- what is derived -----------------------------------------------------------------------------------------

    def touched(self, batches: list[int]) -> list[int]:
        """Owners whose facts some batches changed."""
        return sorted(r[0] for r in self.table("cells", CELLS_SQL).where(F.col("batch").isin(*batches)).select("owner_user_id").distinct().collect())

    def rebuild(self, owners: list[int] | None = None) -> None:
        """Flags and groups of repeated work of some owners (all, if none are named). Only their partitions of the facts
        are read, and only theirs of the derived tables written; what is derived depends on no other owner's facts."""
        facts = self.facts()
        if owners is not None:
            facts = facts.where(F.col("owner_user_id").isin(*owners))
        facts = facts.where("work_kind <> 'PLANNED'").drop("batch", "month", "prefix")
        wordings = repeats.merged_wordings(facts, self.config)
        groups = repeats.repeat_groups(facts, self.config, wordings=wordings)
        flagged = repeats.with_repeat_flag(slow.slow_analysis(facts, self.config.slow_task_multiplier, self.config.min_baseline_sample), wordings, groups, self.config)
        for name, rows in (("groups", groups), ("facts", flagged)):
            rows.repartition("owner_user_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("owner_user_id").parquet(self.path("derived", name))
            if owners is not None and self.exists("derived", name):  # an owner whose last rows went has no partition to write
                left = {r[0] for r in self.spark.read.parquet(self.path("derived", name)).select("owner_user_id").distinct().collect()} & set(owners)
                gone = left - {r[0] for r in rows.select("owner_user_id").distinct().collect()}
                for owner in gone:
                    self.delete("derived", name, f"owner_user_id={owner}")

    def derived(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path("derived", name))
