"""A record store on shared storage: import, index, search.

Tables under one root: ``documents`` (by source), ``sources``, and the index. The
index is made of parts. A part is written once, under an id of its own: its
``postings`` (by field), its distinct ``terms`` with their counts, its ``shard_stats`` as differences,
and its ``files``, the document files it took up or found gone. A run becomes visible by one last
write, its row in ``runs``, which names the parts that readers put together. So a
run that was lost half-way leaves nothing behind that is ever read.

* New files make a new part, and nothing else is read or written.
* A changed or removed file makes the postings of its older parts dead. Either
  everything is indexed anew, or the dead pairs of file and part are noted, and
  readers leave them out until parts are merged.
* Counts of a part are what it adds, and takes away for dead files: their sum
  over the parts is always the count of what a reader sees.
* Many small parts are merged into larger ones, which drop dead postings.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldloom.catalog import Catalog
from fieldloom.operators import batch, manifest, naming, profile, results, search, sources
from fieldloom.operators.postings import postings
from fieldloom.operators.records import documents as make_documents
from fieldloom.session import shared_dir, written
from fieldloom.sources import json_folder, sinks
from fieldloom.streaming.upkeep import DOCUMENT_SCHEMA, read_document_stream

SOURCE_SCHEMA = (
    "source_table string, file_name string, name string, description string, type string, "
    "documents_imported bigint, imported_at timestamp"
)
POSTING_COLUMNS = ("shard", "term", "doc_id", "source_table", "row_id", "field")
POSTING_SCHEMA = ", ".join(f"{c} string" for c in POSTING_COLUMNS)
TERM_SCHEMA = "shard string, term string, n bigint, field string"
FILE_SCHEMA = "file_name string, size bigint, mtime timestamp, file_id bigint, documents bigint, live boolean"
RUN_SCHEMA = (
    "run bigint, mode string, version bigint, parts array<struct<part:bigint,entries:bigint>>, dead bigint, "
    "files_new bigint, files_reused bigint, documents bigint, entries bigint, stream string, batch bigint, token bigint"
)
IMPORT_SCHEMA = "source_table string"
#: So many parts of one size are merged into one.
FAN = 8
#: Up to so many files of a run are told to the reader by name; more are only joined.
NAMED_FILES = 10_000


def file_path() -> Column:
    """The path of the file a row was read from, as the file listing spells it."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def new_id() -> int:
    return uuid.uuid4().int >> 65


class SupersededError(RuntimeError):
    """Another run was published since this one was staged."""


class RecordStore:
    def __init__(self, spark: SparkSession, root: str, catalog: Catalog) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.catalog = catalog

    # -- tables -----------------------------------------------------------

    def _table(self, name: str, schema: str) -> DataFrame:
        """A table of the store; empty before its first write."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _latest(self, name: str, schema: str) -> tuple[DataFrame, int]:
        """The newest version of a table that is written whole."""
        versions = self._table(name, f"{schema}, v bigint")
        newest = versions.agg(F.max("v")).first()[0]
        number = -1 if newest is None else newest
        return versions.where(F.col("v") == number).drop("v"), number

    @property
    def documents(self) -> DataFrame:
        return self._table("documents", DOCUMENT_SCHEMA)

    @property
    def sources(self) -> DataFrame:
        return self._latest("sources", SOURCE_SCHEMA)[0]

    @property
    def runs(self) -> DataFrame:
        return self._table("runs", RUN_SCHEMA)

    def _last_run(self) -> Row | None:
        """The newest run; should two builders have published one number, the one with the smaller token."""
        return self.runs.orderBy(F.desc("run"), "token").first()

    @property
    def postings(self) -> DataFrame:
        return self._published(self._last_run())

    @property
    def shard_stats(self) -> DataFrame:
        return self._counts(self._last_run())

    @property
    def terms(self) -> DataFrame:
        """Distinct ``field, term``; terms of dead postings may still be among them."""
        return self._parts("terms", TERM_SCHEMA, self._last_run()).select("field", "term").distinct()

    def _parts(self, name: str, schema: str, run: Row | None, only: list[int] | None = None) -> DataFrame:
        """A table of some parts with the column ``part``: all that a run names, or ``only`` these."""
        schema += ", part bigint"
        ids = [p["part"] for p in run["parts"]] if run is not None else []
        ids = ids if only is None else only
        if not ids:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}")
        return reader.parquet(*[f"{self.root}/{name}/part={i}" for i in ids])

    def _published(self, run: Row | None, only: list[int] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """The live postings of a run's parts."""
        found = self._parts("postings", f"{POSTING_SCHEMA}, file_id bigint", run, only)
        if run is not None and run["dead"] is not None:
            found = found.join(self._dead(run), ["file_id", "part"], "left_anti")
        return found.select(*POSTING_COLUMNS, *keep)

    def _dead(self, run: Row | None) -> DataFrame:
        """Pairs of file and part that readers leave out."""
        schema = "file_id bigint, part bigint"
        if run is None or run["dead"] is None:
            return self.spark.createDataFrame([], schema)
        return self._table(f"dead/list={run['dead']}", schema)

    def _counts(self, run: Row | None) -> DataFrame:
        """Postings per field and shard: the sum of what the parts add and take away."""
        counted = self._parts("shard_stats", "field string, shard string, n bigint", run)
        return counted.groupBy("field", "shard").agg(F.sum("n").alias("n")).where("n <> 0")

    def _files(self, run: Row | None) -> DataFrame:
        """The newest word on every file: ``FILE_SCHEMA`` and the part that says it.

        A run names its parts from the oldest to the newest.
        """
        said = self._parts("files", FILE_SCHEMA, run)
        if run is None:
            return said
        order = F.array(*[F.lit(p["part"]) for p in run["parts"]])
        newest = F.max_by(F.struct(*said.columns), F.array_position(order, F.col("part"))).alias("f")
        return said.groupBy("file_name").agg(newest).select("f.*")

    def _manifest(self, run: Row | None) -> DataFrame:
        return self._files(run).where("live").drop("live")

    # -- import -----------------------------------------------------------

    def import_folder(
        self,
        folder: str,
        metadata: DataFrame | None = None,
        default_name: str = "",
        default_description: str = "",
        default_type: str = "",
        max_files: int | None = None,
        max_bytes: int | None = None,
        split_bytes: int | None = None,
    ) -> DataFrame:
        """Import a folder of JSON files; returns the new source rows.

        Line files over ``split_bytes`` (one Spark split) are read by several tasks.
        Files over a caller's limit stop the import before anything is written.
        The names taken are noted first and the source rows written last. So an
        import that was lost half-way can be repeated: it takes the same names,
        and its documents replace what the lost one left under them.
        """
        files = json_folder.list_files(self.spark, folder)
        refused = json_folder.check_limits(files, max_files, max_bytes).first()
        if refused is not None:
            raise ValueError(f"{refused['file_name']}: {refused['reason']}")
        current, version = self._latest("sources", SOURCE_SCHEMA)

        unfinished = self._table("imports", IMPORT_SCHEMA).join(current, "source_table", "left_anti")
        appended = self.documents.select("source_table").distinct().join(unfinished, "source_table", "left_anti")
        taken = current.select("source_table").union(appended)
        named = naming.unique_source_names(files.select("file_name"), taken, ["file_name"], F.ascii("file_name"))
        named = written(named, "names")
        named.select("source_table").write.mode("append").parquet(f"{self.root}/imports")
        records = json_folder.read_records(self.spark, folder, named=named, split_bytes=split_bytes)
        sinks.replace_sources(make_documents(records, self.catalog), f"{self.root}/documents")

        stored = self.documents.join(named.select("source_table"), "source_table", "left_semi")
        counts = stored.groupBy("source_table").agg(
            F.count("*").alias("documents_imported"), F.max("imported_at").alias("imported_at")
        )
        if metadata is None:
            metadata = self.spark.createDataFrame(
                [], "file_name string, name string, description string, type string, priority bigint"
            )
        rows = sources.new_source_rows(named.join(counts, "source_table"), metadata, default_name, default_description, default_type)
        rows = rows.select(*current.columns)
        sources.upsert_sources(current, rows).write.parquet(f"{self.root}/sources/v={version + 1}")
        return self.sources.join(named.select("source_table"), "source_table", "left_semi")

    def append(self, records: DataFrame) -> None:
        """Add raw records ``source_table, seq, raw`` that come from elsewhere."""
        sinks.write_documents(make_documents(records, self.catalog), f"{self.root}/documents")

    # -- index ------------------------------------------------------------

    def document_files(self) -> DataFrame:
        files = self.spark.read.format("binaryFile").options(pathGlobFilter="*.parquet", recursiveFileLookup="true")
        listed = files.load(f"{self.root}/documents")
        return listed.select(
            F.col("path").alias("file_name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")
        )

    def stage_index(self, on_change: str = "full") -> tuple[Row, DataFrame]:
        """Write the part of the next run; returns the run's row and the listing it was made from.

        The folder is listed once. That listing is compared, read and kept, so a file
        that arrives meanwhile is new to the next run. What a changed or removed file
        asks for is ``on_change``: a ``full`` build, or to ``replace`` its postings.
        """
        last = self._last_run()
        listed = written(self.document_files(), "listing")
        diff = written(manifest.manifest_diff(self._manifest(last), listed), "listing-diff")
        plan = manifest.build_mode(diff).first()
        mode = plan["mode"]
        if mode == "full" and last is not None and on_change == "replace":
            mode = "replace"
        if mode == "noop":
            kept = {} if last is None else last.asDict()
            return self._run_row(last, mode, kept.get("parts") or [], kept.get("dead"), plan["unchanged"], 0), listed

        def of(*states: str) -> DataFrame:
            return diff.where(F.col("state").isin(*states)).select("file_name")

        gone = None
        if mode == "replace":
            gone = written(self._manifest(last).join(of("changed", "removed"), "file_name", "left_semi"), "gone-files")
        wanted = of("new", "changed", "unchanged") if mode == "full" else of("new", "changed")
        files = listed.join(wanted, "file_name", "left_semi")
        stored = self.documents.withColumn("_file", file_path())
        if mode != "full":
            # Told by name, files that are left out are not opened; the listing is the driver's anyway.
            names = [r["file_name"] for r in files.select("file_name").limit(NAMED_FILES + 1).collect()]
            if len(names) <= NAMED_FILES:
                stored = stored.where(F.col("_file").isin(names))
        # Also for a full build: files that arrived since the listing are left out.
        stored = stored.join(files.select(F.col("file_name").alias("_file")), "_file", "left_semi")
        reused = 0 if mode == "full" else plan["unchanged"]
        return self._stage(last, mode, stored, files, gone, reused), listed

    def _run_row(
        self, last: Row | None, mode: str, parts: list, dead: int | None, reused: int, new: int,
        documents: int = 0, entries: int = 0, stream: str | None = None, batch_id: int | None = None,
    ) -> Row:
        """The next run's row; what was counted is added to the last run's unless all is new."""
        base = last is not None and mode != "full"
        version = 0 if last is None else last["version"] + (mode == "full")
        documents += last["documents"] if base else 0
        entries += last["entries"] if base else 0
        run = 0 if last is None else last["run"] + 1
        names = [f.split()[0] for f in RUN_SCHEMA.split(", ")]
        values = (run, mode, version, parts, dead, new, reused, documents, entries, stream, batch_id, new_id())
        return Row(**dict(zip(names, values, strict=True)))

    def _stage(
        self, last: Row | None, mode: str, stored: DataFrame, files: DataFrame, gone: DataFrame | None,
        reused: int = 0, stream: str | None = None, batch_id: int | None = None,
    ) -> Row:
        """Write a part of the documents in ``files`` (``stored``, with ``_file``), without those ``gone``."""
        part = new_id()
        taken = stored.withColumn("file_id", F.xxhash64("_file"))
        at = "{}/{}/part={}".format
        sinks.write_postings(postings(taken, self.catalog, ("file_id",)), at(self.root, "postings", part))
        counts = self._write_terms(part)

        per_file = stored.groupBy(F.col("_file").alias("file_name")).agg(F.count("*").alias("documents"))
        said = files.join(per_file, "file_name", "left").select(
            "file_name", "size", "mtime", F.xxhash64("file_name").alias("file_id"), F.coalesce("documents", F.lit(0)).alias("documents"), F.lit(True).alias("live")
        )
        dead, lost = None if mode == "full" or last is None else last["dead"], 0
        if gone is not None:
            # The part that last spoke of a file holds its postings.
            was = self._published(last, keep=("file_id",)).join(gone.select("file_id"), "file_id", "left_semi")
            counts = counts.unionByName(profile.shard_stats(was).withColumn("n", -F.col("n")))
            counts = counts.groupBy("field", "shard").agg(F.sum("n").alias("n")).where("n <> 0")
            dead = new_id()
            pairs = self._dead(last).unionByName(gone.select("file_id", "part")).distinct()
            pairs.write.parquet(f"{self.root}/dead/list={dead}")
            missing = gone.join(files, "file_name", "left_anti")
            said = said.unionByName(missing.select(*said.columns[:-1], F.lit(False).alias("live")))
            lost = gone.agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0]
        counts.write.parquet(at(self.root, "shard_stats", part))
        said.write.parquet(at(self.root, "files", part))
        counted = self._parts("shard_stats", "field string, shard string, n bigint", None, [part])
        entries = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        heard = self._parts("files", FILE_SCHEMA, None, [part]).where("live")
        new, documents = heard.agg(F.count("*"), F.coalesce(F.sum("documents"), F.lit(0))).first()
        before = [] if mode == "full" or last is None else last["parts"]
        parts = [*before, Row(part=part, entries=entries)]
        return self._run_row(last, mode, parts, dead, reused, new, documents - lost, entries, stream, batch_id)

    def _write_terms(self, part: int) -> DataFrame:
        """Write a part's distinct terms, read off its postings; returns its counts per shard."""
        own = self._parts("postings", POSTING_SCHEMA, None, [part])
        terms = own.groupBy("field", "shard", "term").agg(F.count("*").alias("n"))
        terms.write.partitionBy("field").parquet(f"{self.root}/terms/part={part}")
        stored = self._parts("terms", TERM_SCHEMA, None, [part])
        return stored.groupBy("field", "shard").agg(F.sum("n").alias("n"))

    def _write_run(self, row: Row) -> Row:
        """The last write of a run. Its number can be taken only once."""
        done = self.spark.createDataFrame([row], RUN_SCHEMA)
        try:
            done.drop("run").coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/runs/run={row['run']}")
        except AnalysisException as taken:
            if taken.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            raise SupersededError("another run was published since this one was staged") from taken
        winner = self.runs.where(F.col("run") == row["run"]).orderBy("token").first()
        if winner["token"] != row["token"]:
            raise SupersededError("another run was published at the same time")
        return row

    def publish(self, row: Row, listed: DataFrame) -> Row:
        """Make a staged run the one that readers see.

        Refused when a file it was made from has changed or gone since, or when
        another run was published meanwhile. New files do not matter here.
        """
        now = self.document_files().join(listed.select("file_name"), "file_name", "left_semi")
        allowed = manifest.may_promote(listed, now, listed.select("file_name")).first()
        if not allowed["allowed"]:
            raise RuntimeError(f"{allowed['moved']} files changed since the run was staged")
        return self._write_run(row)

    def build_index(self, on_change: str = "full", fan: int = FAN) -> Row:
        """Bring the index up to date; returns the run's row.

        New files alone are indexed and added. A changed or removed file asks for a
        full build, which makes a new version while the old one stays searchable, or
        with ``on_change="replace"`` for the postings of that file only. Parts
        that have become many are merged afterwards.
        """
        row = self.publish(*self.stage_index(on_change))
        self.merge_parts(fan)
        return row

    def merge_parts(self, fan: int = FAN) -> Row | None:
        """Merge the newest parts when ``fan`` or more of them are of one size or smaller.

        Sizes go by powers of ``fan``, so a posting is rewritten a logarithmic number
        of times, and a reader opens at most ``fan - 1`` parts per size. Dead postings
        stay behind. The merged part becomes visible by a run of its own; when another
        run comes first, merging is left to that one's builder.
        """
        merged = None
        while (last := self._last_run()) is not None:
            sizes = [math.ceil(math.log(max(p["entries"], 1), fan)) for p in last["parts"]]
            runs = [next((i for i in reversed(range(len(sizes))) if sizes[i] > size), -1) for size in range(max(sizes, default=0) + 1)]
            begin = next((at + 1 for at in runs if len(sizes) - at - 1 >= fan), None)
            if begin is None:
                break
            try:
                merged = self._write_run(self._merge(last, begin))
            except SupersededError:
                break
        return merged

    def _merge(self, last: Row, begin: int) -> Row:
        """Write the parts from ``begin`` on as one; returns the row of that run."""
        old = [p["part"] for p in last["parts"][begin:]]
        part, at = new_id(), "{}/{}/part={}".format
        moved = self._published(last, old, keep=("file_id",))
        sinks.write_postings(moved, at(self.root, "postings", part))
        self._write_terms(part)
        counted = self._parts("shard_stats", "field string, shard string, n bigint", None, old)
        counted.groupBy("field", "shard").agg(F.sum("n").alias("n")).where("n <> 0").write.parquet(at(self.root, "shard_stats", part))
        # What older parts hold of a file that is gone must stay known as gone.
        said = self._files(last).where(F.col("part").isin(old))
        if begin == 0:
            said = said.where("live")
        said.drop("part").write.parquet(at(self.root, "files", part))
        dead = last["dead"]
        if dead is not None:
            left = written(self._dead(last).where(~F.col("part").isin(old)), "dead")
            dead = None if left.isEmpty() else new_id()
            if dead is not None:
                left.write.parquet(f"{self.root}/dead/list={dead}")
        entries = sum(p["entries"] for p in last["parts"][begin:])
        parts = [*last["parts"][:begin], Row(part=part, entries=entries)]
        return self._run_row(last, "merge", parts, dead, self._manifest(last).count(), 0)

    def index_stream(self, checkpoint: str, max_files: int | None = None, fan: int = FAN) -> StreamingQuery:
        """Index arriving document files; every finished batch can be searched at once.

        Each micro-batch is published as a run, noted under the stream's checkpoint and the
        batch's number: a batch that is replayed after a failure finds itself done and changes
        nothing. Files that another run has indexed are passed over. The file source
        does not notice files that change or vanish; ``build_index`` does.
        """
        arriving = read_document_stream(self.spark, f"{self.root}/documents", max_files)
        file = arriving.withColumn("_file", file_path()).withColumns(
            {"_size": F.col("_metadata.file_size"), "_mtime": F.col("_metadata.file_modification_time")}
        )

        def take(rows: DataFrame, batch_id: int) -> None:
            self.index_batch(rows, checkpoint, batch_id)
            self.merge_parts(fan)

        writer = file.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()

    def index_batch(self, rows: DataFrame, stream: str, batch_id: int) -> Row | None:
        """Publish a micro-batch of documents with ``_file, _size, _mtime`` as a run, unless that was done."""
        done = (F.col("stream") == stream) & (F.col("batch") == batch_id)
        if not self.runs.where(done).isEmpty():
            return None
        last = self._last_run()
        listed = rows.select(F.col("_file").alias("file_name"), F.col("_size").alias("size"), F.col("_mtime").alias("mtime")).distinct()
        known = self._manifest(last).select("file_name")
        reused = known.count()
        files = written(listed.join(known, "file_name", "left_anti"), "batch-files")
        stored = rows.drop("_size", "_mtime").join(files.select(F.col("file_name").alias("_file")), "_file", "left_semi")
        mode = "full" if last is None else "incremental"
        row = self._stage(last, mode, stored, files, None, reused, stream, batch_id)
        return self._write_run(row)

    # -- search -----------------------------------------------------------

    def find(self, query: Mapping[str, str | None], strict: bool = False) -> DataFrame:
        """Ids of the matching documents."""
        last = self._last_run()
        return search.search(self._published(last), query, self.catalog, strict, self._counts(last))

    def search(self, query: Mapping[str, str | None], strict: bool = False) -> DataFrame:
        """Full records of the matching documents: one plan, however many there are."""
        return results.result_records(results.fetch(self.documents.drop("raw"), self.find(query, strict)))

    def search_chunks(self, query: Mapping[str, str | None], chunk_items: int = results.CHUNK_ITEMS) -> Iterator[list[Row]]:
        """Headers and records in order, a chunk at a time."""
        found = written(self.search(query), "results")
        return results.iterate_chunks(results.result_stream(found, self.sources, chunk_items))

    def store_results(self, query: Mapping[str, str | None]) -> str:
        """Write a query's headers and records in order; returns the folder, for ``result_page``."""
        folder = shared_dir(self.spark, "result-stream")
        found = written(self.search(query), "results")
        sinks.write_stream_rows(results.result_stream(found, self.sources), folder)
        return folder

    def result_page(self, folder: str, after: int = -1, items: int = results.CHUNK_ITEMS) -> DataFrame:
        """The items of stored results behind the position of the last one seen."""
        return results.chunk_after(self.spark.read.parquet(folder), after, items)

    def batch_search(self, queries: DataFrame) -> DataFrame:
        """Hits of a table of queries ``query_id, field, value``, each line for itself."""
        return batch.batch_search(self.postings, queries, self.catalog, words=self.terms)

    def batch_and(self, queries: DataFrame) -> DataFrame:
        """Hits of a table of queries, where the lines of one ``query_id`` must all be met."""
        return batch.batch_and(self.postings, queries, self.catalog, words=self.terms)

    def batch_records(self, queries: DataFrame) -> DataFrame:
        """Full records of such queries: one fetch for all of them."""
        return results.batch_records(self.documents.drop("raw"), self.batch_and(queries))

    def list_sources(self) -> DataFrame:
        return sources.catalog_rows(self.sources, [s.name for s in self.catalog.indexed])
