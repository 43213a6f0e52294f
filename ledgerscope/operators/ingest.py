"""The knowledge base's ingest: documents to pieces, vectors and postings, each piece once.

A store holds ``chunks``, ``vectors``, ``postings`` and ``reports`` as one set
of tables.  A batch of documents is cut into pieces with ids made of their
contents; pieces that the store has are left out before anything is embedded;
what is new goes into all tables in one commit.  The same batch again, by its
number, is skipped; the same documents under another number add nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions.text import chunk_id, computed, tokens
from ledgerscope.operators import chunking
from ledgerscope.operators.retrieval import term_rows
from ledgerscope.sources import readers
from ledgerscope.sources.shared import discard, materialize, shared_dir
from ledgerscope.sources.tableset import TableSet

TABLES = {
    "chunks": "chunk_id string, url string, position long, context string, chunk string, technology string, category string",
    "vectors": "chunk_id string, embedding array<float>",
    "postings": "chunk_id string, term string, tf long, length long",
    "reports": "run string, batch long, documents long, collected long, different long, skipped long, added long",
}
#: Tasks for each core where contexts are cut into terms, the most work for the fewest bytes.
WAVES = 4
Cut = Callable[[DataFrame], DataFrame]


def store(spark: SparkSession, folder: str) -> TableSet:
    return TableSet(spark, folder, TABLES)


def by_structure(docs: DataFrame) -> DataFrame:
    """Structural chunks of documents (url, title, text, technology, category)."""
    cut = chunking.chunk(docs.select("url", "title", "text", "technology", "category"))
    context = chunking.contextualized(F.col("title"), F.col("heading_path"), F.col("chunk"))
    return cut.select("url", F.col("position").cast("long").alias("position"), context.alias("context"), "chunk", "technology", "category")


def ingest(docs: DataFrame, kept: TableSet, embed: Callable[[list[str]], list], *, cut: Cut = by_structure, writer: str = "job", batch: int | None = None) -> str | None:
    """Take ``docs`` (url, title, text, technology, category) into the store; gives the run's name in ``reports``, or null if this batch is in already.

    Repeated pieces of a batch are one piece, that of the smallest url and
    position.  What the store has is found by its ids alone, of which only
    those of this batch's pieces survive the semi-join.  A context that ends
    with its piece moves as what stands before it.  New pieces are written
    into the store once; vectors and postings are made of what was written,
    and a piece's terms are counted where it is read.
    """
    if batch is not None and kept.done(writer, batch):
        return None
    spark, run = docs.sparkSession, uuid.uuid4().hex
    ends = F.endswith("context", F.col("chunk"))
    before = F.when(ends, F.substring("context", F.lit(1), F.length("context") - F.length("chunk")))
    other = F.when(~F.coalesce(ends, F.lit(False)), F.col("context"))
    cut_up = cut(docs).select("url", F.col("position").cast("long").alias("position"), "chunk", before.alias("before"), other.alias("other"), "technology", "category")
    pieces = materialize(cut_up.withColumn("chunk_id", chunk_id(F.col("url"), F.col("chunk"))), "pieces")
    once = pieces.groupBy("chunk_id").agg(F.min(F.struct("url", "position", "chunk", "before", "other", "technology", "category")).alias("of")).select("chunk_id", "of.*")
    known = materialize(kept.table("chunks").select("chunk_id").join(pieces.select("chunk_id"), "chunk_id", "left_semi").distinct(), "known")
    new = once.join(known, "chunk_id", "left_anti").withColumn("context", F.coalesce(F.concat("before", "chunk"), "other"))

    collected, skipped = pieces.count(), known.count()

    def vectors(done: dict[str, DataFrame]) -> DataFrame:
        discard(pieces)  # the new ones are written
        return readers.provided(done["chunks"].select("chunk_id", "context"), embed, "context", "embedding", "array<float>").select("chunk_id", "embedding")

    def postings(done: dict[str, DataFrame]) -> DataFrame:
        contexts, tasks = done["chunks"].select("chunk_id", "context"), WAVES * spark.sparkContext.defaultParallelism
        if contexts._jdf.rdd().getNumPartitions() < tasks:  # as the files are cut
            contexts = contexts.repartition(tasks, "chunk_id")
        return term_rows(contexts.select("chunk_id", computed(tokens(F.col("context"))).alias("terms")), "chunk_id")

    def report(done: dict[str, DataFrame]) -> DataFrame:
        added = done["chunks"].count()
        return spark.createDataFrame([(run, batch, docs.select("url").distinct().count(), collected, skipped + added, skipped, added)], TABLES["reports"])

    return run if kept.append({"chunks": new, "vectors": vectors, "postings": postings, "reports": report}, writer=writer, batch=batch) else None


def ingest_stream(docs: DataFrame, kept: TableSet, embed: Callable[[list[str]], list], *, cut: Cut = by_structure, checkpoint: str | None = None, name: str | None = None) -> None:
    """Take all that a stream of documents has now into the store, batch by batch, each once whatever is replayed."""
    name = name or f"stream-{uuid.uuid4().hex}"
    where = checkpoint or f"{shared_dir(docs.sparkSession)}/{name}"
    docs.writeStream.option("checkpointLocation", where).trigger(availableNow=True).foreachBatch(lambda rows, number: ingest(rows, kept, embed, cut=cut, writer=name, batch=number)).start().awaitTermination()


def ingest_sources(spark: SparkSession, kept: TableSet, fetch: Callable[[list[str]], list], embed: Callable[[list[str]], list], *, registry: str, cards: str | None = None) -> DataFrame:
    """The whole program: registered pages and cards into the store; one row that tells what came of it.

    A page that the provider ``fetch`` has no text for is a failure in the
    report, not of the job.
    """
    asked = readers.registry(spark, registry).select("url", "title", "technology", "category")
    fetched = materialize(readers.provided(asked, fetch, "url", "text", "string"), "fetched")
    good = fetched.where(F.coalesce(F.trim("text"), F.lit("")) != "")
    own = readers.cards(spark, cards).select("url", "title", F.col("body").alias("text"), "technology", "category") if cards else good.limit(0)
    run = ingest(good.unionByName(own), kept, embed)
    failed = fetched.join(good.select("url"), "url", "left_anti")
    told = good.agg(F.count("*").alias("documents_ok")).crossJoin(failed.agg(F.count("*").alias("documents_failed"), F.sort_array(F.collect_list("url")).alias("failed_urls"))).crossJoin(own.agg(F.count("*").alias("cards_ingested")))
    pieces = kept.table("reports").where(F.col("run") == run).select(F.col("collected").alias("chunks_total"), F.col("different"), F.col("skipped").alias("chunks_skipped"), F.col("added").alias("chunks_new"))
    return told.crossJoin(pieces)  # one row each
