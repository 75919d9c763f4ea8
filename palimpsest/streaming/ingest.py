"""Streaming ingestion: utterances arrive as files or any other stream and become edges, batch by batch."""

from __future__ import annotations

from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest import schemas
from palimpsest.functions import temporal
from palimpsest.functions.embed import question_vectors
from palimpsest.operators import analyze, enrich, grammar, state
from palimpsest.sources.store import EdgeStore


def edges_of(utterances: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The edges of a batch of ``schemas.UTTERANCE`` rows: cleaned, decomposed, gated; ids follow from their content. The speaker is
    among the entities, and so is the person that a third-person subject stands for, who may have been named in the batch or
    in ``before``, earlier utterances of which nothing is stored. The event date is the first known of: the sentence's, its
    temporal expression's, the time of the utterance."""
    kind = analyze.utterance_kind(F.col("said"))
    texts = utterances.withColumn("said", F.col("text")).withColumn("earlier", F.lit(False))
    if before is not None:
        texts = texts.unionByName(before.withColumn("said", F.col("text")).withColumn("earlier", F.lit(True)))
    told = grammar.decomposed(texts)
    rows = enrich.with_people(told.withColumn("spoken", F.col("subject")), "user_id", F.struct(~F.col("earlier"), "ts", "tag", "sentence"), people=enrich.people_of()).where("not earlier").drop("earlier")
    # a pronoun that stands for somebody is none any more
    rows = rows.withColumn("subject_pos", F.when(F.col("subject").eqNullSafe(F.col("spoken")), F.col("subject_pos"))).drop("spoken")
    kept = analyze.mood_gate(rows.withColumn("__kind", kind), F.col("__kind")).where(state.quality_gate(F.col("speaker")))
    kept = state.store_gate(kept)
    text_hash = F.sha2(F.col("source_text").cast("binary"), 256)
    made = kept.withColumn("source_text_hash", text_hash).withColumn("id", F.xxhash64("user_id", "source_text_hash", "ts").bitwiseAND(F.lit((1 << 62) - 1)))
    date = temporal.waterfall(temporal.event_date(F.col("source_text"), F.col("ts")), temporal.resolve_date(F.col("temporal_expression"), F.col("ts"), F.col("source_text")), F.col("ts").cast("timestamp_ntz"))
    made = made.withColumn("resolved_event_date", date)
    # the place of a sentence in its text, from which the store numbers on
    made = made.withColumn("sequence_number", F.col("sentence").cast("long")).withColumn("pqs", question_vectors(analyze.predicted_questions()))
    return made.withColumn("source_timestamp", F.col("ts")).withColumn("source_tag", F.col("tag")).withColumn("created_at", F.col("ts")).withColumn("relational_type", state.relational_type_of("schematic")).withColumn("confidence", F.lit(0.9))


def two_pass(turns: DataFrame) -> DataFrame:
    """A user's text, and the model's response to it with speaker and listener changed over."""
    said = turns.select("user_id", "text", "speaker", "listener", "ts", F.lit("user").alias("tag"))
    answered = turns.where(F.col("model_response").isNotNull()).select("user_id", F.col("model_response").alias("text"), F.col("listener").alias("speaker"), F.col("speaker").alias("listener"), "ts", F.concat(F.lit("llm:"), F.coalesce("llm_id", F.lit("default"))).alias("tag"))
    return said.unionByName(answered)


def read_utterances(spark: SparkSession, folder: str, files_per_batch: int = 10) -> DataFrame:
    """Utterances from a folder of JSON lines; a batch takes so many files at most."""
    return spark.readStream.schema(schemas.UTTERANCE).option("maxFilesPerTrigger", files_per_batch).json(folder)


def start(utterances: DataFrame, store: EdgeStore, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write the edges of each batch to the store; a batch that comes twice is written once. Batches go by the query's id, which its
    checkpoint keeps over restarts: another query on the same store, or one with a new checkpoint, has batches of its own."""
    name: list[str] = []
    begun = Event()

    def write(batch: DataFrame, batch_id: int) -> None:
        begun.wait()
        store.append(edges_of(batch), batch_id, name[0])

    writer = utterances.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if available_now else writer).start()
    name.append(str(query.id))
    begun.set()
    return query


def flush(query: StreamingQuery) -> None:
    """Wait until all that has arrived is written: a read after it sees every write before it."""
    query.processAllAvailable()


def activity(utterances: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Utterances a user and event-time window; what comes later than ``late`` is dropped."""
    stamped = utterances.withColumn("at", F.col("ts").cast("timestamp"))
    watched = stamped.withWatermark("at", late) if utterances.isStreaming else stamped
    return watched.groupBy("user_id", F.window("at", width)).agg(F.count(F.lit(1)).alias("n"))
