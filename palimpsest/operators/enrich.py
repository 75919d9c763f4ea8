"""Enrichment of decomposed sentences: people from the context, entity types from evidence, questions by transformation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions import dims
from palimpsest.operators.entities import agreed_type

_THIRD = ["he", "she", "they", "him", "her", "them", "it"]
_GEO = ["city", "town", "village", "street", "road", "river", "lake", "mountain", "island", "beach", "park", "valley", "county", "bay", "harbour", "airport", "station"]
_HEADS = {"ORG": ["company", "university", "school", "bank", "hospital", "team", "club", "inc", "ltd", "corp", "agency", "church"], "EVENT": ["wedding", "party", "festival", "conference", "meeting", "concert", "birthday", "war", "match"], "WORK_OF_ART": ["book", "novel", "song", "movie", "film", "album", "painting"], "PRODUCT": ["phone", "car", "laptop", "computer", "bike", "camera", "app"], "TIME": ["day", "week", "month", "year", "morning", "evening", "night", "summer", "winter"], "PERSON": ["mother", "father", "sister", "brother", "friend", "boss", "manager", "doctor", "teacher", "wife", "husband", "son", "daughter"]}


def with_people(rows: DataFrame, key: str = "user_id", order: str | Column = "turn", look: int = 10, people: Column | None = None) -> DataFrame:
    """A third-person subject becomes the person named last in the user's previous ``look`` sentences; that person and the speaker
    join the entities. ``people``: the names a sentence puts forward, its entities if not given."""
    named = F.coalesce(F.col("entities") if people is None else people, F.array().cast("array<string>"))
    before = F.flatten(F.collect_list(named).over(W.partitionBy(key).orderBy(order).rowsBetween(-look, -1)))
    person = F.try_element_at(before, F.lit(-1))
    third = F.lower("subject").isin(_THIRD)
    out = rows.withColumn("__person", F.when(third, person))
    own = F.array_compact(F.array(F.col("__person"), *([F.col("speaker")] if "speaker" in rows.columns else [])))
    return out.withColumn("entities", F.array_union(F.coalesce("entities", F.array().cast("array<string>")), own)).withColumn("subject", F.coalesce("__person", "subject")).drop("__person")


def people_of() -> Column:
    """The names in a sentence that may be persons: not what it says somebody is in, at, or going to."""
    place = F.coalesce(F.col("predicate").rlike("_(in|at|to|from|near|into|through|against)$"), F.lit(False))
    return F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: ~(place & F.coalesce(F.lower("object").contains(F.lower(e)), F.lit(False))))


def head_type(name: Column) -> Column:
    """The type of the nearest anchor of a name's head, its last word; null if no list has it."""
    head = F.lower(F.element_at(F.split(F.trim(name), r"\s+"), -1))
    out = F.when(head.isin(_GEO), F.lit("LOCATION"))
    for kind, heads in _HEADS.items():
        out = out.when(head.isin(heads), F.lit(kind))
    return out


def typed(names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``names(name)`` with ``entity_type`` and ``type_confidence``: the longest entry of ``gazetteer(entry, label)`` within the name,
    mapped to a type and overridden by a geographic head, against the type of the head."""
    words = F.split(F.lower(F.trim("name")), r"\s+")
    n = F.size(words)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(words, i, j - i + 1), " "))))
    each = names.select("name").distinct().where(F.length(F.trim("name")) > 0).select("name", F.explode(F.array_distinct(spans)).alias("entry"))
    known = gazetteer.select(F.lower("entry").alias("entry"), dims.mapped(F.col("label"), dims.NER_TYPE).alias("label"))
    longest = each.join(known, "entry").groupBy("name").agg(F.max_by("label", F.struct(F.length("entry"), F.col("entry"))).alias("label"))
    found = names.join(longest, "name", "left")
    head = head_type(F.col("name"))
    ner = F.when(F.col("label").isNotNull() & (head == "LOCATION"), F.lit("LOCATION")).otherwise(F.col("label"))
    out = agreed_type(ner, head)
    return found.withColumn("__t", out).withColumn("entity_type", F.col("__t.type")).withColumn("type_confidence", F.col("__t.confidence")).drop("__t", "label")


def transformed_questions(most: int = 8) -> Column:
    """Questions made from a statement's parts: who, what, when, where and yes or no; at most ``most``, none twice."""
    s, p, o = F.col("subject"), F.translate("predicate", "_", " "), F.coalesce("object", F.lit(""))
    verb = F.substring_index(p, " ", 1)
    place = F.col("predicate").rlike("_(in|at|to)$") | F.col("predicate").isin("live", "move", "go", "travel")
    rest = F.trim(F.regexp_replace(p, r"^\S+ ?", ""))
    made = [
        F.when(o != "", F.concat_ws(" ", F.lit("Who"), F.concat(verb, F.lit("s")), F.nullif(rest, F.lit("")), F.concat(o, F.lit("?")))),
        F.when(o != "", F.concat_ws(" ", F.lit("What does"), s, F.concat(p, F.lit("?")))),
        F.when(F.col("temporal_expression").isNotNull(), F.concat_ws(" ", F.lit("When did"), s, F.concat(p, F.lit("?")))),
        F.when(place, F.concat_ws(" ", F.lit("Where does"), s, F.concat(verb, F.lit("?")))),
        F.concat_ws(" ", F.lit("Does"), s, p, F.concat(F.nullif(o, F.lit("")), F.lit("?"))),
    ]
    return F.slice(F.array_distinct(F.array_compact(F.array(*made))), 1, most)


def slots(question: Column) -> Column:
    """What a verified question fills: its kind names the slot of the fact that the answer must come from."""
    from palimpsest.operators.verify import question_type

    kind = question_type(question)
    return F.when(kind == "person", "subject").when(kind.isin("location", "thing", "quantity"), "object").when(kind == "temporal", "time").when(kind.isin("reason", "manner"), "fact").otherwise("truth")
