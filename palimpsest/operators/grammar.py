"""Sentences taken apart as Spark plans: a table of tokens, and a cascade of rules over it.

1. Texts are cut into sentences and these into tokens, a row each (``tokens``).
2. Closed-class words and known verbs come from two tables, ``lexicon(word, tag)`` and ``verbs(lemma, sense)``, joined by word
   and by lemma; what neither has is told by its ending, its case and the word before (``tagged``).
3. Runs of tokens become noun groups; a group after a preposition belongs to it. Conjunctions that open a clause with a
   subject of its own cut sentences into clauses (``grouped``).
4. The main clause's first verb is the predicate. The subject is the last free noun group before it; the object is what its
   preposition governs, or the free group after it, the second of two side by side ("gave Alice his guitar"), or else the
   group of the first preposition. Expressions of time are no objects (``attached``).
5. Mood, tense, aspect, voice, feeling and the rest are expressions over the tokens of a sentence (``decomposed``).

Windows and aggregates go by text and sentence, so a sentence is in one task and no more than that. It is a small grammar
of English: words of open classes beyond the tables are guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from palimpsest.functions import dims
from palimpsest.operators import analyze
from palimpsest.sources.durable import Written

NEGATED = r"(?i)n't\b"
TOKEN = r"(?i)n't|'(?:m|re|s|ve|ll|d)\b|\d+(?:[.,:]\d+)*|\p{L}+(?:-\p{L}+)*|[^\p{L}\p{N}\s_]"
TIME = "(?i)" + analyze._TIME.pattern
POSSESSIVE = ("my", "your", "his", "her", "its", "our", "their")
#: Auxiliaries before ``n't`` that have lost a letter.
CUT = {"ca": "can", "wo": "will", "sha": "shall"}
#: Characters of texts whose tokens a task sorts about.
TASK_CHARS = 2_000_000
NOMINAL = ("DET", "ADJ", "NOUN", "PROPN", "NUM", "PRON")


def closed_words() -> list[tuple[str, str]]:
    """Words of closed classes and their tags; of several, the first that is listed."""
    out: dict[str, str] = {}
    groups = [("DET", analyze._DET - {"that"}), ("PRON", analyze._PRON), ("AUX", analyze._AUXES | set(CUT)), ("ADP", analyze._PREP), ("ADV", analyze._ADV), ("CCONJ", ("and", "or", "but")), ("SCONJ", ("because", "if", "when", "while", "that", "although")), ("ADJ", set(analyze._MOODS) - {"love", "hate"})]
    for tag, words in groups:
        for w in sorted(words):
            out.setdefault(w, tag)
    return sorted(out.items())


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(closed_words(), "word string, closed string")


def verbs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(analyze._VERB_SENSE.items()), "lemma string, sense string")


def irregular(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted((analyze._IRREGULAR | CUT).items()), "word string, base string")


#: Stems that have lost an e: of one syllable with a single last consonant (which would be doubled otherwise), or by their ending.
BARE = r"^[^aeiou]*[aeiou][^aeiouwxyhsd]$|([aou]t|[cvzu])$"


def lemma_of(low: Column) -> Column:
    """A word's base form by its ending."""
    n = F.length(low)
    stem = lambda k: F.left(low, n - k)
    twice = lambda s: F.right(s, F.lit(1)) == F.substring(s, -2, 1)
    whole = lambda s: F.when(s.rlike(BARE), F.concat(s, F.lit("e"))).otherwise(s)
    return (
        F.when(low.endswith("ied") & (n > 4), F.concat(stem(3), F.lit("y")))
        .when(low.endswith("ing") & (n > 5), F.when(twice(stem(3)), stem(4)).otherwise(whole(stem(3))))
        .when(low.endswith("ed") & (n > 4) & ~low.endswith("eed"), F.when(twice(stem(2)) & ~F.right(stem(2), F.lit(1)).isin("l", "s"), stem(3)).otherwise(whole(stem(2))))
        .when(low.rlike("(sh|ch|x|z|ss)es$"), stem(2))
        .when(low.endswith("s") & ~low.endswith("ss") & (n > 3), stem(1))
        .otherwise(low)
    )


def sentences(texts: DataFrame) -> DataFrame:
    """``texts(row, said, ..)`` -> ``row, sentence, source_text, ..``: sentences, numbered from 0 in their text."""
    cut = F.filter(F.split(F.regexp_replace(F.trim("said"), r"([.!?])\s+", "$1\n"), r"\n+"), lambda x: F.trim(x) != "")
    more = [c for c in texts.columns if c not in ("row", "said")]
    return texts.select("row", *more, F.posexplode(cut).alias("sentence", "source_text")).withColumn("source_text", F.trim("source_text"))


def tokens(cut: DataFrame) -> DataFrame:
    """``sentences`` -> ``row, sentence, at, word, time, ..``: the tokens of each sentence, numbered from 0. The sentence itself is in none
    of its tokens' rows, but for its expression of time."""
    words = F.regexp_extract_all(F.regexp_replace("source_text", NEGATED, " n't"), F.lit(TOKEN), F.lit(0))
    time = F.lower(F.regexp_extract("source_text", TIME, 0)).alias("time")
    own = [c for c in cut.columns if c != "source_text"]
    return cut.select(*own, time, words.alias("words")).select(*own, "time", F.posexplode("words").alias("at", "word"))


def _sentence() -> WindowSpec:
    return W.partitionBy("row", "sentence")


def _in_order() -> WindowSpec:
    return _sentence().orderBy("at")


def tagged(words: DataFrame, lexicon_: DataFrame, verbs_: DataFrame, irregular_: DataFrame) -> DataFrame:
    """Tokens with ``low, lemma, sense, tag``."""
    rows = words.withColumn("low", F.lower("word"))
    rows = rows.join(lexicon_.withColumnRenamed("word", "low"), "low", "left").join(irregular_.select(F.col("word").alias("low"), "base"), "low", "left")
    rows = rows.withColumn("lemma", F.coalesce("base", lemma_of(F.col("low")))).drop("base").join(verbs_, "lemma", "left")
    # a stem may have lost an e for which its ending does not tell, or none
    again = verbs_.select(F.col("lemma").alias("longer"), F.col("sense").alias("other"))
    rows = rows.withColumn("longer", F.when(F.col("sense").isNull() & (F.col("lemma") != F.col("low")), F.when(F.col("lemma").endswith("e"), F.left("lemma", F.length("lemma") - 1)).otherwise(F.concat("lemma", F.lit("e"))))).join(again, "longer", "left")
    rows = rows.withColumn("lemma", F.when(F.col("other").isNotNull(), F.col("longer")).otherwise(F.col("lemma"))).withColumn("sense", F.coalesce("sense", "other")).drop("longer", "other")
    first = F.substring("word", 1, 1)
    capital = (first == F.upper(first)) & (first != F.lower(first))
    early = (
        F.when(~F.col("word").rlike(r"^['\p{L}\p{N}]"), "PUNCT")
        .when(F.col("closed").isNotNull(), F.col("closed"))
        .when((F.col("low") == "going") & (F.coalesce(F.lead("low").over(_in_order()), F.lit("")) == "to"), "AUX")
        .when(F.col("low").endswith("ly") & (F.length("low") > 4), "ADV")
        .when(F.col("word").rlike(r"^\d"), "NUM")
        .when(capital & ((F.col("at") > 0) | F.col("sense").isNull()), "PROPN")
    )
    rows = rows.withColumn("early", early).withColumn("before", F.coalesce(F.lag("early").over(_in_order()), F.lit("")))
    verb = F.col("early").isNull() & F.col("sense").isNotNull() & (F.col("before") != "DET")
    guess = F.col("early").isNull() & F.col("sense").isNull() & (F.col("before").isin("PRON", "PROPN", "AUX") | (F.col("low").endswith("ed") & (F.col("before") != "DET")))
    rows = rows.withColumn("verb", verb)
    known = F.min(F.when(F.col("verb"), F.col("at"))).over(_sentence())
    guessed = F.min(F.when(guess, F.col("at"))).over(_sentence())
    chosen = F.col("verb") | ((F.col("at") == guessed) & (F.col("at") < F.coalesce(known, F.lit(1 << 30))))
    tag = F.when(F.coalesce(chosen, F.lit(False)), "VERB").when(F.col("early").isNotNull(), F.col("early")).when(F.col("low").rlike("(ful|ous|ive|able|less)$"), "ADJ").otherwise("NOUN")
    return rows.withColumn("tag", tag).drop("closed", "early", "before", "verb")


def grouped(rows: DataFrame) -> DataFrame:
    """Tagged tokens with ``clause``, ``main`` (whether it is the main clause), ``v`` (its verb's place), ``np`` (the noun group) and
    ``governor`` (the preposition before the group)."""
    before, after = F.coalesce(F.lag("tag").over(_in_order()), F.lit("")), F.coalesce(F.lead("tag").over(_in_order()), F.lit(""))
    opens = (F.col("tag") == "SCONJ") | (((F.col("tag") == "CCONJ") | F.col("word").isin(",", ";")) & (after == "PRON"))
    rows = rows.withColumn("opens", opens).withColumn("before", before)
    rows = rows.withColumn("clause", F.sum(F.col("opens").cast("int")).over(_in_order()))
    clause = W.partitionBy("row", "sentence", "clause")
    head = (F.col("tag") == "AUX") & ~F.col("low").isin(*sorted(analyze._NEG))
    rows = rows.withColumn("lower", F.max(F.when(F.col("opens") & (F.col("tag") == "SCONJ"), 1).otherwise(0)).over(clause))
    place = F.coalesce(F.min(F.when(F.col("tag") == "VERB", F.col("at"))).over(clause), F.min(F.when(head, F.col("at"))).over(clause))
    full = F.max(F.when(F.col("tag") == "VERB", 1).otherwise(0)).over(clause)
    rows = rows.withColumn("place", place).withColumn("full", full)
    # main: with a full verb before one without, not subordinate before subordinate, then the first
    order = F.min(F.when(F.col("place").isNotNull(), F.struct(-F.col("full"), "lower", "clause", "place"))).over(_sentence())
    rows = rows.withColumn("m", order).withColumn("v", F.col("m.place")).withColumn("main", F.col("clause") == F.col("m.clause"))
    nominal = F.col("tag").isin(*NOMINAL)
    was = F.coalesce(F.lag("tag").over(_in_order()).isin(*NOMINAL), F.lit(False)) & ~F.col("opens")
    starts = nominal & (~was | F.col("tag").isin("DET", "PRON") | (F.col("before") == "PRON") | ((F.col("before") == "PROPN") & F.col("tag").isin("NOUN", "ADJ", "NUM")))
    rows = rows.withColumn("starts", starts).withColumn("np", F.when(nominal, F.sum(F.col("starts").cast("int")).over(_in_order())))
    governor = F.when(F.col("starts") & (F.col("before") == "ADP"), F.lag("low").over(_in_order()))
    return rows.withColumn("governor", governor).drop("opens", "before", "lower", "place", "full", "m", "starts")


def attached(rows: DataFrame) -> DataFrame:
    """``row, sentence`` with the verb and its subject and object, of grouped tokens that have ``speaker``, ``listener`` and ``time``."""
    who = F.when(F.col("low").isin(*[w for w, p in analyze._PRON.items() if p == "1"]), F.coalesce("speaker", F.lit("user"))).when(F.col("low").isin(*[w for w, p in analyze._PRON.items() if p == "2"]), F.coalesce("listener", F.lit("assistant")))
    said = F.when(F.col("low").isin(*POSSESSIVE) & who.isNotNull(), F.concat(who, F.lit("'s"))).when(who.isNotNull(), who).otherwise(F.col("word"))
    shown = F.when((F.col("tag") == "DET") & ~F.col("low").isin(*POSSESSIVE), F.lit(None)).otherwise(said)
    told = rows.withColumn("shown", shown)
    words = F.sort_array(F.collect_list(F.struct("at", "word", "low", "shown", "tag")))
    nps = told.where("np is not null and main").groupBy("row", "sentence", "np").agg(F.first("v").alias("v"), F.min("at").alias("a"), F.max("at").alias("z"), F.max("governor").alias("governor"), F.first("time").alias("time"), words.alias("w"))
    nps = nps.withColumn("timely", (F.col("time") != "") & F.contains(F.col("time"), F.array_join("w.low", " ")))
    free = F.col("governor").isNull()
    before = F.max(F.when(free & (F.col("z") < F.col("v")), F.struct("a", "w")))
    after = F.sort_array(F.collect_list(F.when((F.col("a") > F.col("v")) & ~F.col("timely"), F.struct("a", "z", "governor", "w"))))
    groups = nps.groupBy("row", "sentence").agg(before.alias("s"), after.alias("after"))
    # what follows the verb but for adverbs: a preposition, or not
    next_ = F.min(F.when(F.col("main") & (F.col("at") > F.col("v")) & (F.col("tag") != "ADV"), F.struct("at", "tag")))
    heads = told.groupBy("row", "sentence").agg(
        F.first("v").alias("v"),
        F.max(F.when(F.col("at") == F.col("v"), F.struct("lemma", "low", "sense", "tag"))).alias("head"),
        next_.alias("next"),
        F.sort_array(F.collect_list(F.struct("at", "low", "tag", "word", "lemma", "main"))).alias("all"),
        F.first("time").alias("time"),
    )
    met = heads.where("v is not null").join(groups, ["row", "sentence"], "left")
    none = F.array().cast("array<struct<a:int,z:int,governor:string,w:array<struct<at:int,word:string,low:string,shown:string,tag:string>>>>")
    met = met.withColumn("after", F.coalesce("after", none))
    loose = F.filter("after", lambda g: g["governor"].isNull())
    bound = F.filter("after", lambda g: g["governor"].isNotNull())
    near = F.when(F.col("next.tag") == "ADP", F.filter("after", lambda g: g["governor"].isNotNull() & (g["a"] == F.col("next.at") + 1)))
    close = F.get(near, F.lit(0))
    two = F.get(loose, F.lit(1))
    first = F.get(loose, F.lit(0))
    direct = F.when(two.isNotNull() & (two["a"] == first["z"] + 1), two).otherwise(first)
    met = met.withColumn("o", F.coalesce(close, direct, F.get(bound, F.lit(0))))
    text = lambda w: F.array_join(F.filter(F.transform(w, lambda x: x["shown"]), lambda x: x.isNotNull()), " ")
    return met.select(
        "row",
        "sentence",
        "head",
        "all",
        "time",
        F.nullif(text(F.col("s.w")), F.lit("")).alias("subject"),
        F.when(F.size("s.w") == 1, F.get("s.w", F.lit(0))["tag"]).alias("subject_pos"),
        F.when(F.size("s.w") == 1, F.get("s.w", F.lit(0))["low"]).alias("subject_low"),
        F.concat_ws("_", F.col("head.lemma"), F.col("o.governor")).alias("predicate"),
        F.coalesce(text(F.col("o.w")), F.lit("")).alias("object"),
        F.coalesce(F.transform(F.filter("o.w", lambda x: x["shown"].isNotNull()), lambda x: x["tag"]), F.array().cast("array<string>")).alias("object_pos"),
    )


def _mapped(values: dict, key: Column, default: Column | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, default)


def decomposed(turns: DataFrame, clean: bool = True, lexicon_: DataFrame | None = None, verbs_: DataFrame | None = None) -> DataFrame:
    """``turns(.., text, speaker, listener?)`` with a row for each sentence that has a verb and the columns of
    ``analyze.DECOMPOSITION``; the turns are written once, with the number that tells them apart."""
    spark = turns.sparkSession
    have = turns if "listener" in turns.columns else turns.withColumn("listener", F.lit(None).cast("string"))
    said = F.coalesce("text", F.lit(""))
    numbered = have.withColumn("row", F.monotonically_increasing_id()).withColumn("said", analyze.stripped(said) if clean else said)
    held = Written(spark).table(numbered, "turns")
    # sentences are dealt out before they are cut into tokens, and all that follows goes by text and sentence: tokens are not shuffled
    size = held.agg(F.sum(F.length("said"))).first()[0] or 0
    tasks = max(1, spark.sparkContext.defaultParallelism, -(-size // TASK_CHARS))
    dealt = lambda *c: sentences(held.select("row", "said", *c)).repartition(tasks, "row", "sentence")
    words = tokens(dealt("speaker", "listener"))
    closed, known = F.broadcast(lexicon(spark)) if lexicon_ is None else lexicon_, F.broadcast(verbs(spark)) if verbs_ is None else verbs_
    rows = grouped(tagged(words, closed, known, F.broadcast(irregular(spark))))
    told_of = dealt(*[c for c in held.columns if c not in ("row", "said", "text", "listener")])
    parts = attached(rows).join(told_of, ["row", "sentence"])
    lows = F.transform("all", lambda x: x["low"])
    line, low = F.array_join(lows, " "), F.lower("source_text")
    aux = F.transform(F.filter("all", lambda x: x["tag"] == "AUX"), lambda x: x["low"])
    acting = F.filter("all", lambda x: x["tag"] == "VERB")
    of = lambda a, *w: F.arrays_overlap(a, F.array(*map(F.lit, w)))
    perfect = of(aux, "have", "has", "had", "'ve")
    going = F.exists(acting, lambda x: x["low"].endswith("ing")) & of(aux, "am", "is", "are", "was", "were", "'m", "'re", "'s", "been")
    ended = F.exists(acting, lambda x: x["low"].endswith("ed") | ((x["lemma"] != x["low"]) & ~x["low"].rlike("(s|ing)$")))
    past = of(aux, "was", "were", "did", "had") | ended
    habit, ahead = line.contains("used to"), line.rlike(r"\b(?:will|shall|wo)\b|'ll\b|\bgoing to\b")
    tense = F.when(habit, "past").when(ahead, "future").when(perfect & ~of(aux, "had"), "present").when(past | perfect, "past").otherwise("present")
    aspect = F.when(habit, "habitual").when(ahead, "simple").when(perfect & going, "perfect_progressive").when(perfect, "perfect").when(going, "progressive").otherwise("simple")
    first = F.get("all", F.lit(0))
    mood = (
        F.when(low.rlike(r"\b(?:if i were|i wish|would that|suggest that|as if)\b"), "subjunctive")
        .when(F.rtrim(low).endswith("?") | (low.rlike(rf"^(?:{analyze._WH})\b") & ~low.contains(",")), "interrogative")
        .when(low.rlike(r"\bif\b|\bunless\b|\b(?:would|could|might)\b"), "conditional")
        .when(((first["tag"] == "VERB") & (first["word"] == first["low"])) | low.rlike(rf"^(?:{analyze._COMMANDS})\b"), "imperative")
        .otherwise("indicative")
    )
    feeling = F.get(F.filter(lows, lambda x: x.isin(*analyze._MOODS)), F.lit(0))
    negated = F.exists(lows, lambda x: x.isin(*sorted(analyze._NEG)))
    valence = _mapped(analyze._MOODS, feeling)
    kin = F.exists(lows, lambda x: x.isin(*sorted(analyze._KIN)))
    sense = F.coalesce("head.sense", F.lit(""))
    named = F.exists("object_pos", lambda x: x == "PROPN")
    base = _mapped(analyze._VERB_CLASS, sense, F.lit("ACTION"))
    verb_class = F.when(low.rlike(r"\babout to\b|\bplan(?:s|ned|ning)? to\b|\bgoing to\b"), "PLANNING").when((base == "LOCATION") & ~named, "EXPERIENCE").otherwise(base)
    after = lambda i: F.coalesce(F.when(F.get("all", i + 1)["tag"] == "DET", F.get("all", i + 2)["word"]), F.get("all", i + 1)["word"])
    places = F.filter(F.transform("all", lambda x, i: F.when(x["tag"] == "ADP", after(i))), lambda x: x.isNotNull())
    capitals = F.transform("all", lambda x: F.when(x["tag"] == "PROPN", x["word"]).otherwise(F.lit("\n")))
    entities = F.array_distinct(F.filter(F.transform(F.split(F.array_join(capitals, " "), "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    subject = F.coalesce("subject", F.coalesce("speaker", F.lit("user")))
    alone = F.when(F.col("subject_low").isin(*[w for w, p in analyze._PRON.items() if p in "12"]), F.lit(None)).otherwise(F.col("subject_pos"))
    passive = low.rlike(r"\b(?:was|were|is|are|been)\b.*\b\w+(?:ed|en)\b by\b")
    made = {
        "sentence": F.col("sentence"), "subject": subject, "predicate": F.col("predicate"), "object": F.col("object"), "source_text": F.col("source_text"), "mood": mood, "tense": tense, "aspect": aspect, "voice": F.when(passive, "passive").otherwise("active"), "negated": negated,
        "emotion": feeling, "valence": F.when(negated, -valence).otherwise(valence), "emotion_target": F.when(feeling.isNotNull(), F.get(places, F.lit(0))), "temporal_expression": F.nullif(F.regexp_extract("source_text", TIME, 0), F.lit("")), "temporal_context": tense, "entities": entities,
        "schematic": F.when(kin, "family").otherwise(_mapped(dims.SUPERSENSE_SCHEMA, sense, F.lit("uncategorized"))), "verb_class": verb_class,
    }
    out = parts.select(*[c for c in have.columns if c not in ("text", "listener")], *[v.alias(k) for k, v in made.items()], "object_pos", alone.alias("subject_pos"))
    told = F.when(((F.col("tense") == "present") & (F.col("aspect") == "simple")) | (F.col("aspect") == "habitual"), "stative").when((F.col("tense") == "past") & (F.col("aspect") == "simple") & (F.col("verb_class") == "ACHIEVEMENT"), "milestone").when((F.col("tense") == "past") & (F.col("verb_class") == "EXPERIENCE"), "notable").otherwise("routine")
    return out.withColumn("significance", told).withColumn("episodic_fact", F.trim(F.concat_ws(" ", "subject", F.translate("predicate", "_", " "), F.nullif(F.col("object"), F.lit("")))))
