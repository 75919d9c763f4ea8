"""Queries for the dataset pipeline and for the surface rules of text understanding, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import analyze, dataset, grading, grammar
from palimpsest.plans.memory import WITH, values
from palimpsest.plans.registered import query
from palimpsest.sources.fixtures import edges, table

CANDIDATES_SQL = "c AS (SELECT 'c_' || substr(sha256(role || '|' || text), 1, 12) AS candidate_id, text AS source_text_raw, lower(role) AS source_type FROM conversations WHERE length(trim(text)) > 0)"
STARTS = ", ".join("'" + s.replace("'", "''") + "'" for s in dataset.JUNK_STARTS)
PERSON = ", ".join("'" + s.replace("'", "''") + "'" for s in dataset.FIRST_PERSON)
REASON_SQL = CANDIDATES_SQL + f""", r AS (SELECT *, trim(lower(source_text_raw)) AS low FROM c), f AS (SELECT *, CASE WHEN contains(source_type, 'assistant') OR contains(source_type, 'gpt') THEN 'skipped_assistant'
  WHEN len(list_filter(regexp_split_to_array(low, '\\s+'), lambda w: w <> '')) < 5 OR length(low) > 2000 OR len(list_filter([{STARTS}], lambda p: starts_with(low, p))) > 0 THEN 'skipped_junk'
  WHEN NOT contains(source_type, 'persona') AND len(list_filter([{PERSON}], lambda p: contains(lower(source_text_raw), p))) = 0 THEN 'skipped_no_first_person' ELSE 'kept' END AS reason FROM r)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return dataset.imported(table(spark, d, "conversations").select("role", "text"))


@query("WITH " + CANDIDATES_SQL + " SELECT candidate_id, source_type, count(*) AS n FROM c GROUP BY ALL")
def import_candidates(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).groupBy("candidate_id", "source_type").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + REASON_SQL + " SELECT count(*) AS total, count(*) FILTER (reason = 'kept') AS kept, count(*) FILTER (reason = 'skipped_assistant') AS skipped_assistant, count(*) FILTER (reason = 'skipped_junk') AS skipped_junk, count(*) FILTER (reason = 'skipped_no_first_person') AS skipped_no_first_person FROM f")
def prefilter(spark: SparkSession, d: str) -> DataFrame:
    return dataset.prefilter_counts(candidates(spark, d))


@query("WITH " + REASON_SQL + " SELECT reason, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS percent FROM f GROUP BY reason")
def rejection_shares(spark: SparkSession, d: str) -> DataFrame:
    return dataset.reason_shares(candidates(spark, d))


SAID_SQL = """, c AS (SELECT 'c_' || id AS candidate_id, CASE k % 4 WHEN 0 THEN 'I like ' || object WHEN 1 THEN 'do we like ' || object || '?' WHEN 2 THEN 'I''ve seen it and so ' || object ELSE source_text END AS source_text_raw,
  CASE predicate WHEN 'click' THEN 'chat_User' WHEN 'view' THEN 'human' ELSE 'assistant' END AS source_type FROM edges)"""


def said(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in the first person, which the invented words of the tables have none of."""
    k, o = F.col("k") % 4, F.col("object")
    raw = F.when(k == 0, F.concat(F.lit("I like "), o)).when(k == 1, F.concat(F.lit("do we like "), o, F.lit("?"))).when(k == 2, F.concat(F.lit("I've seen it and so "), o)).otherwise(F.col("source_text"))
    kind = F.when(F.col("predicate") == "click", "chat_User").when(F.col("predicate") == "view", "human").otherwise("assistant")
    e = edges(spark, d).select(F.concat(F.lit("c_"), F.col("id")).alias("candidate_id"), raw.alias("source_text_raw"), kind.alias("source_type"))
    return e.unionByName(e)


@query(WITH + SAID_SQL + """, g AS (SELECT DISTINCT candidate_id, source_text_raw FROM c WHERE (contains(lower(source_type), 'user') OR contains(lower(source_type), 'human')) AND NOT contains(source_text_raw, '?')
  AND (len(list_filter([' i ', ' me ', ' my ', ' we ', ' us ', ' our '], lambda p: contains(' ' || lower(source_text_raw) || ' ', p))) > 0 OR len(list_filter([' i''m', ' i''ve', ' i''d', ' i''ll', ' we''re', ' we''ve', ' we''d', ' we''ll'], lambda p: contains(lower(source_text_raw), p))) > 0))
SELECT candidate_id, source_text_raw FROM g ORDER BY candidate_id LIMIT 25""")
def gold_queue(spark: SparkSession, d: str) -> DataFrame:
    return dataset.gold_queue(said(spark, d), 25).select("candidate_id", "source_text_raw")


@query(WITH + "SELECT id, line FROM (SELECT id, CAST(row_number() OVER (ORDER BY id) AS INT) AS line FROM edges) WHERE line BETWEEN 11 AND 40")
def line_slice(spark: SparkSession, d: str) -> DataFrame:
    return dataset.line_range(edges(spark, d).select("id"), 11, 40, "id")


def master(spark: SparkSession, d: str) -> DataFrame:
    """Master rows over the edges: some lack a text, some have a predicate beyond the inventory."""
    fact = F.struct("subject", F.col("predicate").alias("predicate"), F.col("object").alias("object"))
    e = edges(spark, d)
    return e.select(
        F.col("id").cast("string").alias("id"),
        "source_text",
        F.when(F.col("k") % 9 != 0, F.lower("source_text")).alias("clean_text"),
        F.array(fact).alias("facts"),
        F.array(F.struct(F.lit("date").alias("label"), F.coalesce("temporal_expression", F.lit("")).alias("text"))).alias("roles"),
        F.array(F.struct("subject", F.lit("feels").alias("predicate"), F.coalesce("emotion", F.lit("")).alias("object"))).alias("affect"),
    )


INVENTORY = ["click", "view", "purchase"]


@query(WITH + "SELECT CAST(id AS VARCHAR) AS id, array_to_string(list_concat(CASE WHEN k % 9 = 0 THEN ['missing:clean_text'] ELSE [] END, CASE WHEN predicate NOT IN ('click', 'view', 'purchase') THEN ['predicate:' || predicate] ELSE [] END), ',') AS problems FROM edges WHERE k % 9 = 0 OR predicate NOT IN ('click', 'view', 'purchase')")
def validate_master(spark: SparkSession, d: str) -> DataFrame:
    _, bad = dataset.quarantined(master(spark, d), INVENTORY)
    return bad.select("id", F.array_join("problems", ",").alias("problems"))


@query(WITH + ", j AS (SELECT CASE WHEN k % 5 = 0 THEN 'one_' || id ELSE 'key_' || (id // 3) END AS key, id % 3 AS judge, CAST(user_id % 2 AS VARCHAR) AS signature FROM edges), g AS (SELECT key, count(DISTINCT judge) AS judges, list_sort(list(DISTINCT signature)) AS variants FROM j GROUP BY key) SELECT key, judges, CASE WHEN judges = 1 THEN 'single_judge' WHEN len(variants) = 1 THEN 'agreed' ELSE 'disagreement' END AS outcome, array_to_string(variants, ';') AS variants FROM g")
def adjudicate(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("k") % 5 == 0, F.concat(F.lit("one_"), "id")).otherwise(F.concat(F.lit("key_"), F.expr("id div 3")))
    j = edges(spark, d).select(key.alias("key"), (F.col("id") % 3).alias("judge"), (F.col("user_id") % 2).cast("string").alias("signature"))
    return dataset.adjudicated(j).withColumn("variants", F.array_join("variants", ";"))


@query(WITH + """, m AS (SELECT CAST(id AS VARCHAR) AS id, source_text, CASE WHEN k % 9 <> 0 THEN lower(source_text) END AS clean_text, subject || ' | ' || predicate || ' | ' || object AS triplet, 'date | ' || coalesce(temporal_expression, '') AS role, subject || ' | feels | ' || coalesce(emotion, '') AS affect FROM edges)
SELECT id || '_cleanup' AS id, 'cleanup' AS task, source_text AS input, clean_text AS output FROM m UNION ALL SELECT id || '_triplets', 'triplets', clean_text, triplet FROM m UNION ALL SELECT id || '_roles', 'roles', clean_text, role FROM m UNION ALL SELECT id || '_affect', 'affect', clean_text, affect FROM m""")
def derive_tasks(spark: SparkSession, d: str) -> DataFrame:
    return dataset.tasks(master(spark, d))


MARKED = [
    ("I work at #corp now.", "works_at=#corp"),
    ("My boss is karen smith and I live in #.", "manager_name=Karen;lives_in=@"),
    ("I'm a nurse", "occupation=nurse"),
    ("the weather is fine", ""),
    ("I love hiking!", "likes=hiking"),
    ("", ""),
]


@query()
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return dataset.sample(candidates(spark, d), 20, seed=7).select("candidate_id")


def spoken(spark: SparkSession, d: str, frames: list[str], column: str = "said") -> DataFrame:
    """The turns of the conversations, each with a sentence about its length, by turns from ``frames`` (``#`` stands for the length's
    word)."""
    at = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(frames))).cast("int") + 1
    word = F.concat(F.lit("Ann"), F.translate(F.length(F.coalesce("text", F.lit(""))).cast("string"), "0123456789", "abcdefghij"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.replace(F.element_at(F.array(*map(F.lit, frames)), at), F.lit("#"), word).alias(column))


#: The word that stands for ``#``, in SQL.
NAME = "'Ann' || translate(CAST(length(coalesce(text, '')) AS VARCHAR), '0123456789', 'abcdefghij')"


def sql_case(values_: list[str]) -> str:
    """The same choice in SQL."""
    return f"CASE (conv_id * 7 + turn) % {len(values_)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values_)) + " END"


def _text(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


SURFACE = [
    ("What a day for #!", "exclamatory", 4),
    ("You saw #, didn't you?", "tag_question", 5),
    ("Where is #?", "question", 5),
    ("Is he with #", "question", 5),
    ("yeah", "backchannel", 1),
    ("Call #.", "command", 2),
    ("I feel sad about #", "emotion", 3),
    ("She moved to #.", "statement", 4),
    ("It was # who called.", "cleft", 5),
    ("# sold the car!!", "exclamatory", 4),
]


@query("SELECT conv_id, turn, " + sql_case([_text(k) for _, k, _ in SURFACE]) + " AS kind, CAST(" + sql_case([str(c) for _, _, c in SURFACE]) + " AS INT) AS class FROM conversations")
def utterance_surface(spark: SparkSession, d: str) -> DataFrame:
    kind = analyze.utterance_kind(F.col("said"))
    return spoken(spark, d, [f for f, _, _ in SURFACE]).select("conv_id", "turn", kind.alias("kind"), analyze.utterance_class(kind).alias("class"))


ASKED = [
    ("When did # move?", "when", "temporal"),
    ("How long did # stay?", "how", "temporal"),
    ("How did # feel?", "how", "emotional"),
    ("Whose car did # take?", "whose", "relational"),
    ("Who saw #?", "who", "relational"),
    ("Where is #?", "where", "episodic"),
    ("Did # go?", None, "episodic"),
    ("How happy is #?", "how", "emotional"),
    ("What does # want?", "what", "episodic"),
]


@query("SELECT conv_id, turn, " + sql_case([_text(w) for _, w, _ in ASKED]) + " AS wh, " + sql_case([_text(r) for _, _, r in ASKED]) + f" AS return_field, {NAME} AS entity FROM conversations")
def wh_surface(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("said")
    return spoken(spark, d, [f for f, _, _ in ASKED]).select("conv_id", "turn", analyze.wh_word(q).alias("wh"), analyze.return_field(q).alias("return_field"), analyze.query_entity(q).alias("entity"))


PARSED = [
    ("Where did # move to?", "#", "move", "experience", None),
    ("What did my sister buy?", "sister", "buy", "family", None),
    ("When did I buy the car?", "user", "buy", "finance", "car"),
    ("Who won the race?", None, "win", "hobby", "race"),
    ("What does # study?", "#", "study", "education", None),
    ("Why does # cry?", "#", "cry", "health", None),
]


@query("SELECT conv_id, turn, " + ", ".join(f"{sql_case([_text(r[k]) if r[k] != '#' else NAME for r in PARSED])} AS {c}" for k, c in ((1, "subject"), (2, "predicate"), (3, "match_schema"), (4, "object"))) + " FROM conversations")
def question_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = spoken(spark, d, [r[0] for r in PARSED]).withColumn("p", analyze.parsed_question(F.col("said")))
    return rows.select("conv_id", "turn", "p.subject", "p.predicate", "p.match_schema", "p.object")


@query(WITH + "SELECT id, array_to_string(list_filter([CASE WHEN object <> '' THEN 'What did ' || subject || ' ' || predicate || '?' END, 'What do we know about ' || subject || '?', CASE WHEN emotion IS NOT NULL THEN 'How does ' || subject || ' feel about ' || object || '?' END, CASE WHEN temporal_expression IS NOT NULL THEN 'When did ' || subject || ' ' || predicate || '?' END, 'What about ' || object || '?'], lambda x: x IS NOT NULL)[1:4], '|') AS questions FROM edges")
def pq_templates(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("id", F.array_join(analyze.predicted_questions(), "|").alias("questions"))


def _listed(words) -> str:
    return ", ".join(_text(w) for w in sorted(words))


def _rows(pairs) -> str:
    return ", ".join(f"({_text(a)}, {_text(b)})" for a, b in sorted(pairs))


def _person(which: str) -> str:
    return _listed(w for w, p in analyze._PRON.items() if p == which)


def _stem(k: int) -> str:
    return f"left(low, length(low) - {k})"


def _twice(stem: str) -> str:
    return f"right({stem}, 1) = substr({stem}, length({stem}) - 1, 1)"


def _whole(stem: str) -> str:
    return f"CASE WHEN regexp_matches({stem}, '{grammar.BARE}') THEN {stem} || 'e' ELSE {stem} END"


LEMMA_SQL = f"""CASE WHEN low LIKE '%ied' AND length(low) > 4 THEN {_stem(3)} || 'y'
  WHEN low LIKE '%ing' AND length(low) > 5 THEN CASE WHEN {_twice(_stem(3))} THEN {_stem(4)} ELSE {_whole(_stem(3))} END
  WHEN low LIKE '%ed' AND length(low) > 4 AND low NOT LIKE '%eed' THEN CASE WHEN {_twice(_stem(2))} AND right({_stem(2)}, 1) NOT IN ('l', 's') THEN {_stem(3)} ELSE {_whole(_stem(2))} END
  WHEN regexp_matches(low, '(sh|ch|x|z|ss)es$') THEN {_stem(2)} WHEN low LIKE '%s' AND low NOT LIKE '%ss' AND length(low) > 3 THEN {_stem(1)} ELSE low END"""
_NOMINAL = _listed(grammar.NOMINAL)
_OWN = f"CASE WHEN low IN ({_listed(grammar.POSSESSIVE)}) THEN '''s' ELSE '' END"
DECOMPOSE_SQL = rf"""WITH lex(low, closed) AS (VALUES {_rows(grammar.closed_words())}), vb(lemma, sense) AS (VALUES {_rows(analyze._VERB_SENSE.items())}), irr(low, base) AS (VALUES {_rows((analyze._IRREGULAR | grammar.CUT).items())}),
c AS (SELECT row_number() OVER () AS row, conv_id, turn, role, coalesce(text, '') AS said FROM conversations),
b AS (SELECT *, list_filter(string_split_regex(regexp_replace(trim(said), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x) <> '') AS ss FROM c),
s AS (SELECT row, conv_id, turn, role, unnest(range(len(ss))) AS sentence, trim(unnest(ss)) AS source_text FROM b),
w AS (SELECT *, regexp_extract_all(regexp_replace(source_text, '{grammar.NEGATED.replace("'", "''")}', ' n''t', 'g'), '{grammar.TOKEN.replace("'", "''")}') AS ws FROM s),
t AS (SELECT * EXCLUDE (ws), unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM w), l AS (SELECT *, lower(word) AS low FROM t),
m0 AS (SELECT *, {LEMMA_SQL} AS cut FROM l), m AS (SELECT m0.*, closed, coalesce(base, cut) AS stem FROM m0 LEFT JOIN lex ON lex.low = m0.low LEFT JOIN irr ON irr.low = m0.low),
n AS (SELECT m.*, coalesce(x.sense, y.sense) AS sense, CASE WHEN y.sense IS NOT NULL THEN y.lemma ELSE stem END AS lemma FROM m LEFT JOIN vb x ON x.lemma = stem
  LEFT JOIN vb y ON x.sense IS NULL AND stem <> m.low AND y.lemma = CASE WHEN stem LIKE '%e' THEN left(stem, length(stem) - 1) ELSE stem || 'e' END),
e AS (SELECT *, CASE WHEN NOT regexp_matches(word, '^[''\p{{L}}\p{{N}}]') THEN 'PUNCT' WHEN closed IS NOT NULL THEN closed WHEN low = 'going' AND coalesce(lead(low) OVER o, '') = 'to' THEN 'AUX' WHEN low LIKE '%ly' AND length(low) > 4 THEN 'ADV' WHEN regexp_matches(word, '^\d') THEN 'NUM'
  WHEN left(word, 1) = upper(left(word, 1)) AND left(word, 1) <> lower(left(word, 1)) AND (pos > 0 OR sense IS NULL) THEN 'PROPN' END AS early FROM n WINDOW o AS (PARTITION BY row, sentence ORDER BY pos)),
f AS (SELECT *, coalesce(lag(early) OVER (PARTITION BY row, sentence ORDER BY pos), '') AS before FROM e),
g AS (SELECT *, early IS NULL AND sense IS NOT NULL AND before <> 'DET' AS verb, early IS NULL AND sense IS NULL AND (before IN ('PRON', 'PROPN', 'AUX') OR (low LIKE '%ed' AND before <> 'DET')) AS guess FROM f),
h AS (SELECT *, min(CASE WHEN verb THEN pos END) OVER q AS known, min(CASE WHEN guess THEN pos END) OVER q AS guessed FROM g WINDOW q AS (PARTITION BY row, sentence)),
i AS (SELECT * EXCLUDE (before), CASE WHEN verb OR coalesce(pos = guessed AND pos < coalesce(known, 1000000), FALSE) THEN 'VERB' WHEN early IS NOT NULL THEN early WHEN regexp_matches(low, '(ful|ous|ive|able|less)$') THEN 'ADJ' ELSE 'NOUN' END AS tag FROM h),
j AS (SELECT *, coalesce(lag(tag) OVER o, '') AS before, lag(low) OVER o AS low_before, tag = 'SCONJ' OR ((tag = 'CCONJ' OR word IN (',', ';')) AND coalesce(lead(tag) OVER o, '') = 'PRON') AS opens FROM i WINDOW o AS (PARTITION BY row, sentence ORDER BY pos)),
k AS (SELECT *, sum(opens::INT) OVER (PARTITION BY row, sentence ORDER BY pos) AS clause FROM j),
a AS (SELECT row, sentence, clause, max(CASE WHEN tag = 'VERB' THEN 1 ELSE 0 END) AS full_verb, max(CASE WHEN opens AND tag = 'SCONJ' THEN 1 ELSE 0 END) AS lower_,
  coalesce(min(CASE WHEN tag = 'VERB' THEN pos END), min(CASE WHEN tag = 'AUX' AND low NOT IN ({_listed(analyze._NEG)}) THEN pos END)) AS place FROM k GROUP BY row, sentence, clause),
d AS (SELECT row, sentence, arg_min(clause, (-full_verb, lower_, clause)) AS main_clause, arg_min(place, (-full_verb, lower_, clause)) AS v FROM a WHERE place IS NOT NULL GROUP BY row, sentence),
p AS (SELECT k.*, v, clause = main_clause AS main, tag IN ({_NOMINAL}) AS nominal,
  tag IN ({_NOMINAL}) AND (NOT (before IN ({_NOMINAL}) AND NOT opens) OR tag IN ('DET', 'PRON') OR before = 'PRON' OR (before = 'PROPN' AND tag IN ('NOUN', 'ADJ', 'NUM'))) AS starts FROM k JOIN d USING (row, sentence)),
r AS (SELECT *, CASE WHEN nominal THEN sum(starts::INT) OVER (PARTITION BY row, sentence ORDER BY pos) END AS np, CASE WHEN starts AND before = 'ADP' THEN low_before END AS governor,
  CASE WHEN tag = 'DET' AND low NOT IN ({_listed(grammar.POSSESSIVE)}) THEN NULL WHEN low IN ({_person("1")}) THEN coalesce(role, 'user') || {_OWN} WHEN low IN ({_person("2")}) THEN 'assistant' || {_OWN} ELSE word END AS shown,
  lower(regexp_extract(source_text, '{grammar.TIME}', 0)) AS time FROM p),
u AS (SELECT row, sentence, np, any_value(v) AS v, min(pos) AS a, max(pos) AS z, max(governor) AS governor, coalesce(string_agg(shown, ' ' ORDER BY pos), '') AS said, any_value(time) <> '' AND contains(any_value(time), string_agg(low, ' ' ORDER BY pos)) AS timely FROM r WHERE np IS NOT NULL AND main GROUP BY row, sentence, np),
x AS (SELECT row, sentence, arg_max(said, a) FILTER (governor IS NULL AND z < v) AS subject FROM u GROUP BY row, sentence),
y AS (SELECT row, sentence, any_value(source_text) AS source_text, max(CASE WHEN pos = v THEN lemma END) AS lemma, min(pos) FILTER (main AND pos > v AND tag <> 'ADV') AS next_at, arg_min(tag, pos) FILTER (main AND pos > v AND tag <> 'ADV') AS next_tag, bool_or(low IN ({_listed(analyze._NEG)})) AS negated,
  list_filter(list_transform(string_split(string_agg(CASE WHEN tag = 'PROPN' THEN word ELSE chr(10) END, ' ' ORDER BY pos), chr(10)), lambda q: trim(q)), lambda q: q <> '') AS names FROM r GROUP BY row, sentence),
o AS (SELECT u.*, next_at, next_tag, row_number() OVER q AS nth, lag(z) OVER q AS z_before FROM u JOIN y USING (row, sentence) WHERE a > u.v AND NOT timely WINDOW q AS (PARTITION BY u.row, u.sentence, governor IS NULL ORDER BY a)),
best AS (SELECT row, sentence, arg_min(said, (pick, a)) AS object, arg_min(coalesce(governor, ''), (pick, a)) AS governor FROM (SELECT *, CASE WHEN next_tag = 'ADP' AND governor IS NOT NULL AND a = next_at + 1 THEN 0 WHEN governor IS NULL AND nth = 2 AND a = z_before + 1 THEN 1
  WHEN governor IS NULL AND nth = 1 THEN 2 WHEN governor IS NOT NULL AND nth = 1 THEN 3 ELSE 9 END AS pick FROM o) WHERE pick < 9 GROUP BY row, sentence)
SELECT c.conv_id, c.turn, CAST(y.sentence AS INT) AS sentence, coalesce(nullif(x.subject, ''), c.role, 'user') AS subject, y.lemma || CASE WHEN coalesce(best.governor, '') <> '' THEN '_' || best.governor ELSE '' END AS predicate, coalesce(best.object, '') AS object,
  y.negated, nullif(regexp_extract(y.source_text, '{grammar.TIME}', 0), '') AS temporal_expression, array_to_string(list_filter(y.names, lambda q, i: list_position(y.names, q) = i), '|') AS entities
FROM y JOIN c USING (row) LEFT JOIN x USING (row, sentence) LEFT JOIN best USING (row, sentence)"""


@query(DECOMPOSE_SQL)
def decompose(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of the conversations, cut into sentences and taken apart."""
    parts = grammar.decomposed(table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), "text"), clean=False)
    return parts.select("conv_id", "turn", "sentence", "subject", "predicate", "object", "negated", "temporal_expression", F.array_join("entities", "|").alias("entities"))


@query(f"SELECT conv_id, turn, replace(replace({sql_case([_text(f) for _, f in MARKED])}, '#', {NAME}), '@', lower({NAME})) AS facts FROM conversations")
def marker_facts(spark: SparkSession, d: str) -> DataFrame:
    facts = F.transform(dataset.marked_facts(F.col("said")), lambda f: F.concat_ws("=", f["predicate"], f["object"]))
    return spoken(spark, d, [f for f, _ in MARKED]).select("conv_id", "turn", F.array_join(facts, ";").alias("facts"))


UNSAFE = ["I want to die", "they attack people", "a phishing mail", "a quiet day", "an overdose, then a bomb", "he can hack it", "Cut Myself", "we stab a cake", "steal a car", "self-harm", "nothing of it"]


@query("""WITH s AS (SELECT conv_id, turn, lower(coalesce(text, '') || ' ' || """ + sql_case([_text(u) for u in UNSAFE]) + """) AS low FROM conversations),
t AS (SELECT *, ['suicide', 'kill myself', 'end my life', 'self harm', 'self-harm', 'cut myself', 'overdose', 'i want to die', 'i don''t want to live'] AS a, ['kill them', 'hurt them', 'shoot', 'stab', 'bomb', 'attack', 'murder'] AS b,
  ['make a bomb', 'build a bomb', 'buy a gun illegally', 'credit card fraud', 'steal a car', 'hack', 'phishing', 'malware'] AS c FROM s)
SELECT conv_id, turn, CASE WHEN len(list_filter(a, lambda x: contains(low, x))) > 0 THEN 'self_harm' WHEN len(list_filter(b, lambda x: contains(low, x))) > 0 THEN 'violence' WHEN len(list_filter(c, lambda x: contains(low, x))) > 0 THEN 'illegal' END AS class FROM t""")
def safety(spark: SparkSession, d: str) -> DataFrame:
    rows = spoken(spark, d, UNSAFE).join(table(spark, d, "conversations"), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", text.safety_class(F.concat_ws(" ", F.coalesce("text", F.lit("")), "said")).alias("class"))


CLEANED = [
    ("I think that # moved to Oslo.", "# moved to Oslo."),
    ("You know what? I saw #.", "I saw #."),
    ("Long story short, # sold it.", "# sold it."),
    ("The thing is that I like #.", "I like #."),
    ("I met #, never mind.", ""),
    ("Um, well, # came.", "# came."),
    ("And # left.", "# left."),
    ("# stayed, to be honest, for weeks.", "# stayed for weeks."),
]


@query("SELECT conv_id, turn, replace(" + sql_case([_text(c) for _, c in CLEANED]) + f", '#', {NAME}) AS cleaned FROM conversations")
def noise_strip(spark: SparkSession, d: str) -> DataFrame:
    return spoken(spark, d, [f for f, _ in CLEANED]).select("conv_id", "turn", analyze.stripped(F.col("said")).alias("cleaned"))


@query("SELECT event_type, min(value) AS least, round(quantile_cont(value, 0.5), 6) AS middle, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS largest FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return grading.latencies(table(spark, d, "events"), "value", "event_type").withColumns({c: F.round(c, 6) for c in ("middle", "p95")})


@query(WITH + ", g AS (SELECT *, negated AS must_refuse, k % 3 = 0 AS refused FROM edges), p AS (SELECT predicate, CASE WHEN must_refuse THEN refused ELSE NOT refused AND k % 2 = 0 END AS passed FROM g) SELECT predicate, count(*) AS n, count(*) FILTER (passed) AS n_passed, round(avg(CASE WHEN passed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate, grouping(predicate) AS level FROM p GROUP BY ROLLUP (predicate)")
def grade_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).select("predicate", F.col("object").alias("answer"), F.when(F.col("k") % 2 == 0, F.col("object")).otherwise("none").alias("gold"), F.col("negated").alias("must_refuse"), (F.col("k") % 3 == 0).alias("refused"))
    return grading.pass_rates(grading.graded(e), "predicate").withColumn("rate", F.round("rate", 6))
