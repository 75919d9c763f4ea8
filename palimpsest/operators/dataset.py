"""The offline dataset pipeline: import, prefilter, queue, mark, validate, adjudicate, derive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions import dims, text

#: Closed word lists (fixed values).
FIRST_PERSON = ["i ", "i'm", "i've", "i'd", "i'll", "my ", "me ", "mine", "myself", "we ", "we're", "we've", "our ", "ours"]
FIRST_PERSON_WORDS = ["i", "me", "my", "we", "us", "our"]
FIRST_PERSON_SHORT = ["i'm", "i've", "i'd", "i'll", "we're", "we've", "we'd", "we'll"]
JUNK_STARTS = [
    "every day, a tree", "in analytical chemistry", "write a ", "create a ", "generate a ", "explain ", "what is ", "what are ", "how do ", "how does ",
    "how can ", "can you ", "could you ", "please provide ", "list ", "describe the ", "compare ", "calculate ", "solve ", "def ",
    "function ", "class ", "import ", "```", "here's ", "here is ", "sure, ", "certainly", "of course", "as an ai", "as a language model",
]
PREDICATES = ["works_at", "occupation", "manager_name", "lives_in", "likes", "has_pet", "feels"]
REQUIRED = ["id", "source_text", "clean_text", "facts"]


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 12))


_ROLE_TEXT = "struct<role:string,text:string>"


def imported(rows: DataFrame, prefix: str = "c") -> DataFrame:
    """Candidates ``candidate_id, source_text_raw, source_type`` from rows of any of seven shapes, told by their columns: ``messages``
    or ``conversations`` (arrays of role or from, content or value), ``conversation`` (the same as JSON text), ``role`` with
    ``text``, ``dialog`` (array of texts), ``persona`` (array of texts), or one text field."""
    have = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    none = F.array().cast(f"array<{_ROLE_TEXT}>")

    def turns(c: str, role: str, body: str) -> Column:
        return F.transform(F.col(c), lambda m: F.struct(m[role].alias("role"), m[body].alias("text")))

    shapes: list[Column] = []
    for c in ("messages", "conversations"):
        if c in have:
            shapes.append(turns(c, "role" if "role:" in have[c] else "from", "content" if "content:" in have[c] else "value"))
    if "conversation" in have:
        parsed = F.from_json("conversation", "array<struct<role:string,content:string>>")
        shapes.append(F.transform(parsed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("text"))))
    if {"role", "text"} <= have.keys():
        shapes.append(F.array(F.struct("role", "text")))
    for c, role in (("dialog", "user"), ("persona", "persona")):
        if c in have:
            shapes.append(F.transform(F.col(c), lambda x, r=role: F.struct(F.lit(r).alias("role"), x.alias("text"))))
    if "role" not in have:
        for c in ("text", "utterance", "prompt", "content"):
            if c in have:
                shapes.append(F.array(F.struct(F.lit("user").alias("role"), F.col(c).alias("text"))))
                break
    each = rows.select(F.explode(F.filter(F.coalesce(*shapes, none), lambda t: F.length(F.trim(t["text"])) > 0)).alias("t"))
    return each.select(stable_id(prefix, F.coalesce("t.role", F.lit("")), F.col("t.text")).alias("candidate_id"), F.col("t.text").alias("source_text_raw"), F.lower(F.coalesce("t.role", F.lit("user"))).alias("source_type"))


def is_junk(value: Column) -> Column:
    low = F.trim(F.lower(value))
    return (text.word_count(low) < 5) | (F.length(low) > 2000) | dims.starts_with_any(low, JUNK_STARTS)


def prefilter_reason(source_type: Column, value: Column) -> Column:
    """``kept``, or why a candidate goes."""
    kind = F.coalesce(source_type, F.lit(""))
    return F.when(kind.contains("assistant") | kind.contains("gpt"), "skipped_assistant").when(is_junk(value), "skipped_junk").when(~kind.contains("persona") & ~dims.contains_any(F.lower(value), FIRST_PERSON), "skipped_no_first_person").otherwise("kept")


def prefilter_counts(candidates: DataFrame) -> DataFrame:
    r = prefilter_reason(F.col("source_type"), F.col("source_text_raw"))
    return candidates.select(r.alias("reason")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("reason") == k).alias(k) for k in ("kept", "skipped_assistant", "skipped_junk", "skipped_no_first_person")])


def reason_shares(candidates: DataFrame) -> DataFrame:
    """Counts by reason with their share of all."""
    by = candidates.select(prefilter_reason(F.col("source_type"), F.col("source_text_raw")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 4))


def has_first_person(value: Column) -> Column:
    low = F.lower(value)
    return dims.contains_any(F.concat(F.lit(" "), low, F.lit(" ")), [f" {w} " for w in FIRST_PERSON_WORDS]) | dims.contains_any(low, [f" {w}" for w in FIRST_PERSON_SHORT])


def gold_queue(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """User-like candidates in the first person that ask nothing, one for each id; the first ``limit`` by id, if given."""
    kind = F.lower(F.coalesce("source_type", F.lit("")))
    rows = candidates.where(dims.contains_any(kind, ["user", "human", "prompter"]) & has_first_person(F.col("source_text_raw")) & ~F.col("source_text_raw").contains("?")).dropDuplicates(["candidate_id"])
    return rows.orderBy("candidate_id").limit(limit) if limit else rows


def sample(rows: DataFrame, n: int, seed: int, id_col: str = "candidate_id") -> DataFrame:
    """n rows by a seeded hash: the same rows whatever the partitioning."""
    return rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)


def line_range(rows: DataFrame, first: int, last: int, order: str) -> DataFrame:
    """Rows ``first`` to ``last`` (from 1, both included) in an order: a bounded top-k, then its tail."""
    head = rows.orderBy(order).limit(last)
    return head.withColumn("line", F.row_number().over(W.orderBy(order))).where(F.col("line") >= first)


def problems(inventory: list[str]) -> Column:
    """What is wrong with a master row, as an array of texts."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in REQUIRED]
    bad = F.transform(F.array_distinct(F.array_except(F.coalesce(F.transform("facts", lambda f: f["predicate"]), F.array().cast("array<string>")), F.array(*map(F.lit, inventory)))), lambda p: F.concat(F.lit("predicate:"), F.coalesce(p, F.lit("null"))))
    return F.concat(F.array_compact(F.array(*missing)), bad)


def quarantined(master: DataFrame, inventory: list[str]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and invalid ones with their ``problems``."""
    marked = master.withColumn("problems", problems(inventory))
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)


def signature(facts: Column) -> Column:
    """The facts' canonical text, whatever their order."""
    return F.array_join(F.array_sort(F.transform(facts, lambda f: F.concat_ws("|", text.normalised(f["subject"]), text.normalised(f["predicate"]), text.normalised(f["object"])))), ";")


def adjudicated(judgements: DataFrame) -> DataFrame:
    """``judgements(key, judge, signature)``: agreed if two judges or more gave one signature; else why not, with the variants."""
    g = judgements.groupBy("key").agg(F.countDistinct("judge").alias("judges"), F.sort_array(F.collect_set("signature")).alias("variants"))
    outcome = F.when(F.col("judges") == 1, "single_judge").when(F.size("variants") == 1, "agreed").otherwise("disagreement")
    return g.select("key", "judges", outcome.alias("outcome"), "variants")


TASKS = ("cleanup", "triplets", "roles", "affect")


def tasks(master: DataFrame) -> DataFrame:
    """Four training rows from each master row: ``id, task, input, output``."""
    joined = lambda c, *fields: F.array_join(F.transform(F.coalesce(F.col(c), F.array()), lambda f: F.concat_ws(" | ", *[f[x] for x in fields])), "\n")
    outputs = {"cleanup": F.col("clean_text"), "triplets": joined("facts", "subject", "predicate", "object"), "roles": joined("roles", "label", "text"), "affect": joined("affect", "subject", "predicate", "object")}
    made = F.array(*[F.struct(F.concat(F.col("id"), F.lit(f"_{t}")).alias("id"), F.lit(t).alias("task"), (F.col("source_text") if t == "cleanup" else F.col("clean_text")).alias("input"), outputs[t].alias("output")) for t in TASKS])
    return master.select(F.explode(made).alias("t")).select("t.*")


#: What announces a fact, by predicate (fixed values); what follows is a name or the rest of the text.
MARKERS = [
    ("works_at", ["i work at ", "i work for ", "i work in "], "name"),
    ("occupation", ["i am a ", "i'm a ", "i'm an ", "i am an "], "rest"),
    ("manager_name", ["my manager is ", "my boss is "], "name"),
    ("lives_in", ["i live in ", "i'm in ", "i am in "], "rest"),
    ("likes", ["i love ", "i like ", "i enjoy "], "rest"),
    ("has_pet", ["my dog ", "my cat "], "name"),
    ("feels", ["i feel ", "i am feeling ", "i'm feeling "], "rest"),
]


def marked_facts(value: Column, inventory: list[str] | None = None) -> Column:
    """``array<struct<subject, predicate, object>>``: for each predicate of the inventory, what follows its first marker in a text, as
    a name (the first word, capitalised) or as the rest without its closing punctuation."""
    allowed = PREDICATES if inventory is None else inventory
    low = F.rtrim(text.squeezed(F.lower(value)), F.lit(".,;:!?"))
    facts = []
    for predicate, markers, kind in MARKERS:
        if predicate not in allowed:
            continue
        found = F.coalesce(*[F.nullif(F.rtrim(F.when(low.contains(m), F.regexp_extract(low, rf"{m}(.*)$", 1)), F.lit(".,;:!? ")), F.lit("")) for m in markers])
        obj = F.initcap(F.rtrim(F.substring_index(found, " ", 1), F.lit(".,;:!?"))) if kind == "name" else found
        facts.append(F.when(found.isNotNull(), F.struct(F.lit("user").alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"))))
    return F.array_compact(F.array(*facts))
