"""Text understanding: surface rules as column expressions, and a rule-and-lexicon analyzer behind one Arrow UDF.

The analyzer is pluggable: ``decomposed`` takes any function from ``(text, speaker, listener)`` to rows of ``DECOMPOSITION``. The
built-in one covers closed-class rules of English; it makes no promise for open-class accuracy.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import dims, text

_WH = "who|whom|whose|what|when|where|why|how|which"
_AUX = "am|is|are|was|were|do|does|did|has|have|had|can|could|will|would|shall|should|may|might|must"
_COMMANDS = "call|send|remind|forget|delete|remove|set|show|tell|give|play|stop|open|close|add|cancel|write|please"
_FEELINGS = "sad|happy|angry|afraid|excited|lonely|tired|anxious|glad|upset|proud|worried|scared"


# surface rules ------------------------------------------------------------------------------------------------------------------


def utterance_kind(said: Column) -> Column:
    """The first that fits: exclamatory, tag question, cleft, question, backchannel, command, emotion, statement."""
    s = F.lower(text.squeezed(said))
    bare = F.rtrim(s, F.lit(".!? "))
    return (
        F.when(s.rlike(rf"^(what an?|how) .*!$") | s.rlike("!!$"), "exclamatory")  # noqa: F541
        .when(s.rlike(rf",\s*(?:{_AUX})(?:n't)?(?: not)? (?:i|you|he|she|it|we|they)\s*\?$"), "tag_question")
        .when(s.rlike(r"^it(?:'s| is| was) .+ (?:who|that) .+"), "cleft")
        .when(s.endswith("?") | s.rlike(rf"^(?:{_WH})\b") | s.rlike(rf"^(?:{_AUX})(?:n't)? (?:i|you|he|she|it|we|they|the|my|your)\b"), "question")
        .when(bare.isin(*dims.BACKCHANNELS), "backchannel")
        .when(s.rlike(rf"^(?:{_COMMANDS})\b"), "command")
        .when(s.rlike(rf"\b(?:feel|feels|felt|feeling)\b") | s.rlike(rf"^(?:i'm|i am|i was) (?:so |very |really )?(?:{_FEELINGS})\b"), "emotion")  # noqa: F541
        .otherwise("statement")
    )


_CLASS = {"exclamatory": 4, "tag_question": 5, "cleft": 5, "question": 5, "backchannel": 1, "command": 2, "emotion": 3, "statement": 4}


def utterance_class(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in _CLASS.items() for x in kv]), kind)


def without_tag(said: Column) -> Column:
    return F.regexp_replace(said, rf"(?i),\s*(?:{_AUX})(?:n't)?(?: not)? (?:i|you|he|she|it|we|they)\s*\?$", ".")


def wh_word(question: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(question), rf"\b({_WH})\b", 1), F.lit(""))


def return_field(question: Column) -> Column:
    """What a question wants back: temporal, emotional, relational or episodic."""
    q, wh = F.lower(text.squeezed(question)), F.coalesce(wh_word(question), F.lit(""))
    feeling = q.rlike(r"\b(?:feel|feels|feeling|feelings|emotion|emotions|mood|describe)\b")
    return (
        F.when((wh == "when") | q.rlike(r"\bhow (?:long|often)\b"), "temporal")
        .when((wh == "how") & (feeling | q.rlike(rf"\bhow (?:{_FEELINGS})\b")), "emotional")
        .when(wh == "whose", "relational")
        .when(wh.isin("who", "whom") & q.rlike(r"^(?:who|whom)\b"), "relational")
        .when(wh.isin("where", "why"), "episodic")
        .when(feeling, "emotional")
        .otherwise("episodic")
    )


def query_entity(question: Column) -> Column:
    """The first capitalised word after the question's first, without a possessive."""
    name = F.regexp_extract(F.regexp_replace(question, r"^\s*\S+\s+", ""), r"\b([A-Z][\p{L}]+)(?:'s)?\b", 1)
    return F.nullif(name, F.lit(""))


def decomposed_query(question: Column) -> Column:
    """``struct(wh, return_field, entity, situational)``."""
    return F.struct(wh_word(question).alias("wh"), return_field(question).alias("return_field"), query_entity(question).alias("entity"), text.is_situational(question).alias("situational"))


QUESTION = "struct<subject:string,predicate:string,object:string,match_schema:string,emotions:array<string>>"


def asked(question: str) -> dict:
    """A question's subject (``user`` for the first person), content verb, what follows it, the schema of that verb's sense (family
    where kin is named), and the words of feeling in it."""
    words = [(w, t) for w, t in tagged(question) if t != "PUNCT"]
    while words and re.fullmatch(_WH, words[0][0].lower()):
        words.pop(0)
    lead = words and words[0][1] == "AUX"
    if lead:
        words.pop(0)
    low = [w.lower() for w, _ in words]
    known = [i for i, w in enumerate(low) if lemma(w) in _VERB_SENSE]
    guess = [i for i, (_, t) in enumerate(words) if t == "VERB"]
    v = next(iter(known or guess), None)
    names = [i for i, (_, t) in enumerate(words) if t in ("PROPN", "NOUN", "PRON", "NUM")]
    if v is None and lead and len(names) > 1:
        v = names[-1] if words[names[-1]][1] != "PROPN" else None
    before = words[:v] if v is not None else words
    plain = [(w, t) for w, t in before if t in ("PROPN", "NOUN", "PRON", "ADJ", "NUM")]
    subject = " ".join(w for w, _ in plain) or None
    if subject and _PRON.get(subject.lower()) == "1":
        subject = "user"
    predicate = lemma(low[v]) if v is not None else None
    after = [w for w, t in words[v + 1 :] if t not in ("DET", "AUX", "ADV", "ADP")] if v is not None else []
    sense = _VERB_SENSE.get(predicate or "")
    schema = "family" if any(w in _KIN for w in low) else dims.SUPERSENSE_SCHEMA.get(sense) if sense and sense != "stative" else None
    return {"subject": subject, "predicate": predicate, "object": " ".join(after) or None, "match_schema": schema, "emotions": [w for w in low if w in _MOODS] or None}


def parsed_question(question: Column) -> Column:
    """``QUESTION`` of a question: rules that need its words in order, so an Arrow UDF over the (few) questions."""

    @F.pandas_udf(QUESTION)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for said in batches:
            yield pd.DataFrame([asked(q or "") for q in said], columns=["subject", "predicate", "object", "match_schema", "emotions"])

    return run(question)


def predicted_questions(most: int = 4) -> Column:
    """The questions an edge would answer, from its parts; at most ``most``, none twice."""
    s, p, o = F.col("subject"), F.translate("predicate", "_", " "), F.col("object")
    made = [
        F.when(F.coalesce(o, F.lit("")) != "", F.concat(F.lit("What did "), s, F.lit(" "), p, F.lit("?"))),
        F.concat(F.lit("What do we know about "), s, F.lit("?")),
        F.when(F.col("emotion").isNotNull(), F.concat(F.lit("How does "), s, F.lit(" feel about "), o, F.lit("?"))),
        F.when(F.col("temporal_expression").isNotNull(), F.concat(F.lit("When did "), s, F.lit(" "), p, F.lit("?"))),
        F.concat(F.lit("What about "), o, F.lit("?")),
    ]
    return F.slice(F.array_distinct(F.array_compact(F.array(*made))), 1, most)


# cleaning -----------------------------------------------------------------------------------------------------------------------

_FILLERS = r"\b(?:um+|uh+|er+|hmm+|oh|ah|wow|well|like|so|anyway|basically|literally|honestly)\b,?\s*"
_IDIOMS = "|".join(dims.IDIOM_FRAMES)
_SUBJECT = r"(?:i|you|he|she|it|we|they|my|your|his|her|our|their|this|that|the|there)\b|(?-i:[A-Z]\w+(?: [A-Z]\w+)*\s+(?!(?:from|at|in|on|of|with|and|or|very|well|too)\b)[a-z])"
#: A speaker's verb of saying or thinking before another clause with a subject of its own.
_FRAME = rf"(?i:^\s*(?:i|we|you) (?:{'|'.join(dims.FRAME_VERBS)})\b,?(?: that)?\s+)(?=(?i:{_SUBJECT}))"
_NOUN_FRAME = rf"(?i)^\s*(?:the|my) (?:{'|'.join(dims.FRAME_NOUNS)}) is,?(?: that)?\s+"


def stripped(said: Column) -> Column:
    """A text without what is no fact: nothing is left of one that ends by taking itself back; of a question that only leads to its
    answer, the answer; and idioms, frames of saying and thinking, interjections and conjunctions at its start go."""
    back = dims.any_of([F.regexp_replace(F.lower(said), r"[.,!? ]+$", "").endswith(p) for p in dims.RETRACTIONS])
    out = F.regexp_replace(said, rf"(?i)^\s*(?:you know|{_IDIOMS}|(?:guess|remember|listen|wait|know))\b[^?.!]*\?\s+(?=\S)", "")
    out = F.regexp_replace(out, rf"(?i),?\s*\b(?:{_IDIOMS}|you know|i mean)\b,?", " ")
    out = F.regexp_replace(out, rf"(?i)^(?:\s*{_FILLERS})+", "")
    out = F.regexp_replace(out, _NOUN_FRAME, "")
    out = F.regexp_replace(out, _FRAME, "")
    out = F.regexp_replace(out, r"(?i)^\s*(?:and|but|or|so|because)\s+", "")
    return F.when(back, F.lit("")).otherwise(text.squeezed(out))


def needs_correction(said: Column, cleaned: Column) -> Column:
    """Whether a grammar model is worth asking: not for a text that cleaning left alone and that starts and ends properly."""
    return ~((said == cleaned) & said.rlike(r"^[A-Z]") & said.rlike(r"[.!?]$"))


# the built-in analyzer -------------------------------------------------------------------------------------------------------------

_DET = set("the a an this that these those my your his her its our their some any no every each".split())
_PRON = {"i": "1", "me": "1", "my": "1", "mine": "1", "myself": "1", "we": "1", "us": "1", "our": "1", "you": "2", "your": "2", "yours": "2", "yourself": "2", "he": "3", "him": "3", "his": "3", "she": "3", "her": "3", "it": "3", "its": "3", "they": "3", "them": "3", "their": "3"}
_PREP = set("in on at to for from with about of by into over under after before during between through against near".split())
_AUXES = set(_AUX.split("|")) | {"be", "been", "being", "'m", "'re", "'s", "'ve", "'ll", "'d", "n't", "not"}
_NEG = set(dims.NEGATIONS) | {"n't"}
_FREQ = set("always usually often sometimes rarely seldom never daily weekly monthly".split())
_ADV = _FREQ | set("very really quite just also too still already yet soon now then here there again almost ever".split())
_IRREGULAR = {"was": "be", "were": "be", "is": "be", "are": "be", "am": "be", "been": "be", "had": "have", "has": "have", "did": "do", "does": "do", "went": "go", "gone": "go", "said": "say", "got": "get", "made": "make", "knew": "know", "thought": "think", "took": "take", "taken": "take", "saw": "see", "seen": "see", "came": "come", "gave": "give", "given": "give", "found": "find", "told": "tell", "felt": "feel", "left": "leave", "met": "meet", "bought": "buy", "moved": "move", "ate": "eat", "ran": "run", "wrote": "write", "written": "write", "began": "begin", "won": "win", "lost": "lose", "broke": "break", "fell": "fall", "sold": "sell", "paid": "pay", "sent": "send", "kept": "keep", "slept": "sleep", "taught": "teach", "caught": "catch", "drove": "drive", "flew": "fly", "became": "become", "brought": "bring", "built": "build", "chose": "choose", "cut": "cut", "did": "do", "drew": "draw", "fed": "feed", "fought": "fight", "forgot": "forget", "grew": "grow", "held": "hold", "hid": "hide", "hit": "hit", "led": "lead", "lent": "lend", "lay": "lie", "put": "put", "read": "read", "rode": "ride", "rose": "rise", "sang": "sing", "sat": "sit", "set": "set", "shot": "shoot", "shut": "shut", "spent": "spend", "spoke": "speak", "stood": "stand", "stole": "steal", "swam": "swim", "threw": "throw", "understood": "understand", "woke": "wake", "wore": "wear", "married": "marry", "studied": "study"}
_VERB_SENSE = {"work": "social", "meet": "social", "marry": "social", "join": "social", "buy": "possession", "sell": "possession", "own": "possession", "pay": "possession", "make": "creation", "build": "creation", "write": "creation", "paint": "creation", "learn": "cognition", "study": "cognition", "think": "cognition", "know": "cognition", "feel": "emotion", "love": "emotion", "hate": "emotion", "go": "motion", "move": "motion", "travel": "motion", "fly": "motion", "say": "communication", "tell": "communication", "talk": "communication", "eat": "consumption", "drink": "consumption", "sleep": "body", "hurt": "body", "play": "competition", "win": "competition", "see": "perception", "hear": "perception", "be": "stative", "have": "stative", "live": "stative", "touch": "contact", "hit": "contact", "become": "change", "start": "change", "stop": "change", "divorce": "social", "date": "social", "visit": "social", "invite": "social", "help": "social", "lead": "social", "hire": "social", "fire": "social", "serve": "social", "vote": "social", "celebrate": "social", "lend": "possession", "borrow": "possession", "give": "possession", "get": "possession", "receive": "possession", "steal": "possession", "spend": "possession", "save": "possession", "earn": "possession", "invest": "possession", "donate": "possession", "cook": "creation", "bake": "creation", "draw": "creation", "design": "creation", "compose": "creation", "sing": "creation", "knit": "creation", "plant": "creation", "remember": "cognition", "forget": "cognition", "understand": "cognition", "decide": "cognition", "believe": "cognition", "read": "cognition", "teach": "cognition", "plan": "cognition", "research": "cognition", "graduate": "cognition", "enjoy": "emotion", "like": "emotion", "miss": "emotion", "fear": "emotion", "worry": "emotion", "regret": "emotion", "hope": "emotion", "arrive": "motion", "leave": "motion", "walk": "motion", "run": "motion", "drive": "motion", "ride": "motion", "return": "motion", "come": "motion", "hike": "motion", "swim": "motion", "relocate": "motion", "ask": "communication", "call": "communication", "speak": "communication", "promise": "communication", "text": "communication", "email": "communication", "smoke": "consumption", "order": "consumption", "taste": "perception", "watch": "perception", "listen": "perception", "smell": "perception", "notice": "perception", "exercise": "body", "wake": "body", "rest": "body", "cry": "body", "train": "body", "lose": "competition", "compete": "competition", "beat": "competition", "race": "competition", "stay": "stative", "keep": "stative", "need": "stative", "belong": "stative", "grow": "change", "begin": "change", "finish": "change", "quit": "change", "retire": "change", "improve": "change", "break": "contact", "cut": "contact", "hold": "contact", "push": "contact"}
_VERB_CLASS = {"social": "SOCIAL", "possession": "POSSESSION", "creation": "CREATION", "cognition": "COGNITION", "emotion": "EMOTION", "motion": "LOCATION", "communication": "COMMUNICATION", "consumption": "CONSUMPTION", "body": "BODY", "competition": "ACHIEVEMENT", "perception": "EXPERIENCE", "stative": "STATIVE", "contact": "ACTION", "change": "CHANGE"}
_KIN = set("mother father mom dad sister brother son daughter wife husband aunt uncle cousin grandmother grandfather parents family".split())
_MOODS = {"happy": 0.8, "glad": 0.7, "excited": 0.8, "proud": 0.7, "love": 0.9, "sad": -0.7, "angry": -0.8, "upset": -0.7, "afraid": -0.7, "anxious": -0.6, "worried": -0.6, "lonely": -0.7, "tired": -0.3, "scared": -0.7, "hate": -0.9}
_TIME = re.compile(r"\b(yesterday|today|tomorrow|tonight|(?:last|next|this) (?:week|month|year|night|monday|tuesday|wednesday|thursday|friday|saturday|sunday)|(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten|an?) (?:day|week|month|year)s? ago|(?:in|since) (?:19|20)\d\d|(?:january|february|march|april|june|july|august|september|october|november|december)(?: \d{1,2})?(?:,? \d{4})?)\b", re.I)
_TOKEN = re.compile(r"n't|'(?:m|re|s|ve|ll|d)\b|\d+(?:[.,:]\d+)*|[^\W\d_]+(?:-[^\W\d_]+)*(?=n't)|[^\W\d_]+(?:-[^\W\d_]+)*|[^\w\s]", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")

DECOMPOSITION = "sentence int, subject string, predicate string, object string, source_text string, mood string, tense string, aspect string, voice string, negated boolean, emotion string, valence double, emotion_target string, temporal_expression string, temporal_context string, entities array<string>, schematic string, verb_class string, significance string, episodic_fact string, object_pos array<string>, subject_pos string"


def lemma(word: str) -> str:
    w = word.lower()
    if w in _IRREGULAR:
        return _IRREGULAR[w]
    if w.endswith("ied") and len(w) > 4:
        return w[:-3] + "y"
    if w.endswith("ing") and len(w) > 5:
        stem = w[:-3]
        return stem[:-1] if stem[-1] == stem[-2] else stem
    if w.endswith("ed") and len(w) > 4 and not w.endswith("eed"):
        stem = w[:-2]
        return stem[:-1] if len(stem) > 2 and stem[-1] == stem[-2] and stem[-1] not in "ls" else stem
    if w.endswith("es") and w[:-2].endswith(("sh", "ch", "x", "z", "ss")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") and len(w) > 3 else w


def tagged(sentence: str) -> list[tuple[str, str]]:
    """Words with a coarse part of speech."""
    out: list[tuple[str, str]] = []
    for k, w in enumerate(_TOKEN.findall(sentence)):
        low = w.lower()
        before = out[-1][1] if out else ""
        if not low[0].isalnum() and low[0] != "'":
            tag = "PUNCT"
        elif low in _DET and low not in ("that",):
            tag = "DET"
        elif low in _PRON:
            tag = "PRON"
        elif low in _AUXES:
            tag = "AUX"
        elif low in _PREP:
            tag = "ADP"
        elif low in _ADV or (low.endswith("ly") and len(low) > 4):
            tag = "ADV"
        elif low.isdigit() or low[0].isdigit():
            tag = "NUM"
        elif low in ("and", "or", "but"):
            tag = "CCONJ"
        elif low in ("because", "if", "when", "while", "that", "although"):
            tag = "SCONJ"
        elif low in _MOODS and low not in ("love", "hate"):
            tag = "ADJ"
        elif k and w[0].isupper():
            tag = "PROPN"
        elif lemma(low) in _VERB_SENSE or (before in ("PRON", "PROPN", "AUX") and not any(t == "VERB" for _, t in out)):
            tag = "VERB" if before != "DET" else "NOUN"
        elif not k and w[0].isupper() and low not in _VERB_SENSE:
            tag = "PROPN"
        elif low.endswith(("ful", "ous", "ive", "able", "less")):
            tag = "ADJ"
        else:
            tag = "NOUN"
        out.append((w, tag))
    return out


def _mood(sentence: str, words: list[tuple[str, str]]) -> str:
    low = sentence.lower()
    if re.search(r"\b(?:if i were|i wish|would that|suggest that|as if)\b", low):
        return "subjunctive"
    if low.rstrip().endswith("?") or re.match(rf"(?:{_WH})\b", low):
        return "interrogative"
    if re.search(r"\bif\b|\bunless\b", low) or re.search(r"\b(?:would|could|might)\b", low):
        return "conditional"
    if words and (words[0][1] == "VERB" and words[0][0].islower() or re.match(rf"(?:{_COMMANDS})\b", low)):
        return "imperative"
    return "indicative"


def _tense(words: list[tuple[str, str]]) -> tuple[str, str]:
    low = [w.lower() for w, _ in words]
    line = " ".join(low)
    aux = [w for w, t in zip(low, (t for _, t in words), strict=True) if t == "AUX"]
    if "used to" in line:
        return "past", "habitual"
    if re.search(r"\b(?:will|shall|'ll)\b|\bgoing to\b", line):
        return "future", "simple"
    perfect = any(a in ("have", "has", "had", "'ve") for a in aux)
    going = any(w.endswith("ing") and t == "VERB" for w, t in zip(low, (t for _, t in words), strict=True)) and any(a in ("am", "is", "are", "was", "were", "'m", "'re", "'s", "been") for a in aux)
    past = any(a in ("was", "were", "did", "had") for a in aux) or any(t == "VERB" and (w.endswith("ed") or _IRREGULAR.get(w, w) != w) for w, t in zip(low, (t for _, t in words), strict=True))
    aspect = "perfect_progressive" if perfect and going else "perfect" if perfect else "progressive" if going else "simple"
    return ("present" if perfect and "had" not in aux else "past") if past or perfect else "present", aspect


def _names(words: list[tuple[str, str]]) -> list[str]:
    out, held = [], []
    for w, t in [*words, ("", "")]:
        if t == "PROPN":
            held.append(w)
        elif held:
            out.append(" ".join(held))
            held = []
    return list(dict.fromkeys(out))


def _resolved(phrase: str, speaker: str, listener: str) -> str:
    who = {"1": speaker, "2": listener}
    return " ".join(who.get(_PRON.get(w.lower(), ""), w) or w for w in phrase.split())


def rules(said: str, speaker: str, listener: str) -> list[dict]:
    """A row of ``DECOMPOSITION`` for each sentence that has a verb."""
    out = []
    for k, sentence in enumerate(s for s in _SENTENCE.split(said.strip()) if s.strip()):
        words = tagged(sentence)
        verbs = [i for i, (_, t) in enumerate(words) if t == "VERB"] or [i for i, (w, t) in enumerate(words) if t == "AUX" and w.lower() not in _NEG]
        if not verbs:
            continue
        v = verbs[0]
        plain = [(w, t) for w, t in words[:v] if t not in ("PUNCT", "AUX", "ADV", "CCONJ", "SCONJ")]
        while plain and plain[0][1] == "DET" and plain[0][0].lower() not in _PRON:
            plain.pop(0)
        subject = _resolved(" ".join(w for w, _ in plain), speaker, listener) or speaker
        subject_pos = plain[0][1] if len(plain) == 1 and subject == plain[0][0] else None
        after = [(w, t) for w, t in words[v + 1 :] if t != "PUNCT"]
        low = [w.lower() for w, _ in words]
        predicate = lemma(words[v][0])
        if after and after[0][1] == "ADP" and not _TIME.match(" ".join(w for w, _ in after)):
            predicate += "_" + after[0][0].lower()
            after = after[1:]
        stop = next((i for i, (w, t) in enumerate(after) if t in ("ADP", "SCONJ", "CCONJ") and i), len(after))
        obj = [(w, t) for w, t in after[:stop] if t not in ("ADV", "AUX") and w.lower() not in ("the", "a", "an")]
        time = _TIME.search(sentence)
        if time:
            gone = set(time[0].lower().split())
            obj = [(w, t) for w, t in obj if w.lower() not in gone]
        negated = any(w in _NEG for w in low)
        feeling = next((w for w in low if w in _MOODS), None)
        tense, aspect = _tense(words)
        sense = _VERB_SENSE.get(lemma(words[v][0]), "")
        kin = any(w in _KIN for w in low)
        verb_class = _VERB_CLASS.get(sense, "ACTION")
        if verb_class == "LOCATION" and not any(t == "PROPN" for _, t in after):
            verb_class = "EXPERIENCE"
        if re.search(r"\babout to\b|\bplan(?:s|ned|ning)? to\b|\bgoing to\b", sentence.lower()):
            verb_class = "PLANNING"
        target = next((after[i + 1][0] for i, (w, t) in enumerate(after[:-1]) if t == "ADP" and feeling), None)
        significance = "stative" if (tense, aspect) in (("present", "simple"), ("past", "habitual")) else "milestone" if tense == "past" and aspect == "simple" and verb_class == "ACHIEVEMENT" else "notable" if tense == "past" and verb_class == "EXPERIENCE" else "routine"
        passive = any(w in ("was", "were", "is", "are", "been") for w in low) and bool(re.search(r"\b\w+(?:ed|en)\b by\b", sentence.lower()))
        out.append(
            {
                "sentence": k, "subject": subject, "predicate": predicate, "object": _resolved(" ".join(w for w, _ in obj), speaker, listener), "source_text": sentence.strip(), "mood": _mood(sentence, words), "tense": tense, "aspect": aspect, "voice": "passive" if passive else "active", "negated": negated,
                "emotion": feeling, "valence": None if feeling is None else (-_MOODS[feeling] if negated else _MOODS[feeling]), "emotion_target": target, "temporal_expression": time[0] if time else None, "temporal_context": tense, "entities": _names(words), "schematic": "family" if kin else dims.SUPERSENSE_SCHEMA.get(sense, "uncategorized"),
                "verb_class": verb_class, "significance": significance, "episodic_fact": re.sub(r"\s+", " ", " ".join([subject, predicate.replace("_", " "), *(w for w, _ in obj)])).strip(), "object_pos": [t for _, t in obj], "subject_pos": subject_pos,
            }
        )
    return out


def decomposed(turns: DataFrame, analyzer: Callable[[str, str, str], list[dict]] = rules) -> DataFrame:
    """``turns(.., text, speaker, listener?)`` with a row for each sentence and the columns of ``DECOMPOSITION``; texts are cleaned first,
    and equal texts of a speaker in a batch are analyzed once."""
    have = turns if "listener" in turns.columns else turns.withColumn("listener", F.lit(None).cast("string"))
    ready = have.withColumn("text", stripped(F.coalesce("text", F.lit(""))))
    columns = [c.split()[0] for c in DECOMPOSITION.split(", ")]

    @F.pandas_udf(f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in DECOMPOSITION.split(', '))}>>")
    def parse(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for said, speaker, listener in batches:
            memo: dict[tuple, list] = {}
            rows = []
            for key in zip(said.fillna(""), speaker.fillna("user"), listener.fillna("assistant"), strict=True):
                if key not in memo:
                    memo[key] = [{c: r.get(c) for c in columns} for r in analyzer(*key)]
                rows.append(memo[key])
            yield pd.Series(rows)

    out = ready.withColumn("__d", F.explode(parse("text", "speaker", "listener")))
    return out.select(*[c for c in have.columns if c not in ("text", "listener")], "__d.*")


def mood_gate(rows: DataFrame, kind: Column) -> DataFrame:
    """Nothing of a command or backchannel is kept; of a question, what is not asked."""
    return rows.where(~kind.isin("command", "backchannel") & (~kind.isin("question", "tag_question") | (F.col("mood") != "interrogative")))
