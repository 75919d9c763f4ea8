"""Fixed vocabularies and mappings (fixed values: they decide results), as literals or small broadcast tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

REFUSAL = "This information is not mentioned in the conversation."

SCHEMAS = ["career", "finance", "education", "health", "hobby", "family", "social", "experience", "emotional", "identity", "uncategorized"]

RELATED_SCHEMAS = {
    "career": ["finance", "education"],
    "finance": ["career"],
    "education": ["career"],
    "health": ["hobby"],
    "hobby": ["health", "experience"],
    "family": ["social"],
    "social": ["family"],
    "experience": ["hobby"],
    "emotional": ["social", "family"],
    "identity": [],
}

SCHEMA_RELATION = {
    "career": "professional",
    "finance": "professional",
    "education": "professional",
    "family": "familial",
    "social": "social",
    "hobby": "social",
    "experience": "social",
    "health": "personal",
    "housing": "personal",
    "identity": "personal",
    "planning": "personal",
    "uncategorized": "personal",
}

SUPERSENSE_SCHEMA = {
    "social": "career",
    "possession": "finance",
    "creation": "hobby",
    "cognition": "education",
    "emotion": "emotional",
    "motion": "experience",
    "communication": "social",
    "consumption": "health",
    "body": "health",
    "competition": "hobby",
    "perception": "experience",
    "stative": "identity",
    "contact": "experience",
    "change": "experience",
}

#: The timeline's domain of a schema, of five: the one whose anchors (occupation, money, education; health, sport, diversion; feeling,
#: mood; person, family, group; place, travel) are nearest in a taxonomy. Schemas not named here go to ``emotional``.
SCHEMA_DOMAIN = {"career": "career", "finance": "career", "education": "career", "health": "health", "hobby": "health", "family": "relationship", "social": "relationship", "emotional": "emotional", "housing": "spatial", "travel": "spatial"}

#: Hosts by source tag (in lower case, trimmed), and the host of all other tags.
TAG_HOST = {"llm:claude": "claude", "llm:gpt": "chatgpt", "llm:chatgpt": "chatgpt", "llm:gemini": "gemini", "user": "claude"}
DEFAULT_HOST = "claude"

EMOTION_SYNONYMS = {"happy": ["glad", "joyful", "excited"], "angry": ["mad", "furious", "annoyed"], "sad": ["unhappy", "down", "upset"]}

SITUATIONAL_PREFIXES = [
    "tell me about",
    "summarize",
    "what's going on with",
    "what's happening with",
    "what is going on with",
    "what is happening with",
    "update me on",
    "describe",
    "catch me up on",
    "fill me in on",
    "brief me on",
    "give me an overview of",
    "what do you know about",
    "what do we know about",
]

#: Phrases that ask for a situation even where only explicit requests do (one more is the tool's own name).
EXPLICIT_TRIGGERS = ["what's going on", "whats going on", "summarize", "tell me about", "what is going on", "what's happening", "whats happening", "how is everything", "catch me up", "give me a summary", "overview"]

SAFETY_TERMS = {
    "self_harm": ["suicide", "kill myself", "end my life", "self harm", "self-harm", "cut myself", "overdose", "i want to die", "i don't want to live"],
    "violence": ["kill them", "hurt them", "shoot", "stab", "bomb", "attack", "murder"],
    "illegal": ["make a bomb", "build a bomb", "buy a gun illegally", "credit card fraud", "steal a car", "hack", "phishing", "malware"],
}

#: What a text that takes itself back ends with.
RETRACTIONS = ["never mind", "nevermind", "forget it", "forget that", "scratch that", "disregard that", "ignore that"]

#: Idioms, verbs and nouns of frames around what is said.
IDIOM_FRAMES = ["long story short", "bottom line", "at the end of the day", "truth be told", "between you and me", "to be honest", "to be fair", "for what it's worth", "if you ask me", "believe it or not", "here's the thing", "here's the deal"]
FRAME_VERBS = ["wait", "remind", "mean", "say", "tell", "know", "think", "wonder", "guess", "suppose", "remember", "hear", "listen", "look"]
FRAME_NOUNS = ["thing", "point", "deal", "fact", "truth", "matter", "problem", "issue", "question"]

NEGATIONS = ["not", "no", "never", "hardly", "barely", "scarcely", "rarely", "seldom"]

BACKCHANNELS = ["yeah", "yes", "yep", "ok", "okay", "right", "sure", "uh-huh", "mm-hmm", "i see", "got it", "cool"]

ENTITY_TYPES = ["PERSON", "ORG", "LOCATION", "TIME", "EVENT", "QUANTITY", "WORK_OF_ART", "PRODUCT", "GENERIC"]

NER_TYPE = {"PERSON": "PERSON", "ORG": "ORG", "NORP": "ORG", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION", "DATE": "TIME", "TIME": "TIME", "EVENT": "EVENT", "CARDINAL": "QUANTITY", "ORDINAL": "QUANTITY", "MONEY": "QUANTITY", "PERCENT": "QUANTITY", "QUANTITY": "QUANTITY", "WORK_OF_ART": "WORK_OF_ART", "LAW": "WORK_OF_ART", "PRODUCT": "PRODUCT", "LANGUAGE": "GENERIC"}


def mapped(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """``table[key]``, or the default, as one literal map."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def any_of(checks: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, checks, F.lit(False))


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    return any_of([text.startswith(p) for p in prefixes])


def contains_any(text: Column, parts: list[str]) -> Column:
    return any_of([text.contains(p) for p in parts])


#: Verbs of one state that has one value at a time, by their base form: whichever of them comes, it replaces the value before.
ONE_AT_A_TIME = {v: kind for kind, verbs in {"residence": ("live", "move", "relocate", "reside", "settle", "stay"), "employment": ("work", "join"), "marriage": ("marry", "divorce")}.items() for v in verbs}


def state_class(predicate: Column) -> Column:
    """The state that a predicate's verb is about, if it is one of ``ONE_AT_A_TIME``; else the predicate. In lower case."""
    low = F.lower(F.trim(predicate))
    return F.coalesce(mapped(F.regexp_extract(low, "^[^_ ]+", 0), ONE_AT_A_TIME), low)
