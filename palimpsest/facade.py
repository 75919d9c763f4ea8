"""One object for callers: write, ask, forget, show, trace. It holds a store and a user; every method is one plan."""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass, field, is_dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from palimpsest import schemas
from palimpsest.functions import dims, text, vector
from palimpsest.functions.embed import STYLE_ANCHORS, embedder, hash_vector, style_deltas
from palimpsest.operators import analyze, assertions, scan, scoring, state, timeline
from palimpsest.sources.store import EdgeStore
from palimpsest.streaming import ingest


@dataclass(frozen=True)
class Answer:
    text: str
    refused: bool
    reason: str | None = None
    edge_id: int | None = None
    grounding: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Situation:
    text: str
    grounding: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Outcome:
    status: str  # skipped, forgot, stored, answered or situation
    stored: int = 0
    answer: Answer | None = None
    situation: Situation | None = None


class Engine:
    def __init__(self, spark: SparkSession, path: str, user_id: int = 1, clock: dt.datetime | None = None, explicit_only: bool = False) -> None:
        self.spark, self.user_id, self.explicit_only = spark, user_id, explicit_only
        self.store, self._frozen = EdgeStore(spark, path, buckets=8), clock
        self._recent: list[str] = []
        self._said: list[tuple] = []

    # clock
    def now(self) -> dt.datetime:
        return self._frozen or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)

    def freeze(self, at: dt.datetime) -> None:
        self._frozen = at

    def unfreeze(self) -> None:
        self._frozen = None

    # writing
    def _edges(self):
        return self.store.current(self.user_id)

    def _utterances(self, said: str, speaker: str, listener: str, at: dt.datetime, response: str | None, llm_id: str | None):
        row = [(self.user_id, said, speaker, listener, at, response, llm_id)]
        return ingest.two_pass(self.spark.createDataFrame(row, "user_id long, text string, speaker string, listener string, ts timestamp_ntz, model_response string, llm_id string"))

    def _before(self):
        """What has been said last, in which a person may have been named; in its order, though the clock may stand still."""
        n = len(self._said)
        rows = [(*r[:4], r[4] - dt.timedelta(microseconds=n - k), r[5]) for k, r in enumerate(self._said)]
        return self.spark.createDataFrame(rows, schemas.UTTERANCE) if rows else None

    def extract(self, said: str, speaker: str = "user", listener: str = "assistant") -> list[Row]:
        """What would be stored of a text; nothing is written."""
        return ingest.edges_of(self._utterances(said, speaker, listener, self.now(), None, None), self._before()).collect()

    def ingest(self, said: str, speaker: str = "user", listener: str = "assistant", at: dt.datetime | None = None, model_response: str | None = None, llm_id: str | None = None) -> int:
        """Store a text, and the response to it; the number of edges written."""
        turn = self._utterances(said, speaker, listener, at or self.now(), model_response, llm_id)
        made = ingest.edges_of(turn, self._before())
        rows = schemas.conform(made.withColumn("embedding", embedder()(F.col("source_text")))).collect()
        if rows:
            self.store.append(self.spark.createDataFrame(rows, schemas.EDGE))
        self._recent = [*self._recent, speaker][-10:]
        self._said = [*self._said, (self.user_id, said, speaker, listener, at or self.now(), "user")][-10:]
        anchors = {k: F.array(*[F.lit(float(x)) for x in hash_vector(v)]) for k, v in STYLE_ANCHORS.items()}
        style = turn.where("tag = 'user'").select("user_id", style_deltas(embedder()(F.col("text")), anchors, vector.dot).alias("d"))
        self.store.adapt(style.select("user_id", "d.warmth", "d.formality"))
        return len(rows)

    # reading
    def _question(self, question: str):
        q = self.spark.createDataFrame([(1, self.user_id, question, [float(x) for x in hash_vector(question)])], "query_id long, user_id long, text string, query_embedding array<float>")
        d = analyze.decomposed_query(F.col("text"))
        return q.withColumn("d", d).withColumn("p", analyze.parsed_question(F.col("text"))).select("query_id", "user_id", "text", "query_embedding", "d.wh", "d.return_field", "d.entity", "p.match_schema", "p.emotions", "p.subject", "p.predicate", "p.object")

    def _situational(self, question: str) -> bool:
        if self.explicit_only:
            return any(t in question.lower() for t in dims.EXPLICIT_TRIGGERS)
        return bool(self.spark.range(1).select(text.is_situational(F.lit(question))).first()[0])

    def retrieve(self, question: str) -> Answer | Situation:
        return self.situation(question) if self._situational(question) else self.lookup(question)

    def lookup(self, question: str) -> Answer:
        """The answer to a question, never a situation."""
        r = scoring.answered(self._edges(), self._question(question).drop("subject", "predicate", "object")).first()
        return Answer(r["answer"], r["refused"], r["reason"], r["edge_id"], list(r["grounding"] or []))

    def situation(self, question: str) -> Situation:
        asked = self._question(question).select(F.lit(1).alias("request_id"), "user_id", "entity")
        r = scoring.situation(self._edges(), asked).first()
        return Situation(r["situation"] or dims.REFUSAL, list(r["grounding"] or []))

    def forget(self, by: str, scope: object) -> int:
        return self.store.forget(self.user_id, by, scope, F.lit(self.now()))

    def clear(self, entity: str | None = None) -> int:
        return self.forget("entity", entity) if entity else self.forget("all", "")

    def show(self, facet: str, value: str | None = None, limit: int | None = 100, export_raw_text: bool = False) -> list[Row]:
        return scan.show(self._edges(), facet, value, limit, export_raw_text).collect()

    def trace(self, subject: str, predicate: str) -> list[Row]:
        return state.history(self._edges(), subject, predicate).collect()

    def check_proactive(self) -> list[Row]:
        # what has no date but that of the utterance is no event ahead
        dated = self._edges().where(~F.col("resolved_event_date").eqNullSafe(F.col("source_timestamp")))
        return scan.upcoming(dated, F.lit(self.now()).cast("timestamp_ntz")).collect()

    def profile(self) -> dict[str, float]:
        """The user's style, as their turns have moved it; what nothing has moved reads 0.5."""
        r = self.store.profiles(self.user_id).first()
        return {"warmth": 0.5, "formality": 0.5, "initiative": 0.5, "check_in_frequency": 0.5} | ({} if r is None else {"warmth": r["warmth"], "formality": r["formality"]})

    def timeline(self) -> list[Row]:
        return timeline.document(self._edges()).collect()

    def process(self, said: str, speaker: str = "user", listener: str = "assistant", at: dt.datetime | None = None, model_response: str | None = None) -> Outcome:
        """The front door: skip, forget, store, and answer a question that comes into a cold context."""
        if not said.strip():
            return Outcome("skipped")
        kind = self.spark.range(1).select(analyze.utterance_kind(F.lit(said))).first()[0]
        if kind == "backchannel":
            return Outcome("skipped")
        if kind == "command":
            target = forget_target(said)
            return Outcome("forgot", self.forget("entity", target)) if target else Outcome("skipped")
        asking = kind in ("question", "tag_question") and speaker not in self._recent[-5:]
        stored = self.ingest(said, speaker, listener, at, model_response)
        if not asking:
            return Outcome("stored", stored)
        found = self.retrieve(said)
        return Outcome("situation", stored, situation=found) if isinstance(found, Situation) else Outcome("answered", stored, answer=found)

    def status(self) -> list[dict[str, str]]:
        """A self-check of the store's view against the declared schema and the declared constraints."""
        edges = self._edges()
        found = schemas.problems(edges)
        broken = [{"check": r["constraint"], "status": "fail" if r["n"] else "ok"} for r in assertions.violations(edges).orderBy("constraint").collect()]
        return broken + [{"check": f.name, "status": "fail" if any(p.startswith(f"{f.name}:") for p in found) else "ok"} for f in schemas.EDGE.fields]


def forget_target(said: str) -> str | None:
    """The object of a command to forget."""
    words = [w for w, t in analyze.tagged(said) if t in ("NOUN", "PROPN")]
    low = said.lower()
    return words[-1] if words and any(k in low for k in ("forget", "delete", "remove")) else None


# a small dispatcher over the engine, for transports -------------------------------------------------------------------------------

TOOLS = ("ingest", "retrieve", "lookup", "situation", "forget", "clear", "show", "trace", "check_proactive", "profile", "process", "status", "timeline")
EXPOSED = ("process", "retrieve", "forget")


def plain(value: object) -> object:
    """A value as JSON can carry it."""
    if is_dataclass(value) and not isinstance(value, type):
        return plain(asdict(value))
    if isinstance(value, Row):
        return plain(value.asDict(recursive=True))
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return value.hex()
    return value


def dispatch(engine: Engine, method: str, params: dict | None = None) -> dict:
    """``initialize``, ``ping``, ``tools/list`` and ``tools/call``."""
    params = params or {}
    if method == "initialize":
        return {"serverInfo": {"name": "palimpsest"}, "capabilities": {"tools": {}}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [{"name": t} for t in EXPOSED]}
    if method == "tools/call":
        name = params.get("name")
        if name not in TOOLS:
            return {"error": {"code": -32601, "message": f"no tool {name!r}"}}
        return {"result": plain(getattr(engine, name)(**params.get("arguments", {})))}
    return {"error": {"code": -32601, "message": f"no method {method!r}"}}


_engines: dict[tuple[str, int], Engine] = {}


def respond(spark: SparkSession, path: str, said: str, user_id: int = 1, **options: object) -> Outcome:
    """One call: the user's engine is made once and processes the text."""
    engine = _engines.setdefault((path, user_id), Engine(spark, path, user_id))
    return engine.process(said, **options)
