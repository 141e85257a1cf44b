"""Questions against a live store: what is new is indexed, the question is read, searched, answered and logged in one call."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions import parsing as P
from chatloom.operators import answers, search
from chatloom.operators.people import asked_speakers, known_names
from chatloom.session import cut_lineage
from chatloom.sources.export import append_query_log
from chatloom.streaming.live import DIM, VersionedStore, flush


def read_questions(questions: DataFrame, names: DataFrame, now: int | None = None) -> DataFrame:
    """``questions`` with what they ask for: question (standing alone), start, end, label, speaker.

    ``questions``: qid, question, and optionally prior (the question before) and
    force. Time phrases are read against ``now``; without it none is.
    """
    prior = F.col("prior") if "prior" in questions.columns else F.lit(None).cast("string")
    force = F.col("force") if "force" in questions.columns else False
    alone = questions.withColumn("question", P.standalone(F.col("question"), prior, force)).drop("prior", "force")
    span = P.time_range(F.col("question"), F.lit(now).cast("bigint")) if now is not None else F.lit(None).cast("struct<start:bigint,end:bigint,label:string>")
    timed = alone.withColumn("__r", span).withColumns({"start": F.col("__r.start"), "end": F.col("__r.end"), "label": F.col("__r.label")}).drop("__r")
    speakers = asked_speakers(alone.select(F.col("qid").alias("id"), F.col("question").alias("text")), names)
    return timed.join(speakers.withColumnRenamed("id", "qid"), "qid", "left")


def find(
    live: VersionedStore, questions: DataFrame, now: int | None = None, chats: list[int] | None = None, top_k: int = 0, mode: str = "name", encoder: Callable | None = None, fresh: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(questions as read, hits): the best windows of each question, by the store's own index and vectors.

    ``fresh``: messages that came since the last time are windowed before. An
    allow-list of chats holds for all questions; an empty one finds nothing.
    """
    if fresh:
        flush(live, chats=chats, mode=mode, encoder=encoder)
    messages = live.read("messages")
    asked = read_questions(questions, known_names(live.read("people"), messages, mode), now)
    if chats is not None:
        asked = asked.withColumn("chats", F.array(*[F.lit(c).cast("bigint") for c in chats]).cast("array<bigint>"))
    asked = cut_lineage(search.encode_texts(asked, DIM, "question", encoder=encoder, prefix=search.QUERY))
    index = live.read("postings")
    hits = search.hybrid_search(asked, messages, live.read("windows"), live.read("vectors").select("window_id", "vec"), top_k, index=index, size=search.kept_size(messages, index))
    return asked, cut_lineage(hits)


def ask(
    live: VersionedStore, questions: DataFrame, make_model: Callable, model_name: str = "", now: int | None = None, chats: list[int] | None = None, top_k: int = 0,
    mode: str = "name", encoder: Callable | None = None, log: str | None = None, fresh: bool = True,
) -> DataFrame:
    """The answers (see ``answers.answer``) to a batch of questions; each is logged under ``log``."""
    asked, hits = find(live, questions, now, chats, top_k, mode, encoder, fresh)
    said = cut_lineage(answers.answer(asked.select("qid", "question"), hits, make_model, model_name))
    if log:
        append_query_log(answers.log_rows(said, int(time.time()), chats), log)
    return said


def evaluate(live: VersionedStore, cases: DataFrame, top_k: int = 0, now: int | None = None, encoder: Callable | None = None) -> DataFrame:
    """(qid, question, hit) of golden cases (qid, question, needles): whether all needles are in the hits' texts."""
    _, hits = find(live, cases.select("qid", "question"), now, None, top_k, encoder=encoder, fresh=False)
    return search.success_at_k(hits, cases).join(cases.select("qid", "question"), "qid")
