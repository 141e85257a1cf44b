"""Answers to batches of questions: prompts from hits, a model call per question, citations and a log row.

The model is one callable of (system, prompt) that the caller injects; it is
made once per task by ``make_model``, so that clients need not be serialised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions import parsing as P

# fixed value: the reply to a question without hits
NOT_FOUND = "I couldn't find that in the chat history."
INSTRUCTIONS = (
    "You answer questions about a chat from numbered excerpts. Use nothing but the excerpts. Mark what you take from excerpt n with [Wn]. "
    f'If they do not hold the answer, reply exactly: "{NOT_FOUND}" Be brief, and answer in the language of the question.'
)


def prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, question, hits, prompt): a row per question; hits in order of rank, prompt null where there are none."""
    columns = ["rank", "window_id", "chat_id", "first_msg", "ts_start", "speakers", "text"]
    listed = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("hits"))
    joined = questions.select("qid", "question").join(listed, "qid", "left")
    prompt = F.concat(F.lit("Excerpts:\n\n"), P.context_block(F.col("hits")), F.lit("\n\n---\nQuestion: "), F.col("question"))
    return joined.withColumn("prompt", F.when(F.size("hits") > 0, prompt))


def answer(questions: DataFrame, hits: DataFrame, make_model: Callable[[], Callable[[str, str], str]], model_name: str = "", batch: int = 32) -> DataFrame:
    """qid, question, answer, window_ids, cited_ids, sources, display, latency_ms, model: a row per question.

    Questions without hits get the fixed reply and don't reach the model. The
    number of calls in flight is that of the tasks.
    """
    asked = prompts(questions, hits)
    asked = asked.withColumn("hits", F.coalesce("hits", F.array().cast(asked.schema["hits"].dataType)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
    at = asked.columns.index("prompt")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        model = None
        for whole in batches:
            for low in range(0, whole.num_rows, batch):
                part = whole.slice(low, batch)
                texts, took = [], []
                for prompt in part.column(at).to_pylist():
                    began = time.monotonic()
                    if prompt is None:
                        texts.append(NOT_FOUND)
                    else:
                        model = model or make_model()
                        texts.append(model(INSTRUCTIONS, prompt))
                    took.append(int((time.monotonic() - began) * 1000))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array(took, pa.int64())], names=[*part.schema.names, "answer", "latency_ms"])

    said = asked.mapInArrow(fn, fields + ", answer string, latency_ms bigint")
    n, cited = F.size("hits"), P.cited(F.col("answer"), F.size("hits"))
    ids = F.transform("hits", lambda h: h["window_id"])
    return said.select(
        "qid", "question", "answer", ids.alias("window_ids"), F.transform(cited, lambda i: F.element_at(ids, i)).alias("cited_ids"),
        P.source_numbers(cited, n).alias("source_numbers"), P.sources_block(F.col("hits"), cited).alias("sources"),
        P.linked_answer(F.col("answer"), F.col("hits")).alias("display"), "latency_ms", F.lit(model_name).alias("model"),
    )


def log_rows(answers: DataFrame, ts, chat_ids=None) -> DataFrame:
    """The answers as rows of the query log."""
    chats = F.lit(None).cast("array<bigint>") if chat_ids is None else F.array(*[F.lit(c).cast("bigint") for c in chat_ids])
    return answers.select(F.lit(ts).cast("bigint").alias("ts"), "question", chats.alias("chat_ids"), "window_ids", "cited_ids", "latency_ms", "model")
