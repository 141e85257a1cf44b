"""Command line: ``python -m chatloom COMMAND``, over a store folder (see ``chatloom.streaming.live``)."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F


def _load(args, spark, live) -> None:
    from chatloom.operators import store
    from chatloom.operators.search import postings
    from chatloom.session import cut_lineage
    from chatloom.sources.export import load_counts, load_exports, read_exports

    loaded = load_exports(spark, args.path, live.read("messages").drop("id"))
    loaded = cut_lineage(store.ensure_column(loaded, "id", "bigint"))
    live.write({"messages": loaded, "postings": postings(loaded)})
    load_counts(read_exports(spark, args.path)).show(truncate=False)


def _index(args, spark, live) -> None:
    from chatloom.streaming.live import flush, reindex

    done = flush(live, lookback_days=args.lookback, mode=args.labels) if args.update else reindex(live, mode=args.labels)
    print(f"{done['windows']} windows of {done['chats']} chats")


def _people(args, spark, live) -> None:
    from chatloom.operators import store
    from chatloom.operators.people import people_counts
    from chatloom.sources.export import read_mapping, write_template

    if args.mapping:
        old = live.read("people").withColumn("seq", F.lit(0))
        new = read_mapping(spark, args.mapping).withColumn("seq", F.lit(1))
        live.write({"people": store.merge_people(old.unionByName(new), "seq")})
    if args.template:
        write_template(store.sender_template(live.read("messages"), live.read("people")), args.template)
    people_counts(live.read("messages"), live.read("people")).show(truncate=False)


def _found(args, spark, live):
    from chatloom.streaming.engine import find

    return find(live, spark.createDataFrame([(1, args.question)], "qid bigint, question string"), args.now, args.chat, args.k, args.labels)


def _search(args, spark, live) -> None:
    from chatloom.functions.parsing import chat_link, excerpt, utc_day

    _, hits = _found(args, spark, live)
    shown = [F.round("score", 4).alias("score"), utc_day(F.col("ts_start")).alias("day"), chat_link(F.col("chat_id"), F.col("first_msg")).alias("link"), excerpt(F.col("text")).alias("text")]
    hits.orderBy("rank").select("rank", *shown).show(args.k or 10, truncate=False)


def _answer(args, spark, live) -> None:
    from importlib import import_module

    from chatloom.streaming.engine import ask

    module, _, name = args.model.partition(":")
    make_model = getattr(import_module(module), name)
    question = spark.createDataFrame([(1, args.question)], "qid bigint, question string")
    for r in ask(live, question, make_model, args.model, args.now, args.chat, args.k, args.labels, log=args.log).collect():  # one question
        print(r.answer)
        print(r.sources)


def _eval(args, spark, live) -> None:
    from chatloom.operators.search import recall
    from chatloom.streaming.engine import evaluate

    cases = spark.read.schema("question string, needles array<string>").json(args.cases).withColumn("qid", F.monotonically_increasing_id())
    results = evaluate(live, cases, args.k)
    results.orderBy("qid").show(1000, truncate=False)
    recall(results).show()


def main() -> None:
    parser = argparse.ArgumentParser(prog="chatloom", description="Load, index and search chat history.")
    parser.add_argument("--store", required=True, help="folder of the store")
    parser.add_argument("--checkpoints", help="folder of intermediate results, by default beside the store's tables")
    commands = parser.add_subparsers(dest="command", required=True)
    load = commands.add_parser("load", help="load JSON exports")
    load.add_argument("path")
    load.set_defaults(run=_load)
    index = commands.add_parser("index", help="build the windows, or only what changed")
    index.add_argument("--update", action="store_true")
    index.add_argument("--lookback", type=int, default=14, help="days, with --update")
    index.add_argument("--labels", choices=("name", "id", "export"), default="name")
    index.set_defaults(run=_index)
    people = commands.add_parser("people", help="import a name mapping, write a template")
    people.add_argument("--mapping")
    people.add_argument("--template")
    people.set_defaults(run=_people)
    asking = argparse.ArgumentParser(add_help=False)
    asking.add_argument("question")
    asking.add_argument("-k", type=int, default=10)
    asking.add_argument("--chat", type=int, action="append")
    asking.add_argument("--labels", choices=("name", "id", "export"), default="name")
    asking.add_argument("--now", type=int, help="epoch seconds that time phrases are read against")
    search = commands.add_parser("search", parents=[asking], help="the best windows for a question")
    search.set_defaults(run=_search)
    answer = commands.add_parser("answer", parents=[asking], help="an answer with its sources")
    answer.add_argument("--model", required=True, help="MODULE:FUNCTION that makes a callable of (system, prompt)")
    answer.add_argument("--log", help="folder of the query log")
    answer.set_defaults(run=_answer)
    evaluate = commands.add_parser("eval", help="success at k of golden cases, JSON lines of question and needles")
    evaluate.add_argument("cases")
    evaluate.add_argument("-k", type=int, default=10)
    evaluate.set_defaults(run=_eval)
    args = parser.parse_args()

    from chatloom.session import get_session, ship_package
    from chatloom.streaming.live import VersionedStore

    spark = get_session(**{"spark.checkpoint.dir": args.checkpoints or f"{args.store}/checkpoints"})
    ship_package(spark)
    args.run(args, spark, VersionedStore(spark, args.store))


if __name__ == "__main__":
    main()
