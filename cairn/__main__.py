"""``spark-submit`` entry points over stores, reports and traces."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from cairn.operators import evaluation, reports, text_index
from cairn.plans import evaluate, ingest, retrieve
from cairn.sources import files, sinks


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="cairn", description=__doc__)
    command = parser.add_subparsers(dest="command", required=True)

    def add(name: str, what: str, *names: str) -> argparse.ArgumentParser:
        one = command.add_parser(name, help=what)
        for n in names:
            one.add_argument(n)
        return one

    add("ingest", "text files below a folder into a store", "root", "store").add_argument("--kb", default="default")
    add("remove", "all that a store holds of a source", "store", "source_path").add_argument("--kb", default="default")
    add("search", "BM25 over a store's chunks", "store", "query").add_argument("--top", type=int, default=10)
    contexts = add("contexts", "the contexts of a query, by a store's chunks, pages and indexes", "store", "query")
    contexts.add_argument("--kb", default="default")
    add("evaluate", "metrics of an answered dataset", "dataset", "report")
    reported = add("reports", "summaries of stored reports over the results of some knowledge bases", "folder")
    reported.add_argument("--traces", help="Parquet with trace_id and kb_id")
    reported.add_argument("--kbs", nargs="+", help="bases to be seen; all, if left out")
    add("diagnose", "findings of traces, as Parquet, by category", "traces")
    add("replay", "what differs between two runs, as Parquet", "original", "replayed")
    add("vacuum", "removes what no publication of a store names", "store")
    return parser


def main(argv: list[str] | None = None) -> None:
    given = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("cairn").getOrCreate()
    shown = 1000
    if given.command == "ingest":
        documents, chunks = ingest.run(spark, given.root, given.store, given.kb)
        # later changes keep index and pages; only a new store has them built
        if ingest.read_index(spark, given.store) is None:
            ingest.index_chunks(spark, given.store)
        if sinks.entry(spark, f"{given.store}/pages") is None:
            ingest.compile_pages(spark, given.store)
        print(f"{documents} documents, {chunks} chunks")
    elif given.command == "remove":
        ingest.remove_source(spark, given.store, given.source_path, given.kb)
    elif given.command == "search":
        asked = spark.createDataFrame([(0, given.query)], "query_id long, query string")
        text_index.search(ingest.read_index(spark, given.store), asked, given.top).orderBy("rank").show(given.top, False)
    elif given.command == "contexts":
        asked = spark.createDataFrame([(0, given.query, given.kb)], "query_id long, query string, kb_id string")
        retrieve.from_store(spark, given.store, asked)["contexts"].orderBy("position").select("citation_label", "chunk_id", "text").show(shown, False)
    elif given.command == "reports":
        none = spark.createDataFrame([], "trace_id string, kb_id string")
        traces = none if given.traces is None else spark.read.parquet(given.traces)
        allowed = None if given.kbs is None else spark.createDataFrame([(k,) for k in given.kbs], "kb_id string")
        reports.scoped_reports(spark, given.folder, traces, allowed).orderBy("path").show(shown, False)
    elif given.command == "diagnose":
        evaluation.category_counts(evaluation.diagnose_traces(spark.read.parquet(given.traces))).orderBy("category").show(shown, False)
    elif given.command == "replay":
        evaluation.replay_diff(spark.read.parquet(given.original), spark.read.parquet(given.replayed)).orderBy("trace_id").show(shown, False)
    elif given.command == "vacuum":
        print(f"{sinks.vacuum(spark, given.store)} segments removed")
    else:
        sinks.save_report(evaluate.run(files.read_dataset(spark, given.dataset))["aggregate"], given.report)


if __name__ == "__main__":
    main()
