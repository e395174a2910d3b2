"""Command line: ``python -m heronry.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="heronry")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *args: tuple[str, dict]) -> None:
        c = sub.add_parser(name, help=about)
        for flag, options in args:
            c.add_argument(flag, **options)

    need = {"required": True}
    command("extract", "fields of stored pages (Parquet with page_id, url, html, or a corpus folder)", ("--pages", need), ("--out", need), ("--corpus", {"action": "store_true"}), ("--canonical", {"action": "store_true"}))
    command("extract-url", "fetch one address and print its fields", ("--url", need))
    command("extract-urls", "fetch the addresses in a text file and write their fields", ("--file", need), ("--out", need))
    command("list-urls", "the addresses in a text file", ("--file", need))
    command("spider", "fetch the addresses in a text file, into a table or the entries of a corpus", ("--file", need), ("--out", need), ("--corpus", {"action": "store_true"}), ("--overwrite", {"action": "store_true"}))
    command("clean", "empty the corpus entries of the addresses in a text file", ("--file", need), ("--corpus", need))
    command("summary", "the progress report of a status table", ("--table", need))
    command("fetch-notes", "read new notes of a feed", ("--feed", need), ("--table", need), ("--checkpoint", need), ("--page-size", {"type": int, "default": 100}))
    command("move-cursor", "move a cursor over the notes with valid addresses", ("--notes", need), ("--cursors", need), ("--role", need), ("--by", {"type": int, "required": True}))
    command("show-cursors", "the cursors of a log", ("--root", need))
    command("set-cursor", "create or update a cursor of a log", ("--root", need), ("--role", need), ("--note", need), ("--number", {"type": int, "required": True}))
    command("lock-cursor", "lock or release a cursor of a log", ("--root", need), ("--role", need), ("--release", {"action": "store_true"}))
    command("run-extraction", "extract the next notes after the cursor", ("--notes", need), ("--pages", need), ("--root", need), ("--limit", {"type": int, "default": 0}), ("--post-to", {}))
    command("monitor", "the progress report of a log, printed and perhaps posted", ("--root", need), ("--post-to", {}), ("--to", {"nargs": "*", "default": []}))
    command("schedule", "the next times of a schedule", ("text", {}), ("--count", {"type": int, "default": 5}))
    command("check-labels", "fields found in extraction records", ("--records", need))
    command("preflight", "whether a session starts and can write to its shared folder", ("--folder", need))
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    from heronry.operators import state, summary
    from heronry.plans.extraction import canonical_fields, extract_fields
    from heronry.session import session
    from heronry.sources import corpus, entries, feeds
    from heronry.streaming import loops

    spark = session(f"heronry {args.command}")
    if args.command == "extract":
        pages = corpus.read_pages(spark, args.pages) if args.corpus else spark.read.parquet(args.pages)
        (canonical_fields if args.canonical else extract_fields)(pages).write.mode("overwrite").parquet(args.out)
    elif args.command in ("extract-url", "extract-urls"):
        urls = spark.createDataFrame([(args.url,)], "url string") if args.command == "extract-url" else corpus.url_list(corpus.read_lines(spark, args.file))
        fetched = feeds.fetch(urls).select(F.monotonically_increasing_id().alias("page_id"), F.coalesce("response_url", "url").alias("url"), "status", F.col("body").alias("html"))
        if args.command == "extract-urls":
            canonical_fields(fetched).write.mode("overwrite").parquet(args.out)
        else:
            for row in canonical_fields(fetched).toLocalIterator():
                print(row["name"], row.value, sep="\t")
    elif args.command == "list-urls":
        for row in corpus.url_list(corpus.read_lines(spark, args.file)).toLocalIterator():
            print(row.url)
    elif args.command == "spider":
        fetched = feeds.fetch(corpus.url_list(corpus.read_lines(spark, args.file)))
        if args.corpus:
            print(entries.save_responses(fetched, args.out, args.overwrite).where("written").count(), "files written")
        else:
            fetched.write.mode("overwrite").parquet(args.out)
    elif args.command == "clean":
        urls = corpus.url_list(corpus.read_lines(spark, args.file)).select(corpus.entry_dir(F.col("url")).alias("entry"))
        print(entries.clean_entries(urls, args.corpus).where("written").count(), "entries emptied")
    elif args.command in ("show-cursors", "set-cursor", "lock-cursor"):
        log = loops.Log(spark, f"{args.root}/cursors", loops.CURSORS, ["role"])
        following = (log.rows().agg(F.max("batch")).first()[0] or 0) + 1
        if args.command == "set-cursor":
            log.append(spark.createDataFrame([(args.role, args.note, args.number, "available")], loops.CURSORS), following)
        elif args.command == "lock-cursor":
            log.append(state.lock_cursor(log.now().where(F.col("role") == args.role), args.role, not args.release), following)
        for row in log.now().orderBy("role").toLocalIterator():
            print(row.role, row.noteId, row.noteNumber, row.lockStatus, sep="\t")
    elif args.command == "run-extraction":
        batch = (loops.Log(spark, f"{args.root}/cursors", loops.CURSORS, ["role"]).rows().agg(F.max("batch")).first()[0] or 0) + 1
        changed = loops.extraction_run(spark, spark.read.parquet(args.notes), spark.read.parquet(args.pages), args.root, args.limit, batch, bool(args.post_to))
        if args.post_to:
            service = feeds.Service(args.post_to)
            failed = feeds.post(feeds.outbox(changed, "heronry"), service.post_edit).where("control is not null").count()
            print(failed, "edits failed")
        print(changed.count(), "fields changed")
    elif args.command == "monitor":
        status = loops.Log(spark, f"{args.root}/url_status", loops.URL_STATUS, ["id"]).now()
        report = summary.status_report(status.withColumns({"validResponseUrl": F.col("response").isNotNull(), "updatedAt": F.current_timestamp()})).first().report
        print(report)
        if args.post_to:
            feeds.Service(args.post_to).post_message("Extraction report", report, args.to)
    elif args.command == "schedule":
        from datetime import datetime

        from heronry.operators.schedule import explain, parse_schedule

        if wrong := explain(args.text):
            print("\n".join(wrong))
            return 1
        print("\n".join(t.isoformat(" ") for t in parse_schedule(args.text).next_times(datetime.now(), args.count)))
    elif args.command == "summary":
        print(summary.status_report(spark.read.parquet(args.table)).first().report)
    elif args.command == "fetch-notes":
        from heronry.streaming.loops import run_available

        feeds.register_note_feed(spark)
        stream = spark.readStream.format("notes").option("url", args.feed).option("pageSize", args.page_size).load()
        run_available(stream, lambda batch, number: corpus.write_once(batch, args.table, ["id"], number), args.checkpoint).awaitTermination()
    elif args.command == "move-cursor":
        cursors = spark.read.parquet(args.cursors).filter(F.col("role") == args.role)
        state.move_cursor(spark.read.parquet(args.notes), cursors, args.by).show()
    elif args.command == "check-labels":
        for row in corpus.label_report(corpus.read_extraction_records(spark, args.records)).orderBy("kind", "field").toLocalIterator():
            print(*row, sep="\t")
    elif args.command == "preflight":
        spark.range(10).write.mode("overwrite").parquet(f"{args.folder}/preflight")
        print("ok", spark.read.parquet(f"{args.folder}/preflight").count())
    return 0


if __name__ == "__main__":
    sys.exit(main())
