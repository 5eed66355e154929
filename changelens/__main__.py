"""python -m changelens <command>: init, reset, seed, add, list, evaluate, scan, graph, analytics, digest over Parquet tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import analytics, digest, evaluate, pipeline
from .schema import TABLES
from .sources import captures as sources
from .sources import edits


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="changelens")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, arguments in (("init", ["store"]), ("reset", ["store"]), ("seed", ["store", "captures"]), ("graph", []), ("add", ["store", "name", "website_url", "as_of"]), ("list", ["store"]), ("evaluate", ["pairs", "out"]), ("scan", ["captures", "store"]), ("analytics", ["store", "as_of"]), ("digest", ["store", "start", "end"])):
        own = commands.add_parser(name)
        for a in arguments:
            own.add_argument(a)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("changelens").getOrCreate()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    keep = (lambda df: df.checkpoint()) if shared else (lambda df: df.persist())
    if args.command == "init":
        sources.create_tables(spark, args.store)
    elif args.command == "reset":
        for name in TABLES:
            for at in (f"{args.store}/{name}", f"{args.store}/{name}__merged", f"{args.store}/{name}__new"):
                path = spark._jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        sources.create_tables(spark, args.store)
    elif args.command == "seed":
        # Captures day by day: a baseline, then what changed, each through the whole pipeline.
        captures = spark.read.parquet(args.captures)
        names = sources.read_table(spark, args.store, "competitors")
        for (day,) in captures.select(F.to_date("timestamp").alias("day")).distinct().orderBy("day").collect():
            pipeline.scan_store(captures.filter(F.to_date("timestamp") == day), names, pipeline.Stores.at(spark, args.store), keep)
            print(day)
    elif args.command == "graph":
        print("\n".join(f"{step}" for step in pipeline.STEPS))
    elif args.command == "add":
        wanted = spark.createDataFrame([(args.name, args.website_url, "")], "name string, website_url string, description string")
        row = edits.new_competitors(sources.read_table(spark, args.store, "competitors"), wanted, args.as_of).first()
        if row is None:
            parser.exit(1, "the name is taken or the URL is not safe\n")
        sources.append(spark.createDataFrame([row]), args.store, "competitors")
        print(row.id)
    elif args.command == "list":
        analytics.list_competitors(sources.read_table(spark, args.store, "competitors")).select("id", "name", "website_url", "active", "tracking_frequency").show(200, truncate=False)
    elif args.command == "evaluate":
        changes = evaluate.evaluate_pairs(spark.read.parquet(args.pairs))
        changes.write.mode("overwrite").parquet(args.out)
        changes = spark.read.parquet(args.out)
        pages = evaluate.page_funnel(changes, ["pair_id"]).withColumns({"status": F.lit("completed"), "url": F.col("pair_id").cast("string")})
        categories = changes.filter(~F.col("is_noise")).groupBy(F.col("category").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name")
        print(evaluate.format_report(evaluate.merge_report(pages), pages, categories))
    elif args.command == "scan":
        found = pipeline.scan_store(spark.read.parquet(args.captures), sources.read_table(spark, args.store, "competitors"), pipeline.Stores.at(spark, args.store), keep)
        found.groupBy("status").count().orderBy("status").show()
    elif args.command == "analytics":
        tables = {n: sources.read_table(spark, args.store, n) for n in ("competitors", "changes")}
        for name, report in analytics.analytics_payload(tables["competitors"], tables["changes"], args.as_of, keep=keep).items():
            print(name)
            report.show(50, truncate=False)
    else:
        tables = {n: sources.read_table(spark, args.store, n) for n in ("intelligence", "competitors", "changes")}
        row = digest.generate(tables["intelligence"], tables["competitors"], tables["changes"], args.start, args.end)
        sources.append(row, args.store, "digests")
        print(row.first().content)


if __name__ == "__main__":
    main()
