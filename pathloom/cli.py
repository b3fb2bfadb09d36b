"""A thin command line: one-shot search, line filter, largest files, index builds."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from . import config as settings
from .operators.rank import big_files
from .plans.search import Corpus, filter_lines, script_search
from .sources.documents import TextCache, read_texts
from .sources.lines import from_lines, hits_as_lines, utf8_lines
from .sources.scratch import stored
from .sources.semantic_store import SemanticStore
from .sources.snapshot import SnapshotStore
from .sources.walk import walk_stats, walked

VERSION, CONFIG = "0.1.0", "~/.config/pathloom/config.toml"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="pathloom", description="Search file corpora.")
    one = out.add_mutually_exclusive_group()
    one.add_argument("-V", "--version", action="version", version=VERSION)
    one.add_argument("-p", "--print", dest="query", nargs=argparse.REMAINDER, help="print the hits of a query, which is all that follows")
    one.add_argument("--pick", nargs=argparse.REMAINDER, help="print the best hit of a query")
    one.add_argument("--filter", nargs=argparse.REMAINDER, help="search lines of standard input")
    one.add_argument("--big", nargs="?", const=20, type=int, help="the largest files")
    one.add_argument("--reindex", action="store_true", help="walk the roots again")
    one.add_argument("--index-semantic", action="store_true", help="embed documents that are new or changed")
    out.add_argument("--config", nargs="?", const="", default=CONFIG, help="the configuration file; without a path and a command, prints where it is")
    return out


def reindex(spark: SparkSession, store: SnapshotStore, conf: settings.EngineConfig) -> str:
    began = time.monotonic()
    rows = walked(spark, conf.expanded_roots(), conf.excludes, app_folders=[settings.expand(f) for f in settings.APP_FOLDERS] if conf.index_apps else [])
    store.publish(rows.where("state = 'found'").select("path", "mtime", "size"))
    stats = walk_stats(rows).first()
    unread = f" ({stats.skipped} unreadable)" if stats.skipped else ""
    return f"indexed {store.load().count()} files in {time.monotonic() - began:.1f} s{unread}"


def index_semantic(spark: SparkSession, store: SnapshotStore, chunks: SemanticStore, cache: TextCache | None = None) -> str:
    """Migrates an older chunk store, or embeds what is new or changed; everything is counted in what was written."""
    from .operators.semantic import built, eligible

    if chunks.needs_migration():
        facts = chunks.migrate()
        return f"semantic index migrated: {facts['docs']} documents, {facts['chunks']} chunks"
    texts = read_texts(spark, store.load().where(eligible()), cache).select("path", "mtime", "size", "text")
    texts = spark.read.schema(texts.schema).parquet(stored(texts, "texts"))  # read twice below, extracted once
    rows, counts = built(texts, chunks.load())
    facts = chunks.publish(rows)
    by = {r.status: r["count"] for r in counts.collect()}
    return f"{facts['docs']} documents, {facts['chunks']} chunks: {by.get('embedded', 0)} embedded, {by.get('reused', 0)} unchanged, {by.get('skipped', 0)} unreadable"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code: 0 with hits, 1 without, 2 on errors."""
    args = parser().parse_args(argv)
    try:
        words = next((w for w in (args.query, args.pick, args.filter) if w is not None), None)
        text = " ".join(words or [])
        if args.query is not None and not text:
            raise ValueError("-p needs a query")
        conf = settings.load_or_create(args.config or CONFIG)
        if args.config == "":
            print(settings.expand(CONFIG))
            return 0
        spark = spark or SparkSession.builder.appName("pathloom").getOrCreate()
        home = settings.expand(conf.index_dir)
        store, chunks, cache = SnapshotStore(spark, f"{home}/files"), SemanticStore(spark, f"{home}/chunks"), TextCache(spark, f"{home}/texts")
        if args.reindex:
            print(reindex(spark, store, conf))
            return 0
        if args.filter is not None:
            rows = filter_lines(spark, from_lines(spark, utf8_lines(getattr(sys.stdin, "buffer", sys.stdin))), text, int(time.time())).orderBy("rank").collect()
            print("\n".join(r.path for r in rows))
            return int(not rows)
        if store.load() is None:
            reindex(spark, store, conf)
        files = store.load()
        if args.index_semantic:
            print(index_semantic(spark, store, chunks, cache))
            return 0
        if args.big is not None:
            from .functions.columns import human_size
            from pyspark.sql import functions as F

            for r in big_files(files, args.big).select(human_size(F.col("size")).alias("shown"), "path", "rank").orderBy("rank").collect():
                print(f"{r.shown:>10}  {r.path}")
            return 0
        if args.query is not None or args.pick is not None:
            now = int(time.time())
            texts = read_texts(spark, files.where("path not like '%/'"), cache) if text.startswith(">") else None
            rows, every = script_search(spark, Corpus(files, texts, chunks.load(), quiet=tuple(conf.quiet), max_bytes=conf.max_content_filesize), text, now)
            if args.pick is not None:
                best = every.orderBy("rank").select("path").take(1) if "rank" in every.columns else every.select("path").take(1)
                print("\n".join(r.path for r in best))
                return int(not best)
            for r in hits_as_lines(rows).toLocalIterator():
                print(r.value)
            return int(not every.take(1))
        parser().print_help()
        return 0
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
