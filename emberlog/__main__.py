"""Command line of a store: `python -m emberlog <path> <command> ...`."""

from __future__ import annotations

import argparse
import json
import sys
import time


def value_of(text: str) -> bytes:
    """`-` reads standard input, `@file` a file, `hex:...` digits; anything else is taken as it is."""
    if text == "-":
        return sys.stdin.buffer.read()
    if text.startswith("@"):
        with open(text[1:], "rb") as f:
            return f.read()
    return bytes.fromhex(text[4:]) if text.startswith("hex:") else text.encode()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="emberlog")
    p.add_argument("path")
    p.add_argument("--now", type=int, default=None, help="Unix seconds that expiries are held against")
    c = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple):
        sub = c.add_parser(name)
        for a, kw in args:
            sub.add_argument(a, **kw)

    key = ("--key", {"required": True})
    ident = ("--id", {"required": True})
    command("init", ("--buckets", {"type": int, "default": 128}), ("--option", {"action": "append", "default": [], "help": "name=value of a store's options"}))
    command("put", key, ("--value", {"required": True}), ("--expires-at", {"type": int, "default": 0}))
    command("get", key, ("--out", {}))
    command("exists", key)
    command("del", key)
    command("batch", ("--ops", {"required": True, "help": "a JSON array, or @file"}))
    command("scan", ("--prefix", {"default": ""}), ("--text", {"action": "store_true"}))
    command("status")
    command("doctor", ("--pages", {"required": True, "help": "a segment or a folder of them"}), ("--page-size", {"type": int, "default": 65536}), ("--strict", {"action": "store_true"}))
    command("sweep")
    command("checkpoint")
    command("tde-rotate", ("--kid", {"required": True}))
    command("compact", ("--bucket", {"type": int}), ("--forget", {"type": int, "default": 0, "help": "LSN up to which tombstones may go"}))
    command("vacuum", ("--all", {"action": "store_true", "help": "compact and sweep, too"}))
    command("auto-maint", ("--max-buckets", {"type": int, "default": 32}), ("--sweep", {"action": "store_true"}))
    command("bloom", ("--bytes", {"type": int, "default": 4096}), ("--hashes", {"type": int, "default": 6}))
    command("report", ("--bucket", {"type": int}))
    command("snapshot-create", ("--message", {"default": ""}), ("--label", {"action": "append"}), ("--parent", {}))
    command("snapshot-list")
    command("snapshot-inspect", ident)
    command("snapshot-restore", ident, ("--to", {"required": True}), ("--verify", {"action": "store_true"}))
    command("snapshot-delete", ident)
    command("cdc-ship", ("--since-lsn", {"type": int, "default": 0}), ("--to", {"required": True}))
    command("cdc-apply", ("--from", {"required": True, "dest": "source"}))
    return p


def run(spark, args: argparse.Namespace, out=print) -> int:
    from pyspark.sql import functions as F

    from emberlog.config import Config
    from emberlog.operators import compaction, integrity, reads
    from emberlog.sources import pages
    from emberlog.store import SHIPPED, Store

    now = int(time.time()) if args.now is None else args.now
    if args.command == "init":
        try:
            Store.create(spark, args.path, config=Config.of({"buckets": str(args.buckets)} | dict(x.split("=", 1) for x in args.option)))
        except FileExistsError:
            out("exists already")
        return 0
    s = Store(spark, args.path)
    lines = lambda df: [out(json.dumps(r.asDict(), default=str)) for r in df.toLocalIterator()]
    match args.command:
        case "put":
            out(json.dumps({"lsn": s.put(args.key.encode(), value_of(args.value), args.expires_at)}))
        case "get":
            value = s.get(args.key.encode(), now)
            if value is None:
                out("NOT FOUND")
                return 1
            if args.out:
                with open(args.out, "wb") as f:
                    f.write(value)
            else:
                out(value.decode("utf-8", "backslashreplace"))
        case "exists":
            found = s.exists(args.key.encode(), now)
            out("FOUND" if found else "NOT FOUND")
            return int(not found)
        case "del":
            out("DELETED" if s.delete(args.key.encode(), now) else "was not there")
        case "batch":
            out(json.dumps({"lsn": s.batch_json(value_of(args.ops).decode())}))
        case "scan":
            form = reads.scan_text if args.text else reads.scan_json
            for r in reads.stream(form(s.scan(now, args.prefix.encode()))):
                out(r.line)
        case "status":
            out(s.status_json(now))
        case "doctor":
            pages.register(spark)
            images = spark.read.format("kvpages").option("page_size", args.page_size).load(args.pages)
            lines(integrity.doctor(images, args.strict))
        case "checkpoint":
            out(json.dumps({"removed": s.checkpoint(), "last_lsn": s.last()[1]}))
        case "tde-rotate":
            out(json.dumps({"kid": args.kid, "since_lsn": s.rotate(args.kid)}))
        case "sweep":
            out(json.dumps({"overflow_pages_freed": s.sweep()}))
        case "compact":
            told = s.report(now) if args.bucket is None else s.report(now).where(f"bucket = {args.bucket}")
            said = compaction.summary(told).first().asDict() if args.bucket is None else next((r.asDict() for r in told.collect()), {})
            out(json.dumps({"generation": s.compact(now, forget=args.forget, buckets=None if args.bucket is None else [args.bucket])} | said))
        case "vacuum":
            out(json.dumps(s.vacuum_all(now) if args.all else {"dropped": s.vacuum()}))
        case "auto-maint":
            out(json.dumps(s.auto_maintenance(now, args.max_buckets, args.sweep)))
        case "bloom":
            s.rebuild_bloom(now, args.bytes, args.hashes)
            out(s.bloom_state())
        case "report":
            lines(s.report(now) if args.bucket is None else s.report(now).where(f"bucket = {args.bucket}"))
        case "snapshot-create":
            out(s.snapshot(args.message, args.label, args.parent, now * 1000))
        case "snapshot-list":
            lines(s.snapshots().select("id", "message", "lsn"))
        case "snapshot-inspect":
            out(json.dumps(s.inspect(args.id)))
        case "snapshot-restore":
            s.restore(args.id, args.to, args.verify)
        case "snapshot-delete":
            s.drop_snapshot(args.id)
        case "cdc-ship":
            rows = s.ship(args.since_lsn)
            rows.write.mode("append").parquet(args.to)
            n, size, last = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)), F.coalesce(F.max("lsn"), F.lit(0))).first()
            out(json.dumps({"rows": n, "bytes": size, "last_lsn": last}))
        case "cdc-apply":
            out(json.dumps({"last_lsn": s.apply(spark.read.schema(SHIPPED).parquet(args.source))}))
    return 0


def main() -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args()
    spark = SparkSession.builder.appName("emberlog").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
