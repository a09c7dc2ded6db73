"""Command line: python -m cinelake STORE {list,write,read,delete,vacuum,compact,evict} ..."""

from __future__ import annotations

import argparse
import re

from pyspark.sql import SparkSession

from cinelake.engine import Store


def _numbers(pattern: str):
    def parse(text: str) -> tuple[int, ...]:
        found = re.fullmatch(pattern, text)
        if not found:
            raise argparse.ArgumentTypeError(f"{text!r} is not like {pattern}")
        return tuple(map(int, found.groups()))

    return parse


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cinelake")
    top.add_argument("store")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("list", "vacuum", "compact", "evict"):
        sub.add_parser(name)
    sub.add_parser("delete").add_argument("name")
    resolution = _numbers(r"(\d+)x(\d+)")
    write = sub.add_parser("write")
    write.add_argument("name")
    write.add_argument("path")
    write.add_argument("--resolution", type=resolution, required=True, help="height x width")
    write.add_argument("--fps", type=int, default=30)
    read = sub.add_parser("read")
    read.add_argument("name")
    read.add_argument("out", help="folder for frames as Parquet")
    read.add_argument("--resolution", type=resolution)
    read.add_argument("--roi", type=_numbers(r"(\d+):(\d+):(\d+):(\d+)"), help="y0:x0:y1:x1")
    read.add_argument("--times", type=_numbers(r"(\d+)-(\d+)"), help="seconds")
    read.add_argument("--codec", choices=("h264", "hevc", "rgb"), default="rgb")
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    store = Store(SparkSession.builder.appName("cinelake").getOrCreate(), a.store)
    if a.command == "list":
        for row in store.list().orderBy("name").toLocalIterator():
            print(row["name"])
    elif a.command == "write":
        store.write_raw(a.name, a.path, a.resolution, a.fps)
    elif a.command == "read":
        store.read(a.name, a.resolution, a.roi, a.times, a.codec).write.parquet(a.out)
    elif a.command == "delete":
        store.delete(a.name)
    else:
        getattr(store, a.command)()


if __name__ == "__main__":
    main()
