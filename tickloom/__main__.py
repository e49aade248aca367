"""Command line of the batch jobs: land, signals, train, or all three."""

from __future__ import annotations

import argparse

from tickloom.plans import jobs
from tickloom.session import build_session, scratch_tables


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tickloom")
    parser.add_argument("job", choices=("land", "signals", "train", "all"))
    parser.add_argument("--feed", help="binary files (land, all)")
    parser.add_argument("--date", help="day of the feed, as 2020-01-30 (land, all); signals of that day alone")
    parser.add_argument("--data", required=True, help="folder of the landed tables")
    parser.add_argument("--top", type=int, default=5, help="stocks to train on")
    options = parser.parse_args(argv)
    if options.job in ("land", "all") and not (options.feed and options.date):
        parser.error("--feed and --date are needed to land")

    spark = build_session()
    if options.job in ("land", "all"):
        jobs.land(spark, options.feed, options.data, options.date)
    if options.job in ("signals", "all"):
        jobs.compute_signals(spark, options.data, options.date)
    if options.job in ("train", "all"):
        with scratch_tables(spark):
            metrics = jobs.train(spark, options.data, options.top).metrics
        print(f"Test accuracy : {metrics['accuracy']:.2%}")
        print(f"Test precision: {metrics['weightedPrecision']:.2%}")


if __name__ == "__main__":
    main()
