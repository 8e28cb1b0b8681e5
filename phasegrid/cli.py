"""Command line: invert, tracks, masks, subset, reference, steps."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from phasegrid.plans.workflow import Inversion, find_reference, model_history, parse_steps, read_jobs, run_inversion
from phasegrid.session import session
from phasegrid.sources.tables import load, record, save


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="phasegrid")
    top.add_argument("--root", default=".")
    commands = top.add_subparsers(dest="command", required=True)
    inv = commands.add_parser("invert", help="pairs and stack tables to history, coherence and model tables")
    for name in ("low", "high"):
        inv.add_argument(f"--{name}")
    for name in ("max-days", "max-steps"):
        inv.add_argument(f"--{name}", type=int)
    inv.add_argument("--alpha", type=float, default=0.0)
    for name in ("velocity", "weighted", "annual", "model"):
        inv.add_argument(f"--{name}", action="store_true")
    jobs = commands.add_parser("tracks", help="show the options of every track of a job file")
    jobs.add_argument("config")
    commands.add_parser("masks", help="pixels masked on most dates").add_argument("--least", type=int, default=1)
    sub = commands.add_parser("subset", help="copy the part of a table inside a box")
    sub.add_argument("table")
    sub.add_argument("out")
    sub.add_argument("--box", type=float, nargs=4, metavar=("LEFT", "RIGHT", "BOTTOM", "TOP"), required=True)
    ref = commands.add_parser("reference", help="the reference pixel: a station goes before lat and lon, these before row and col")
    ref.add_argument("--station")
    for name, kind in (("lat", float), ("lon", float), ("row", int), ("col", int)):
        ref.add_argument(f"--{name}", type=kind)
    commands.add_parser("steps").add_argument("text")
    a = top.parse_args(argv)
    if a.command == "steps":
        print(*parse_steps(a.text))
        return 0
    if a.command == "tracks":
        for job in read_jobs(a.config)[1]:
            print(job.name, job.options)
        return 0
    spark = session()
    if a.command == "invert":
        s = Inversion(a.low, a.high, a.max_days, a.max_steps, a.annual, a.velocity, a.weighted, a.alpha)
        out = run_inversion(load(spark, a.root, "stack"), load(spark, a.root, "pairs"), settings=s)
        if a.model:
            out |= model_history(out["history"])
        for name, df in out.items():
            save(df, a.root, f"out_{name}", "overwrite")
        record(spark, a.root, vars(a))
    elif a.command == "reference":
        stations = load(spark, a.root, "stations") if a.station else None
        print(find_reference(load(spark, a.root, "grid"), a.station, a.lat, a.lon, a.row, a.col, stations))
    elif a.command == "masks":
        load(spark, a.root, "masks").groupBy("prow", "pcol").agg(F.sum(F.col("masked").cast("int")).alias("depth")).filter(F.col("depth") >= a.least).show()
    elif a.command == "subset":
        left, right, bottom, top_ = a.box
        save(load(spark, a.root, a.table).filter(F.col("lon").between(left, right) & F.col("lat").between(bottom, top_)), a.root, a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
