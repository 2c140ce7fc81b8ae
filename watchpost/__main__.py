"""Command line: the reference's requests, answered by Spark jobs, as JSON lines.

  python -m watchpost ingest   --dataset alerts --csv PATH --store ROOT [--summaries]
  python -m watchpost call     --dataset alerts --csv PATH --store ROOT metrics
  python -m watchpost call     --dataset alerts --csv PATH --store ROOT page --page 2 \\
                               --filter severity=critical --filter state=open --search log4j
  python -m watchpost call     --dataset deps --csv PATH --store ROOT search_repos --q api
  python -m watchpost call     --dataset alerts --csv PATH --store ROOT page_after \
                               --after '["acme", "api", 41]' --page-size 50
  python -m watchpost export   --dataset alerts --csv PATH --store ROOT --out DIR [filters]
  python -m watchpost overview --alerts-csv PATH --secrets-csv PATH --store ROOT [risk|heat|rank|totals]
  python -m watchpost timeline --store ROOT [--source secrets] [--merged]

``--csv`` may also be a drop folder: the dataset's file is then discovered
(first match of its glob in name order).  Every call reuses the Parquet
store of the file's fingerprint, as the reference reuses its cache.
"""

from __future__ import annotations

import argparse
import json
import sys

from watchpost.functions.clean import deliver
from watchpost.operators import timeline as tl
from watchpost.plans.engines import AlertsEngine, DepsEngine, Overview, SecretsEngine
from watchpost.session import get_session
from watchpost.sources import csv as src
from watchpost.sources import store as st

ENGINES = {"alerts": AlertsEngine, "secrets": SecretsEngine, "deps": DepsEngine}


def _rows(df) -> None:
    for row in deliver(df).toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str))


def _resolve(spark, path: str, dataset: str) -> str:
    if path.lower().endswith(".csv"):
        return path
    found = src.discover(spark, path, dataset)
    if not found:
        sys.exit(f"no {dataset} export found in {path}")
    return found


def _load(spark, args, dataset: str, csv_path: str, summaries: bool = False):
    path = _resolve(spark, csv_path, dataset)
    df = st.store(spark, path, args.store, dataset, summaries=summaries)
    return df, st.fingerprint(spark, path)


def _filters(args) -> dict:
    out: dict = {}
    for item in args.filter or []:
        key, _, value = item.partition("=")
        if key == "is_open_source":
            out[key] = value
        else:
            out.setdefault(key, []).append(value)
    if args.search:
        out["search"] = args.search
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="watchpost")
    sub = p.add_subparsers(dest="cmd", required=True)

    def dataset_args(sp):
        sp.add_argument("--dataset", choices=sorted(ENGINES), required=True)
        sp.add_argument("--csv", required=True, help="export file or drop folder")
        sp.add_argument("--store", required=True, help="store root (shared storage)")

    def filter_args(sp):
        sp.add_argument("--filter", action="append", help="name=value, repeatable")
        sp.add_argument("--search", default="")

    ing = sub.add_parser("ingest")
    dataset_args(ing)
    ing.add_argument("--summaries", action="store_true")

    call = sub.add_parser("call")
    dataset_args(call)
    call.add_argument("name", help="engine method, e.g. metrics, agg_org, page, search_orgs")
    call.add_argument("--page", type=int, default=1)
    call.add_argument("--after", help="page_after: the last row as JSON")
    call.add_argument("--page-size", type=int, default=50)
    call.add_argument("--q", default="")
    call.add_argument("--limit", type=int, default=50)
    filter_args(call)

    exp = sub.add_parser("export")
    dataset_args(exp)
    exp.add_argument("--out", required=True)
    filter_args(exp)

    ov = sub.add_parser("overview")
    ov.add_argument("--alerts-csv")
    ov.add_argument("--secrets-csv")
    ov.add_argument("--store", required=True)
    ov.add_argument("view", nargs="?", default="orgs",
                    choices=["orgs", "totals", "risk", "heat", "rank"])

    tlp = sub.add_parser("timeline")
    tlp.add_argument("--store", required=True)
    tlp.add_argument("--source")
    tlp.add_argument("--merged", action="store_true")

    args = p.parse_args(argv)
    spark = get_session()

    if args.cmd == "ingest":
        df, fp = _load(spark, args, args.dataset, args.csv, summaries=args.summaries)
        print(json.dumps({"dataset": args.dataset, "fingerprint": fp, "rows": df.count()}))
    elif args.cmd == "call":
        df, fp = _load(spark, args, args.dataset, args.csv)
        eng = ENGINES[args.dataset](df, summaries=(args.store, fp))
        if args.name == "page":
            page = eng.page(args.page, args.page_size, **_filters(args))
            _rows(page.envelope)
            _rows(page.rows)
        elif args.name == "page_after":
            last = json.loads(args.after) if args.after else None
            _rows(eng.page_after(last, args.page_size, **_filters(args)))
        elif args.name.startswith("search_"):
            _rows(getattr(eng, args.name)(args.q, args.limit))
        else:
            _rows(getattr(eng, args.name)())
    elif args.cmd == "export":
        df, _ = _load(spark, args, args.dataset, args.csv)
        path = ENGINES[args.dataset](df).export(args.out, **_filters(args))
        print(json.dumps({"export": path}))
    elif args.cmd == "overview":
        alerts = _load(spark, args, "alerts", args.alerts_csv)[0] if args.alerts_csv else None
        secrets = _load(spark, args, "secrets", args.secrets_csv)[0] if args.secrets_csv else None
        if alerts is None and secrets is None:
            sys.exit("give --alerts-csv and/or --secrets-csv")
        _rows(getattr(Overview(alerts, secrets), args.view)())
    elif args.cmd == "timeline":
        history = tl.read_history(spark, tl.store_path(args.store))
        _rows(tl.merge(history) if args.merged else tl.read(history, args.source))
    return 0


if __name__ == "__main__":
    sys.exit(main())
