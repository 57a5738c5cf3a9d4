"""Run one job: ``spark-submit --py-files ... citetrust/__main__.py JOB ARGUMENT... [--option VALUE]``.

Arguments and options are those of the functions in ``citetrust.plans.jobs``.
"""

from __future__ import annotations

import argparse
import inspect

from pyspark.sql import DataFrame

from citetrust.functions.domains import load_suffixes
from citetrust.plans import jobs
from citetrust.session import session

JOBS = [
    jobs.parse_pairs,
    jobs.parse_revisions,
    jobs.extract_labels,
    jobs.extract_pair_labels,
    jobs.mask_data,
    jobs.evaluate_sources,
    jobs.evaluate_pair_sources,
    jobs.evaluate_pair_sources_with_unchanged,
    jobs.evaluate_revisions,
    jobs.evaluate_pair_revisions,
    jobs.count_source_changes,
    jobs.count_unknown_sources,
]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="citetrust", description="Source trust jobs")
    commands = top.add_subparsers(dest="job", required=True)
    for job in JOBS:
        command = commands.add_parser(job.__name__, help=inspect.getdoc(job))
        command.set_defaults(run=job)
        for name, given in list(inspect.signature(job).parameters.items())[1:]:
            kind = int if name == "split" else str
            if name == "suffixes":
                command.add_argument("--suffixes", required=True, help="the public suffix list, a file")
            elif given.default is inspect.Parameter.empty:
                command.add_argument(name, type=kind)
            elif isinstance(given.default, bool):
                command.add_argument(f"--{name}", action="store_true")
            else:
                command.add_argument(f"--{name}", type=kind, default=given.default)
    return top


def main(arguments: list[str] | None = None) -> None:
    options = vars(parser().parse_args(arguments))
    run, _ = options.pop("run"), options.pop("job")
    spark = session()
    if "suffixes" in options:
        options["suffixes"] = load_suffixes(spark, options["suffixes"])
    result = run(spark, **options)
    if isinstance(result, DataFrame):
        result.show(truncate=False)
    else:
        print(result)


if __name__ == "__main__":
    main()
