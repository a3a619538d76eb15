"""Command line: answer a pattern or a SPARQL query, or print what the closure adds.

    python -m loomgraph --triples PATH [--schema PATH] [--lists PATH] [--dictionary PATH]
        (--pattern "S P O" | --sparql FILE | --closure) [--rules PROFILE-OR-FILE]
        [--after-rules PROFILE-OR-FILE] [--no-reasoning] [--exclude-explicit] [--no-query-optim]
        [--exclude-implicit-cardinality] [--lexical] [--select-all] [--n-results N]
        [--intermediate-stats] [--tag-explicit]

-1 in a pattern stands for any term.
"""

from __future__ import annotations

import argparse
import time
from pathlib import Path

from pyspark.sql import SparkSession

from loomgraph.engine import Engine
from loomgraph.plans.rules import PROFILES, Profile, parse_rule_file
from loomgraph.workspace import Workspace


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("--triples", required=True)
    for name in ("schema", "lists", "dictionary"):
        p.add_argument(f"--{name}")
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("--pattern")
    what.add_argument("--sparql")
    what.add_argument("--closure", action="store_true")
    p.add_argument("--rules", default="owl2rl_spec", help="a profile's name or a rule file")
    p.add_argument("--no-reasoning", action="store_true")
    p.add_argument("--exclude-explicit", action="store_true")
    p.add_argument("--lexical", action="store_true", help="compare literals without tags and datatypes")
    p.add_argument("--select-all", action="store_true", help="return all variables of the query")
    p.add_argument("--after-rules", help="rules on instances, once the others have closed the schema")
    p.add_argument("--no-query-optim", action="store_true", help="join the patterns in the order of the query")
    p.add_argument("--exclude-implicit-cardinality", action="store_true", help="estimate by what is stated only")
    p.add_argument("--intermediate-stats", action="store_true", help="print the rows of each intermediate table")
    p.add_argument("--tag-explicit", action="store_true", help="say of each answer of a pattern whether it is stated")
    p.add_argument("--n-results", type=int, default=10)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    read = lambda path: spark.read.parquet(path) if path else None
    rules = lambda x: PROFILES.get(x) or Profile(x, parse_rule_file(Path(x).read_text()))
    after = rules(a.after_rules) if a.after_rules else None
    e = Engine(read(a.triples), read(a.schema), read(a.lists), read(a.dictionary), rules(a.rules), after)
    began = time.time()
    if a.closure:
        rows = e.forward()
    elif a.pattern:
        terms = [None if int(x) == -1 else int(x) for x in a.pattern.split()]
        if len(terms) != 3:
            p.error("a pattern has three terms")
        rows = e.pattern(*terms, reason=not a.no_reasoning, exclude_explicit=a.exclude_explicit, tag_explicit=a.tag_explicit)
    else:
        text = Path(a.sparql).read_text()
        rows = e.sparql(
            text, not a.no_reasoning, a.lexical, a.select_all, not a.no_query_optim, not a.exclude_implicit_cardinality
        )
    rows = rows.cache()
    n = rows.count()
    print(f"Time execution = {(time.time() - began) * 1000:.0f}\nTriples = {n}")
    for r in e.answer_lines(rows.orderBy(*rows.columns)).limit(a.n_results).collect():
        print(r["line"])
    if a.intermediate_stats:
        for operator, name, rows_written in Workspace.counts:
            print(f"{operator} {name} {rows_written}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
