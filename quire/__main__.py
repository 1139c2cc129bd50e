"""Job entry points (``python -m quire ...`` or ``spark-submit``).

    ingest DIR ROOT [NAME] [--no-chunk] [--yaml]
        Ingest every *.md under DIR into the collection ROOT/NAME and print
        the statistics as JSON (like the reference's ingest command).
    ask ROOT NAME QUESTION [--n-results N] [--prompt TEXT]
        Build the model request for one question (like the reference's query
        command) and print it as JSON.
    requests ROOT NAME QUESTIONS OUT [--per-row]
        Questions table (parquet: query_id, question [, settings]) ->
        request table (parquet) at OUT.
"""

from __future__ import annotations

import argparse
import json
import sys

from quire.operators.assemble import FALLBACK_SYSTEM_PROMPT
from quire.session import get_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quire")
    sub = p.add_subparsers(dest="cmd", required=True)
    ing = sub.add_parser("ingest")
    ing.add_argument("directory")
    ing.add_argument("root")
    ing.add_argument("name", nargs="?", default="blog_posts")
    ing.add_argument("--no-chunk", action="store_true")
    ing.add_argument("--yaml", action="store_true", help="full YAML frontmatter")
    ask = sub.add_parser("ask")
    ask.add_argument("root")
    ask.add_argument("name")
    ask.add_argument("question")
    ask.add_argument("--n-results", type=int, default=5)
    ask.add_argument("--prompt", default=FALLBACK_SYSTEM_PROMPT)
    req = sub.add_parser("requests")
    req.add_argument("root")
    req.add_argument("name")
    req.add_argument("questions")
    req.add_argument("out")
    req.add_argument("--per-row", action="store_true")
    req.add_argument("--prompt", default=FALLBACK_SYSTEM_PROMPT)
    args = p.parse_args(argv)

    spark = get_session()
    if args.cmd == "ingest":
        from quire.plans.ingest import ingest_directory

        try:
            stats = ingest_directory(spark, args.directory, args.root, args.name,
                                     no_chunk=args.no_chunk,
                                     frontmatter_mode="yaml" if args.yaml else "flat")
        except FileNotFoundError as exc:
            print(f"Error: {exc}", file=sys.stderr)
            return 1
        print(json.dumps(stats))
    elif args.cmd == "ask":
        from quire.plans.ask import ask_one

        row = ask_one(spark, args.root, args.name, args.question, n_results=args.n_results,
                      base_prompt=args.prompt).collect()[0]
        print(json.dumps({"model": row.model, "max_tokens": row.max_tokens,
                          "system": row.system,
                          "messages": [m.asDict() for m in row.messages]}))
    else:
        from quire.plans.ask import ask
        from quire.sources.collection import read_collection

        coll = read_collection(spark, args.root, args.name)
        qs = spark.read.parquet(args.questions)
        ask(coll, qs, per_row=args.per_row,
            base_prompt=args.prompt).write.mode("overwrite") \
            .parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
