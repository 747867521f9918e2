"""Command line: chat templates, and tokens for a table of requests."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="turnloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("template", help="print a chat template")
    t.add_argument("version")
    t.add_argument("--thinking", action="store_true")
    t.add_argument("--images", action="store_true")
    k = sub.add_parser("tokenize", help="requests (JSON in a column) to tokens, as Parquet")
    k.add_argument("version")
    k.add_argument("source", help="Parquet with conv_id and request")
    k.add_argument("target")
    k.add_argument("--vocabulary", help="JSON vocabulary; bytes if none is given")
    k.add_argument("--mode", default="serving")
    k.add_argument("--budget", type=int)
    a = p.parse_args(argv)
    if a.command == "template":
        from turnloom.operators.grammar import chat_template
        from turnloom.versions import version

        print(chat_template(version(a.version), a.thinking, a.images), end="")
        return
    from pyspark.sql import SparkSession

    from turnloom.operators.convert import from_json
    from turnloom.plans.chat import Engine
    from turnloom.sources import vocabulary

    spark = SparkSession.builder.getOrCreate()
    words = vocabulary.read(spark, a.vocabulary) if a.vocabulary else vocabulary.Vocabulary()
    engine = Engine.of(a.version, mode=a.mode, vocabulary=words, max_input_tokens=a.budget)
    engine.tokens(from_json(spark.read.parquet(a.source))).select("conv_id", "tokens", "prompt", "error").write.parquet(a.target)


if __name__ == "__main__":
    main()
