"""spark-submit entry: solves the problems of annotated records.

    python -m seqloom SOURCE TARGET [--circular] [--mute] [--edits] [--usage CSV] [--enzymes CSV]

SOURCE: GenBank files whose misc_feature labels are specifications. TARGET: a folder that gets what became of each record
(`solved`, Parquet), the records as GenBank text with features for constraints, objectives and edits, a table of results,
and with --edits a table of changes. Each record is solved once. --usage: species, codon, share of the species that labels
name; --enzymes: name, site of enzymes beyond the common ones; both with a header.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import patterns
from .operators.records import FEATURES
from .operators.reports import edit_features
from .operators.solver import RESULT, Settings, solve_one
from .operators.space import Space
from .sources import files, labels

SETTINGS = Settings(iterations=10_000)


def solved_records(records: DataFrame, circular: bool = False, seed: int = 0, usage=None) -> DataFrame:
    """name, circular, the record's features, those of its problem, and what the search made of each record. Records with
    equal names are records of their own."""
    import pandas as pd

    own = dict(patterns._own_sites)

    def run(batches):
        if own:
            patterns.add_enzymes(own)
        for pdf in batches:
            rows, given, shown = [], [], []
            for r in pdf.to_dict("records"):
                features = [dict(f) | {"qualifiers": {k: list(v) for k, v in dict(f["qualifiers"] or {}).items()}} for f in (() if r["features"] is None else r["features"])]
                given.append(features)
                shown.append([])
                try:
                    constraints, objectives = labels.from_features(features, usage=usage)
                    rows.append(solve_one(r["q"], constraints, objectives, SETTINGS, f"{seed}/{r['name']}", circular or bool(r["circular"])))
                    shown[-1] = labels.problem_features(constraints, objectives, r["q"], rows[-1][0])
                except (TypeError, ValueError) as e:
                    rows.append((r["q"], "invalid", str(e), None, None, False, None))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])
            for k, (name, values) in enumerate((("name", list(pdf["name"])), ("circular", list(pdf["circular"])), ("features", given), ("problem", shown), ("before", list(pdf["q"])))):
                out.insert(k, name, values)
            yield out

    return records.mapInPandas(run, f"name string, circular boolean, features {FEATURES}, problem {FEATURES}, before string, {RESULT}")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="seqloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--circular", action="store_true")
    p.add_argument("--mute", action="store_true")
    p.add_argument("--edits", action="store_true")
    p.add_argument("--usage")
    p.add_argument("--enzymes")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("seqloom").getOrCreate()
    usage = labels.usage_tables(spark.read.csv(args.usage, header=True, schema="species string, codon string, share double")) if args.usage else None
    if args.enzymes:
        patterns.add_enzymes(spark.read.csv(args.enzymes, header=True, schema="name string, site string"))
    solved_records(files.read_genbank(spark, args.source), args.circular, usage=usage).write.mode("overwrite").parquet(f"{args.target}/solved")
    made = spark.read.parquet(f"{args.target}/solved")
    files.write_genbank(made.select("name", "q", "circular", F.concat("features", F.filter("problem", lambda f: f["qualifiers"]["is_edit"].isNotNull())).alias("features")), f"{args.target}/records")
    made.select("name", "before", "q", "status", "message", "objective_before", "objective_after", "all_pass").write.mode("overwrite").json(f"{args.target}/results")
    if args.edits:
        edit_features(made.where(F.length("before") == F.length("q")), "before", "q", "name").write.mode("overwrite").csv(f"{args.target}/edits", header=True)
    if not args.mute:
        made.select("name", "status", "message", "objective_before", "objective_after").show(truncate=80)


__all__ = ["Space", "main", "solved_records"]

if __name__ == "__main__":
    main()
