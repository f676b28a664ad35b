"""python -m cellatlas CATALOG COMMAND...: runs commands over a catalog of Parquet tables and prints what they give."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .edge.commands import run
from .edge.engine import Engine
from .operators.encode import hashing_encoder


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("catalog")
    p.add_argument("command", nargs="+")
    p.add_argument("--scoring-mode", default="weighted", choices=["simple", "weighted", "full"])
    p.add_argument("--gene-weight", type=float, default=1.0)
    p.add_argument("--semantic-weight", type=float, default=1.0)
    p.add_argument("--dims", type=int, default=256, help="of the hashing encoder, as the clusters' vectors have it")
    a = p.parse_args()
    spark = SparkSession.builder.appName("cellatlas").getOrCreate()
    engine = Engine.load(spark, a.catalog, scoring=a.scoring_mode, weights=(a.gene_weight, a.semantic_weight), encoder=hashing_encoder(a.dims))
    for line in a.command:
        out = run(engine, line)
        if isinstance(out, str):
            print(out)
            continue
        for df in out if isinstance(out, tuple) else [out] if out is not None else []:
            df.show(50, truncate=60)


if __name__ == "__main__":
    main()
