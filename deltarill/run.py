"""An end-to-end run from a configuration: prepare the edges, choose the mode, run the kernel, dump the result.

    python -m deltarill.run CONF [KEY=VALUE ...]
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from deltarill.operators import partition
from deltarill.plans import algorithms, superstep, terminate
from deltarill.plans.kernel import Kernel
from deltarill.sources import adjacency, prepared, results
from deltarill.sources.config import Config, load
from deltarill.session import materialize


@dataclass
class Job:
    """What a run did: its ``state`` and ``metrics``, whether it ``converged``, ``shards`` of the edges, whether they were ``reused``, and
    the ``mode`` that the budget formula gives, which changes nothing here: Spark spills by itself."""

    run: superstep.Run
    shards: int
    reused: bool
    mode: str


def run(spark: SparkSession, config: Config, kernel: Kernel | None = None) -> Job:
    """Run ``config.algorithm`` (or ``kernel``) over the adjacency text at ``config.input`` and write ``id<TAB>value`` lines to ``config.result``.

    Edges are prepared beside the input (``<input>_prepared``) and reused while it has not changed; ``reuse_prepared`` takes
    them without looking. The run ends once progress changes by no more than ``tolerance`` between checks. A ``result`` that
    is the input is written to ``<input>_result``.
    """
    if kernel is None:
        if config.algorithm not in algorithms.REGISTRY:
            raise ValueError(f"no algorithm {config.algorithm}; there are {sorted(algorithms.REGISTRY)}")
        kernel = algorithms.REGISTRY[config.algorithm]()
    base = f"{config.input}_prepared"
    shards = config.num_shards if config.num_shards == "auto" else int(config.num_shards)
    edges, reused = prepared.edges(spark, config.input, base, shards, check_time=not config.reuse_prepared, budget_mb=config.budget_mb)
    lines = adjacency.read_lines(spark, config.input)
    m = prepared.manifest(spark, base)
    mode = "memory" if partition.fits_in_memory(config.nodes or m["max_id"] + 1, m["n_edges"], config.budget_mb, m["shards"]) else "disk"
    ready = superstep.prepare(edges.drop("shard"), adjacency.vertices(lines).select("id"))
    out = superstep.run_daic(ready, kernel, terminate.diff(config.tolerance), portion=config.portion, check_every=config.check_every)
    results.write_result(out.state, config.result if config.result != config.input else f"{config.input}_result")
    return Job(out, m["shards"], reused, mode)


def written(spark: SparkSession, config: Config) -> DataFrame:
    """``line``: the lines a run wrote, kept as a table of their own."""
    path = config.result if config.result != config.input else f"{config.input}_result"
    return materialize(adjacency.read_lines(spark, path))


def main(args: list[str]) -> None:
    config = load(args[0]) if args else Config()
    for a in args[1:]:
        key, _, value = a.partition("=")
        config = config.set(key, value)
    spark = SparkSession.builder.getOrCreate()
    job = run(spark, config)
    last = job.run.metrics[-1]
    print(f"{config.algorithm}: {last['round']} rounds, progress {last['progress']}, converged {job.run.converged}, {job.shards} shards, reused {job.reused}, mode {job.mode}")


if __name__ == "__main__":
    main(sys.argv[1:])
