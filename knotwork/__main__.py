"""Label a graph's components and compare solvers, or generate a graph.

Without solvers all of them run.  Every labelling is compared with the first one, vertex by
vertex; a difference ends the program with status 1."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable

from knotwork.functions import summaries
from knotwork.operators import afforest, hooking, propagation, unionfind
from knotwork.plans.fixpoint import Result
from knotwork.plans.graphs import Graph
from knotwork.session import local_session
from knotwork.shipping import ship
from knotwork.sources import generator, matrix_market, sinks

SOLVERS: dict[str, Callable[[Graph, argparse.Namespace], Result]] = {
    "union_find_edge_once": lambda g, a: unionfind.edge_once(g, a.partitions),
    "union_find_tree_merge": lambda g, a: unionfind.tree_merge(g, a.partitions),
    "union_find_partitioned": lambda g, a: unionfind.partitioned(g, a.partitions),
    "afforest": lambda g, a: afforest.afforest(g, a.rounds),
    "hook_shortcut": lambda g, a: hooking.hook_shortcut(g),
    "label_prop_sync": lambda g, a: propagation.sync(g),
    "label_prop_full": lambda g, a: propagation.full(g),
    "label_prop_frontier": lambda g, a: propagation.frontier(g),
    "label_prop_push_pull": lambda g, a: propagation.push_pull(g),
    "label_prop_broadcast": lambda g, a: propagation.broadcast(g),
    "label_prop_shuffle": lambda g, a: propagation.shuffle(g, a.partitions),
}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("python -m knotwork", description=__doc__)
    p.add_argument("graph", help="a Matrix Market file to read, or with --generate a folder to write one to")
    p.add_argument("solvers", nargs="*", metavar="solver", help=", ".join(SOLVERS))
    p.add_argument("--generate", nargs=3, type=int, metavar=("VERTICES", "COMPONENTS", "EDGES_PER_VERTEX"), help="write a random graph of blocks instead")
    p.add_argument("--seed", type=int, default=1, help="of the random graph")
    p.add_argument("--cpus", type=int, default=8, help="threads of the local session")
    p.add_argument("--partitions", type=int, help="partitions of the union-finds, blocks of the halo exchange (from the data, if not given)")
    p.add_argument("--rounds", type=int, default=2, help="neighbours that Afforest samples first")
    p.add_argument("--labels", help="folder to write the first solver's labels to, as Parquet")
    return p


def main(args: list[str]) -> int:
    a = _parser().parse_args(args)
    wrong = [s for s in a.solvers if s not in SOLVERS]
    if wrong:
        print(f"no such solver: {', '.join(wrong)}; there are {', '.join(SOLVERS)}")
        return 2
    spark = local_session(a.cpus)
    ship(spark)
    if a.generate:
        vertices, components, each = a.generate
        matrix_market.write(generator.gen_blocks(spark, vertices, components, each, a.seed), vertices, a.graph)
        print(f"{vertices} vertices in {components} components written to {a.graph}")
        return 0
    graph = matrix_market.read(spark, a.graph)
    print(sinks.graph_report(graph))
    first, status = None, 0
    for name in a.solvers or SOLVERS:
        began = time.perf_counter()
        result = SOLVERS[name](graph, a)
        count = result.component_count()
        took = time.perf_counter() - began
        same = first is None or summaries.same_partition(first, result.labels)
        first = result.labels if first is None else first
        status |= not same
        print(f"{name}: {count} components, {result.iterations} iterations, {took:.2f} s{''.join(f', {k} {v:.2f} s' for k, v in result.seconds.items())}{'' if same else ' DIFFERS'}")
    print(sinks.component_report(first))
    sample = summaries.sampled_giant(first).first()
    print(f"most frequent label of a sample: {sample['component']}, {sample['percent']:.1f} % of it")
    if a.labels:
        sinks.write_labels(first, a.labels)
    return status


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
