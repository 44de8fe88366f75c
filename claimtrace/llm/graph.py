"""Connected components of undirected links, by Spark jobs alone."""

from pyspark.sql import DataFrame, Observation, functions as F

from claimtrace.sources import written


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, label): label is the smallest node of the component; nodes without links are absent.

    ``links`` has two columns a and b of one orderable type; nulls and loops are dropped. Large-star
    and small-star steps alternate (Kiveris et al. 2014) until the links are stars; each state is
    written to the shared folder, so that no plan grows and lost executors cost one step only.
    Only minima are taken of a node's links, so a node with very many of them is no trouble.

    With ``rounds`` it stops after so many: nodes of one label are then of one component still,
    but a component may have several labels.
    """
    links, before = _kept(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while rounds is None or rounds > 0:
        links, state = _kept(_small_star(_large_star(links)))
        rounds = None if rounds is None else rounds - 1
        if state == before:
            break
        before = state
    both = links.union(links.select("b", "b"))
    return both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))


def _kept(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links written, and what tells one state from another, taken while they are written."""
    seen = Observation()
    kept = written(links.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), "links")
    return kept, (seen.get["n"], seen.get["x"])


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("c"), F.least("a", "low").alias("low"))
    return (
        both.join(low, both.a == low.c).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    others = links.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return low.select("a", F.col("low").alias("b")).union(others).distinct()
