"""Graph operators: clusters of coupled tables and dependency orders."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srclens.sources.shared import Scratch, numbered, written


#: Rows that one task numbers at most; more are numbered over range partitions.
FEW = 10_000
#: Dependencies that one task puts in order at most.
FEW_NEEDS = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``id, component`` (the smallest id) of every vertex of the edges ``a, b``, of any type that has an order.

    Large-star and small-star steps alternate until nothing changes: every vertex
    is linked to the smallest neighbour it knows of, so that a chain of n vertices takes about log n rounds.
    Each step is one grouping with partial minima and one join, both on single vertices, so a hot vertex is
    pre-aggregated or split by adaptive execution. The driver sees two numbers a round.
    """
    with Scratch(edges.sparkSession) as scratch:
        edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = scratch.written(edges.distinct(), "edges")
        state = _state(edges)
        for _ in range(max_rounds):
            if state[0] == 0:
                break
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = scratch.written(large.where(F.col("a") != F.col("b")).distinct(), "large-star")
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            edges = scratch.written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
            scratch.drop(keep=1)
            before, state = state, _state(edges)
            if before == state:
                break
        else:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
        roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
        found = edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
        return written(found, "components")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, cluster`` (the smallest node reached) over undirected edges; a loop makes a cluster of its own."""
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    found = connected_components(one).select(F.col("id").alias("node"), F.col("component").alias("cluster"))
    alone = one.where("a = b").select(F.col("a").alias("node")).distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("cluster")))


def migration_order(modules: DataFrame, dependencies: DataFrame) -> DataFrame:
    """``name, place``: modules in dependency order.

    A step takes, of the modules whose dependencies are all done, the one of least (priority, name); if there is none a
    cycle is broken by the least (risk is not low, complexity, name). Rounds over tables do many steps at once: the
    ready modules in their order, up to the first that unlocks a module that comes before the next one. The driver sees counts only.

    Up to ``FEW`` modules with ``FEW_NEEDS`` dependencies are taken from two heaps in one task, since chains have a round for every module.

    ``modules``: name, priority, risk, complexity; a name stands once. ``dependencies``: name, needs (those on no module of the table don't count).
    """
    if few(modules, FEW) and few(dependencies, FEW_NEEDS):
        return _order_of_few(modules, dependencies)
    return _order_by_rounds(modules, dependencies)


def few(rows: DataFrame, most: int) -> bool:
    return rows.limit(most + 1).count() <= most


def _order_of_few(modules: DataFrame, dependencies: DataFrame) -> DataFrame:
    kind = modules.schema["name"].dataType
    one = F.lit(0).alias("_one")
    rows = modules.select(one, "name", F.lit(None).cast(kind).alias("needs"), F.struct("priority", "name").alias("_key"), F.struct((F.col("risk") != "low").alias("risky"), "complexity", "name").alias("_break"))
    # Ranks stand for both keys, so that values of any type are compared as Spark compares them.
    rows = rows.withColumn("ready_key", F.row_number().over(Window.partitionBy("_one").orderBy("_key"))).withColumn("break_key", F.row_number().over(Window.partitionBy("_one").orderBy("_break"))).drop("_key", "_break")
    rows = rows.unionByName(dependencies.select(one, "name", "needs").where("needs is not null"), allowMissingColumns=True)

    def run(table: pa.Table) -> pa.Table:
        every = table.to_pylist()
        nodes = {r["name"]: (r["ready_key"], r["break_key"]) for r in every if r["ready_key"] is not None}
        needs: dict = {x: set() for x in nodes}
        followers: dict = {x: [] for x in nodes}
        for r in every:
            if r["ready_key"] is None and r["name"] in nodes and r["needs"] in nodes and r["name"] != r["needs"] and r["needs"] not in needs[r["name"]]:
                needs[r["name"]].add(r["needs"])
                followers[r["needs"]].append(r["name"])
        by_ready, by_break = {k[0]: x for x, k in nodes.items()}, {k[1]: x for x, k in nodes.items()}
        ready = [k[0] for x, k in nodes.items() if not needs[x]]
        breaks = sorted(by_break)
        heapq.heapify(ready)
        done: dict = {}
        at = 0
        while len(done) < len(nodes):
            if ready:
                name = by_ready[heapq.heappop(ready)]
            else:
                while by_break[breaks[at]] in done:
                    at += 1
                name = by_break[breaks[at]]
            done[name] = len(done) + 1
            for x in followers[name]:
                needs[x].discard(name)
                if not needs[x] and x not in done:
                    heapq.heappush(ready, nodes[x][0])
        return pa.table([pa.array(list(done), table.schema.field("name").type), pa.array(list(done.values()), pa.int64())], names=["name", "place"])

    schema = T.StructType([T.StructField("name", kind), T.StructField("place", T.LongType())])
    return rows.groupBy("_one").applyInArrow(run, schema)


def _order_by_rounds(modules: DataFrame, dependencies: DataFrame) -> DataFrame:
    with Scratch(modules.sparkSession) as scratch:
        left = scratch.written(modules.select("name", "priority", (F.col("risk") != "low").alias("risky"), "complexity"), "modules")
        known = left.select("name")
        needs = dependencies.where(F.col("name") != F.col("needs")).select("name", "needs").distinct()
        needs = needs.join(known, "name", "left_semi").join(known.withColumnRenamed("name", "needs"), "needs", "left_semi")
        needs = scratch.written(needs.select("name", "needs"), "needs")
        done, n_done, total = None, 0, left.count()
        while n_done < total:
            ready = left.join(needs.select("name").distinct(), "name", "left_anti")
            n_ready = ready.count()
            # Without a ready module cycles are broken one after another, until that makes a module ready.
            by = ["priority", "name"] if n_ready else ["risky", "complexity", "name"]
            if not n_ready:
                ready, n_ready = left, total - n_done
            order = [F.col(c).asc() for c in by]
            if n_ready <= FEW:
                ranked = ready.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
            else:
                ranked = numbered(ready, *order)
            # A module whose open needs are all ranked is unlocked by the last of them.
            waits = needs.join(ranked.select(F.col("name").alias("needs"), "rank"), "needs", "left")
            unlocked = waits.groupBy("name").agg(F.max("rank").alias("by"), F.count_if(F.col("rank").isNull()).alias("n_open")).where("n_open = 0")
            if by[0] == "priority":  # it counts if it comes before the next ready one
                following = ranked.select(F.col("rank").alias("_next"), F.struct("priority", "name").alias("_key"))
                early = unlocked.join(left.select("name", "priority"), "name").join(following, F.col("_next") == F.col("by") + 1)
                early = early.where(F.struct("priority", "name") < F.col("_key"))
            else:  # it counts if it isn't broken out before
                early = unlocked.join(ranked.select("name", "rank"), "name").where(F.col("rank") > F.col("by"))
            last = early.agg(F.min("by")).first()[0] if n_ready > 1 else None
            n_taken = n_ready if last is None else last + 1
            taken = ranked.where(F.col("rank") < n_taken).select("name", "rank")
            taken = scratch.written(taken.select("name", (F.col("rank") + n_done + 1).alias("place")), "taken")
            done = taken if done is None else done.unionByName(taken)
            n_done += n_taken
            if n_done == total:
                break
            left = scratch.written(left.join(taken, "name", "left_anti"), "modules")
            gone = taken.select(F.col("name").alias("needs"))
            needs = scratch.written(needs.join(gone, "needs", "left_anti").join(taken.select("name"), "name", "left_anti").select("name", "needs"), "needs")
        if done is None:
            return modules.select("name", F.lit(0).cast("long").alias("place")).limit(0)
        return written(done, "migration-order")


def followed(pointers: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, at, place``: what is passed on the way along ``pointers`` (``keys, at, to``; null ends it) from each key's start, ``place`` counting from 0.

    Pointers are doubled until none is left, then every second, fourth, ... stop is filled in from the longest down: a way of n steps takes log n rounds of joins, and no key is
    in one task. Ways that run into a circle are refused.
    """
    with Scratch(pointers.sparkSession) as scratch:
        jumps = [scratch.written(pointers.select(*keys, "at", "to").where("to is not null"), "pointers")]
        while not jumps[-1].isEmpty():
            if len(jumps) > 62:
                raise ValueError("pointers run in a circle")
            last = jumps[-1]
            onward = last.select(*keys, F.col("at").alias("to"), F.col("to").alias("_to"))
            jumps.append(scratch.written(last.join(onward, [*keys, "to"]).select(*keys, "at", F.col("_to").alias("to")), "pointers"))
        way = scratch.written(starts.select(*keys, "at", F.lit(0).cast("long").alias("place")), "way")
        for k in range(len(jumps) - 2, -1, -1):
            more = way.join(jumps[k], [*keys, "at"]).select(*keys, F.col("to").alias("at"), (F.col("place") + (1 << k)).alias("place"))
            way = scratch.written(way.unionByName(more), "way")
        return written(way, "way")


def leftover_cluster(files: DataFrame, clustered: DataFrame, file: str, table: str) -> DataFrame:
    """Files without a cluster go to their alphabetically first table."""
    return files.join(clustered.select(file).distinct(), file, "left_anti").groupBy(file).agg(F.min(table).alias("cluster"))


def renumbered(rows: DataFrame, custom: list[str], name: str, fallback: str) -> DataFrame:
    """``place``: by a custom list of names, else after 100 by ``fallback``."""
    at = F.array_position(F.array(*[F.lit(x) for x in custom]), F.col(name))
    key = F.when(at > 0, at).otherwise(100 + F.col(fallback))
    keyed = rows.withColumn("rank_key", key.cast("long"))
    return numbered(keyed, F.col("rank_key").asc(), F.col(name).asc(), name="place").withColumn("place", F.col("place") + 1)
