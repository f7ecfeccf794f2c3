"""Near-duplicate vectors: a small-world graph per shard, queries against every shard, components of the links.

Equal vectors are one class and enter the graphs once. The classes of a label are dealt over shards of bounded
size. Each pair of shards meets once: the vectors of the lower shard are sent to the graph of the higher one, which
stays in its task while they stream past, with a beam that recall audits have widened. A link that is found counts
for both of its ends, so counts and components agree; of each meeting only the counts and a forest that spans the
links are written, so links within a large group are counted but not written out.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stored
from fleetlens.llm.components import components
from fleetlens.llm.small_world import SmallWorld, audited_beam


@dataclass(frozen=True)
class Linking:
    """Links need a cosine of ``least``; a shard holds about ``shard`` classes; audits use ``sample`` queries.

    A copy of a graph answers the vectors of up to ``lot`` shards.
    """

    least: float = 0.93
    shard: int = 8192
    beam: int = 24
    recall: float = 0.98
    sample: int = 256
    lot: int = 16
    seed: int = 3


def usable() -> Column:
    """Whether a row can link: an id, a label, and a vector of finite numbers that are not all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vector = finite & F.exists("embedding", lambda x: x != 0)
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(vector, F.lit(False))


def unit(column: pd.Series) -> np.ndarray:
    table = np.array(column.tolist(), np.float64)
    table = table / np.abs(table).max(axis=1, keepdims=True)
    return table / np.linalg.norm(table, axis=1, keepdims=True)


def graphs(classes: DataFrame, how: Linking) -> DataFrame:
    """One row per shard: its ids, sizes of classes, vectors and graph, with the beam that passed its audit."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        vectors = unit(rows["embedding"])
        graph = SmallWorld(vectors, seed=how.seed)
        data = pickle.dumps((rows["id"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64), graph))
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "data": [data]})

    schema = "label long, dim int, shard int, data binary"
    return classes.groupBy("label", "dim", "shard").applyInPandas(build, schema)


class Meeting:
    """One graph and the vectors that ask it: links per class, and edges of a forest that spans them."""

    def __init__(self, data: bytes, how: Linking) -> None:
        self.ids, self.copies, self.graph = pickle.loads(data)
        self.how, self.beam = how, how.beam
        self.links = np.zeros(len(self.ids), np.int64)
        self.groups = np.arange(len(self.ids))

    def edges(self, me: int, near: np.ndarray, out: list[tuple]) -> None:
        """An edge to one node of each group that ``near`` touches; the groups become one."""
        groups, first = np.unique(self.groups[near], return_index=True)
        out += [(me, 0, other) for other in self.ids[near[first]].tolist()]
        if len(groups) > 1:
            self.groups[np.isin(self.groups, groups)] = groups[0]

    def own(self) -> pd.DataFrame:
        """Links between the graph's own nodes: those that either end has found, as bits."""
        graph, how, n = self.graph, self.how, len(self.ids)
        beam = audited_beam(graph, graph.vectors, how.least, self.beam, how.recall, how.sample)
        bits, out = np.zeros((n, -(-n // 8)), np.uint8), []
        for node, query in enumerate(graph.vectors):
            near = graph.within(query, how.least, beam, node)
            near = near[near != node]
            if len(near):
                bits[node] = np.packbits(np.bincount(near, minlength=n).astype(bool))
                if (self.groups[near] != self.groups[node]).any():
                    self.edges(int(self.ids[node]), np.append(near, node), out)
        for at in range(0, n, 1024):
            end = min(n, at + 1024)
            found = np.unpackbits(bits[at:end], axis=1, count=n)
            found |= np.unpackbits(bits[:, at // 8 : -(-end // 8)], axis=1, count=end - at).T
            self.links[at:end] += (found @ self.copies).astype(np.int64)
        return table(out)

    def ask(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> pd.DataFrame:
        """Links between vectors of another shard and the graph's nodes, counted for both."""
        how, out = self.how, []
        self.beam = audited_beam(self.graph, vectors, how.least, self.beam, how.recall, how.sample)
        for me, many, query in zip(ids.tolist(), copies.tolist(), vectors, strict=True):
            near = self.graph.within(query, how.least, self.beam)
            if len(near):
                out.append((me, int(self.copies[near].sum()), None))
                self.links[near] += many
                self.edges(me, near, out)
        return table(out)

    def counts(self) -> pd.DataFrame:
        some = np.flatnonzero(self.links)
        return table([(i, n, None) for i, n in zip(self.ids[some].tolist(), self.links[some].tolist(), strict=True)])


def table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["id", "links", "other"]).astype({"id": "int64", "links": "int64", "other": "Int64"})


def answers(built: DataFrame, vectors: DataFrame, how: Linking) -> DataFrame:
    """``id, links, other``: counts of linked vectors of a class, to be added up, and edges of spanning forests.

    A vector is sent to the graphs of all higher shards of its label; a graph goes to one task for every ``how.lot``
    shards that ask it, comes first there and stays while their vectors pass.
    """
    met = ["label", "dim", "shard", "lot"]
    own_lot = F.floor(F.col("shard") / how.lot).cast("int")
    heads = built.select("label", "dim", "shard", F.explode(F.sequence(F.lit(0), own_lot)).alias("lot"), "data")
    none = F.lit(0).cast("long")  # a null would turn the ids of its batch into floating-point numbers
    heads = heads.select(*met, (F.col("lot") == own_lot).alias("own"), "data", none.alias("id"), none.alias("copies"))
    higher = F.explode(F.sequence(F.col("shard") + 1, F.col("shards") - 1))
    asking = vectors.where(F.col("shard") + 1 < F.col("shards"))
    asking = asking.select("label", "dim", higher.alias("shard"), own_lot.alias("lot"), "id", "copies", "embedding")
    rows = heads.unionByName(asking, allowMissingColumns=True)
    tasks = max(heads.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(tasks, *met).sortWithinPartitions(*met, F.col("data").isNull())

    def answer(batches):
        meeting = None
        for batch in batches:
            for _, part in batch.groupby(met, sort=False):
                head, asked = part[part["data"].notna()], part[part["data"].isna()]
                if len(head):
                    if meeting:
                        yield meeting.counts()
                    meeting = Meeting(head["data"].iloc[0], how)
                    if head["own"].iloc[0]:
                        yield meeting.own()
                if len(asked):
                    ids, copies = (asked[c].to_numpy(np.int64) for c in ("id", "copies"))
                    yield meeting.ask(ids, copies, unit(asked["embedding"]))
        if meeting:
            yield meeting.counts()

    return rows.mapInPandas(answer, "id long, links long, other long")


def linked(rows: DataFrame, how: Linking = Linking()) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors link if their labels are equal and their cosine, in double precision, is at least ``how.least``.
    Vectors of different lengths, without label or id, and those that are null, zero or hold null or non-finite
    numbers link with nothing. Equal vectors are linked with each other. A link counts at both of its ends. Repeated ids: each row counts as a vector,
    and classes with the same smallest id count as one. A row without an id has no component and is kept. An empty
    table gives no rows; other columns are not read.
    """
    rows = rows.select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    prints = [F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")]
    key = ["label", "dim", "p1", "p2"]
    good = rows.where(usable()).select(
        "vec_id", "embedding", "label", F.size("embedding").alias("dim"), prints[0].alias("p1"), prints[1].alias("p2")
    )
    classes = good.groupBy(*key).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = stored(classes, "classes")
    totals = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / how.shard).cast("int").alias("shards"))
    dealt = classes.join(totals, ["label", "dim"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    vectors = good.select(F.col("vec_id").alias("id"), *key, "embedding").join(
        dealt.select("id", *key, "copies", "shard", "shards"), ["id", *key]
    )
    vectors = stored(vectors.dropDuplicates(["id", *key]), "vectors")
    built = stored(graphs(vectors, how), "graphs")
    found = stored(answers(built, vectors, how), "answers")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = classes.join(counts, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    named = named.select(
        *key,
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("component", "id").alias("component"),
    )
    linked_rows = good.select("vec_id", *key).join(named, key)
    linked_rows = linked_rows.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where(~usable())
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = linked_rows.unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
