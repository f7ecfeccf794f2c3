"""Near-duplicate documents by bottom-k sketches of their word shingles.

One hash function orders all shingles; a document's sketch is its k smallest. Inverted lists lead from a sketch
value to the documents that retain it. Two documents of Jaccard similarity 0.75 share about three quarters of
the sketch of their union, so each may leave its most common values out of the lists and both still meet in one.
The sketch of the union estimates the similarity of a pair; what may pass is verified on the full sets.

Only the components of the links are wanted, so a list is not turned into all its pairs: its documents are
compared with a leader first (one that has little of its own), and again with another leader, and what is then
joined needs no more comparing. Lists that are still split hold documents near one text that differ from it in
different places. They are described by their differences from what most of them share, and two of them can only
link if they have enough of these differences in common (see ``apart``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import hashed_words, id_and_text, joined_hash, map_steps, mixed, rest, run_hashes, stored
from fleetlens.llm.components import components


@dataclass(frozen=True)
class Likeness:
    """Links need ``100 * intersection >= percent * union``; ``deviations`` widens what a sketch lets pass."""

    shingle: int = 5
    percent: int = 75
    sketch: int = 48
    deviations: float = 5.0
    leaders: int = 2

    def least_hits(self, size: int) -> float:
        """Values of a union sketch of this size that two linked documents share, but for very rare draws."""
        share = self.percent / 100
        return share * size - self.deviations * (size * share * (1 - share)) ** 0.5


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The set of each text as sorted 64-bit hashes; a text of fewer words is one shingle, one without words none."""
    words, starts = hashed_words(texts, lower=True)
    runs = run_hashes(words, shingle)
    found = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= shingle:
            found.append(np.unique(mixed(runs[a : b - shingle + 1])))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = joined_hash(whole, words[k : k + 1])
            found.append(mixed(whole))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def sketches(docs: DataFrame, how: Likeness) -> DataFrame:
    """``doc_id, n_shingles``, a fingerprint of 128 bits of the set and its smallest values in order."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text"), how.shingle)
        second = np.uint64(0x2545F4914F6CDD1D)
        prints = [(np.add.reduce(s), np.add.reduce(mixed(s ^ second))) for s in sets]
        kept = [s[: how.sketch] for s in sets]
        bounds = np.concatenate(([0], np.cumsum([len(s) for s in kept]))).astype(np.int32)
        values = np.concatenate([*kept, np.zeros(0, np.uint64)]).view(np.int64)
        columns = [
            pa.array([len(s) for s in sets], pa.int64()),
            *(pa.array(np.array([p[i] for p in prints], np.uint64).view(np.int64)) for i in (0, 1)),
            pa.ListArray.from_arrays(pa.array(bounds), pa.array(values)),
        ]
        names = ["doc_id", "n_shingles", "f1", "f2", "sketch"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names)

    schema = "doc_id long, n_shingles long, f1 long, f2 long, sketch array<long>"
    return map_steps(id_and_text(docs), work, schema)


def postings(classes: DataFrame, how: Likeness) -> DataFrame:
    """``value, id, n, own``: the inverted lists, without values that one document alone retains (``own`` of them).

    A linked pair shares at least ``c`` values, so it shares one of the first ``s - c + 1`` of either sketch of s
    values when both are ordered alike, rarest first. Only these are listed; common passages come last.
    """
    values = classes.select("id", "n", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").count().where("count > 1")
    size = F.least("n", F.lit(how.sketch))
    least = F.least(F.ceil(size * how.percent / 100), F.lit(int(how.least_hits(how.sketch)))).cast("int")
    rows = values.join(shared, "value").groupBy("id", "n")
    rows = rows.agg(F.array_sort(F.collect_set(F.struct("count", "value"))).alias("shared"))
    single = size.cast("int") - F.size("shared")
    listed = F.slice("shared", F.lit(1), F.greatest(F.lit(0), size.cast("int") - least + 1 - single))
    return rows.select("id", "n", single.alias("own"), F.explode(listed).alias("entry")).select("entry.value", "id", "n", "own")


def ordered_pairs(rows: DataFrame, how: Likeness) -> DataFrame:
    """Distinct ``a < b`` of ``id, n, other, other_n`` whose sizes allow a link."""
    sizes = F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * how.percent
    rows = rows.where(sizes & (F.col("id") != F.col("other")))
    return rows.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def estimated(pairs: DataFrame, classes: DataFrame, how: Likeness) -> DataFrame:
    """``a, b, sure`` of the pairs that the sketch of their union lets pass; sure where both sketches are whole sets."""

    def work(batches):
        for batch in batches:
            lists = {}
            for side in "xy":
                column = batch.column(side)
                bounds = column.offsets.to_numpy()
                values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
                lists[side] = [values[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            sizes = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("nx", "ny")]
            kept, sure = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(lists["x"], lists["y"], strict=True)):
                union, times = np.unique(np.concatenate((x, y)), return_counts=True)
                sure[i] = max(sizes[0][i], sizes[1][i]) <= how.sketch
                if sure[i]:
                    kept[i] = 100 * int((times == 2).sum()) >= how.percent * len(union)
                else:
                    size = min(how.sketch, len(union))
                    kept[i] = (times[:size] == 2).sum() >= how.least_hits(size)
            mask = pa.array(kept)
            columns = [batch.column("a").filter(mask), batch.column("b").filter(mask), pa.array(sure[kept])]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "sure"])

    left = classes.select(F.col("id").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("nx"))
    right = classes.select(F.col("id").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("ny"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "nx", "ny")
    return joined.mapInArrow(work, "a long, b long, sure boolean")


def verified(pairs: DataFrame, texts: DataFrame, how: Likeness) -> DataFrame:
    """The pairs ``a, b`` whose full sets are alike enough."""

    def work(batches):
        for batch in batches:
            sets = []
            for key, column in (("a", "text_a"), ("b", "text_b")):
                ids, first, place = np.unique(
                    batch.column(key).to_numpy(zero_copy_only=False), return_index=True, return_inverse=True
                )
                own = shingle_sets(batch.column(column).take(pa.array(first)), how.shingle)
                sets.append((own, place))
            kept = []
            for i in range(batch.num_rows):
                x, y = (own[place[i]] for own, place in sets)
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * both >= how.percent * (len(x) + len(y) - both))
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in "ab"], ["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(lambda batches: work(small(batches)), "a long, b long")


def small(batches, rows: int = 512):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def links(lists: DataFrame, classes: DataFrame, texts: DataFrame, how: Likeness) -> DataFrame:
    """``node, component`` over verified links of the documents in the lists."""
    tested, groups = None, None

    def test(pairs: DataFrame) -> None:
        nonlocal tested, groups
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        passed = stored(estimated(pairs, classes, how), "estimates")
        linked = verified(passed.where("not sure").select("a", "b"), texts, how).unionByName(passed.where("sure").select("a", "b"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        groups = joined_groups(groups, stored(linked, "links"))

    def grouped(rows: DataFrame) -> DataFrame:
        if groups is None:
            return rows.withColumn("group", F.col("id"))
        joined = rows.join(groups, F.col("id") == F.col("node"), "left")
        return joined.select(*rows.columns, F.coalesce("component", "id").alias("group"))

    def test_leaders(rows: DataFrame, order: Column) -> None:
        """Compares each document of a list with the first one in an order, if they are apart."""
        leader = rows.groupBy("value").agg(F.min(F.struct(order.alias("order"), "id", "n", "group")).alias("leader"))
        met = rows.join(leader, "value").where(F.col("group") != F.col("leader.group"))
        other = F.col("leader.id").alias("other"), F.col("leader.n").alias("other_n")
        test(ordered_pairs(met.select("id", "n", *other), how))

    def split(rows: DataFrame) -> DataFrame:
        """The lists whose documents are apart, with their largest component."""
        sizes = rows.groupBy("value", "group").count().groupBy("value")
        main = sizes.agg(F.max(F.struct("count", "group")).alias("main"), F.count("*").alias("groups"))
        return rows.join(main.where("groups > 1").select("value", F.col("main.group").alias("main")), "value")

    for k in range(how.leaders):
        test_leaders(grouped(lists), F.xxhash64("id", F.lit(k)) if k else F.col("own").cast("long"))
    parted = stored(split(stored(grouped(lists), "members")), "parted")
    shingles = shared_shingles(texts, parted.select("id").distinct(), how)
    shared = shingles.groupBy("id").agg(F.count("*").alias("shared"))
    # A link needs ``percent * (n + m) <= (100 + percent) * shared`` and sizes that are alike.
    p = how.percent
    alive = p * (F.col("n") + F.ceil(F.col("n") * p / 100)) <= (100 + p) * F.col("shared")
    parted = stored(parted.join(shared, "id").where(alive), "alive")
    # The document with the least of its own is the one that most others can link with.
    test_leaders(parted, F.col("n") - F.col("shared"))
    parted = split(stored(grouped(parted.drop("group", "main")), "members"))
    members = stored(parted.select("main", "id", "n", "group").distinct(), "parted")
    test(ordered_pairs(apart(members, shingles, how), how))
    return groups


def joined_groups(groups: DataFrame | None, linked: DataFrame) -> DataFrame:
    """``node, component`` with new links ``a, b`` taken in: only the links between components are worked through."""
    if groups is None:
        return components(linked)
    for end in "ab":
        own = groups.select(F.col("node").alias(end), F.col("component").alias("of"))
        linked = linked.join(own, end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    between = stored(linked.where("a <> b").distinct(), "between")
    if between.isEmpty():
        return groups
    moved = components(between)
    target = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    known = groups.join(target, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return stored(known.unionByName(moved.join(groups, "node", "left_anti")), "groups")


def shared_shingles(texts: DataFrame, ids: DataFrame, how: Likeness) -> DataFrame:
    """``id, shingle`` of these documents, without shingles that only one of them has."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text"), how.shingle)
        rows = batch.column("id").take(pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
        values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
        return pa.RecordBatch.from_arrays([rows, pa.array(values)], ["id", "shingle"])

    shingles = map_steps(texts.join(ids, "id", "left_semi").select("id", "text"), work, "id long, shingle long")
    common = shingles.groupBy("shingle").count().where("count > 1").select("shingle")
    return stored(shingles.join(common, "shingle").select("id", "shingle"), "shingles")


def apart(members: DataFrame, shingles: DataFrame, how: Likeness) -> DataFrame:
    """Documents that may link, ``id, n, other, other_n``, among those that met in lists with one main component.

    Per main component, the core C is what more than half of its members have. A member X is described by its
    differences D(X): the part M(X) of C that it lacks, and what it shares beyond C. Then

        shared(X, Y) = |C| - |M(X)| - |M(Y)| + common differences,

    so a link needs at least w(X) + w(Y) common differences, where w(X) = q * n + |M(X)| - |C| / 2 and q = percent /
    (100 + percent). Where that is nothing, both link with the member of least w, and only that pair is formed. Else
    the two share one of the first |D| - need + 1 differences of each, when both are ordered alike: rarest first, so
    that common ones are seldom listed. Members are dealt into classes of w, and each lists these differences once
    for each class that it can meet.
    """
    q, width = how.percent / (100 + how.percent), 4.0
    sets = members.select("main", "id").join(shingles, "id")
    times = sets.groupBy("main", "shingle").agg(F.count("*").alias("times")).where("times > 1")
    size = members.groupBy("main").agg(F.count("*").alias("members"))
    times = times.join(size, "main").select("main", "shingle", (2 * F.col("times") > F.col("members")).alias("in_core"))
    core = times.where("in_core").groupBy("main").agg(F.collect_list("shingle").alias("core"))
    held = sets.join(times, ["main", "shingle"]).groupBy("main", "id")
    held = held.agg(
        F.collect_list(F.when(F.col("in_core"), F.col("shingle"))).alias("held"),
        F.collect_list(F.when(~F.col("in_core"), F.col("shingle"))).alias("extra"),
    )
    none = F.array().cast("array<bigint>")
    known = members.join(held, ["main", "id"], "left").join(core, "main", "left")
    known = known.withColumns({c: F.coalesce(c, none) for c in ("held", "extra", "core")})
    known = known.withColumn("lacking", F.array_except("core", "held"))
    marked = (
        F.transform("extra", lambda x: F.struct(F.lit(0).alias("kind"), x.alias("shingle"))),
        F.transform("lacking", lambda x: F.struct(F.lit(1).alias("kind"), x.alias("shingle"))),
    )
    weight = q * F.col("n") + F.size("lacking") - F.size("core") / 2
    known = known.select("main", "id", "n", "group", weight.alias("w"), F.concat(*marked).alias("differences"))
    known = stored(known.withColumn("class", F.floor(F.col("w") / width).cast("int")), "differences")
    single = known.select("main", "id", F.explode("differences").alias("difference"))
    rarity = single.groupBy("main", "difference").agg(F.count("*").alias("times"))
    ranked = single.join(rarity, ["main", "difference"]).groupBy("main", "id")
    ranked = ranked.agg(F.array_sort(F.collect_list(F.struct("times", "difference"))).alias("ranked"))
    known = stored(known.drop("differences").join(ranked, ["main", "id"], "left"), "ranked")

    first = known.groupBy("main").agg(F.min(F.struct("w", "id", "n", "group")).alias("first"), F.collect_set("class").alias("classes"))
    rows = known.join(first, "main")
    near = rows.where((F.col("w") + F.col("first.w") <= 1e-6) & (F.col("group") != F.col("first.group")))
    near = near.select("id", "n", F.col("first.id").alias("other"), F.col("first.n").alias("other_n"))

    listed = rows.withColumn("meets", F.explode("classes"))
    need = F.greatest(F.lit(1), F.ceil(F.col("w") + F.col("meets") * width - 1e-6)).cast("int")
    listed = listed.where("ranked IS NOT NULL").withColumn("length", F.size("ranked") - need + 1).where("length > 0")
    listed = listed.withColumn("entry", F.explode(F.slice("ranked", F.lit(1), F.col("length")))).where("entry.times > 1")
    listed = listed.withColumn("difference", F.col("entry.difference"))
    asking = listed.where(F.col("group") != F.col("main")).select("main", "difference", "class", "meets", "id", "n", "group")
    asked = listed.select(
        "main",
        "difference",
        F.col("meets").alias("class"),
        F.col("class").alias("meets"),
        F.col("id").alias("other"),
        F.col("n").alias("other_n"),
        F.col("group").alias("other_group"),
    )
    met = asking.join(asked, ["main", "difference", "class", "meets"]).where(F.col("group") != F.col("other_group"))
    return near.unionByName(met.select("id", "n", "other", "other_n"))


def deduplicated(docs: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (smallest id of its group) and ``kept``.

    Documents of equal sets are one class and meet the others once, under their smallest id. A null text is an
    empty one; an empty set is linked with nothing. Repeated ids: each row is judged by its own text, and classes
    with the same smallest id count as one. A row without an id has no component and is kept. Other columns are not read; an
    empty table gives no rows.
    """
    rows = stored(sketches(docs, how), "sketches")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    least = full.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"))
    ids = least.select("id")
    classes = full.join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    classes = stored(classes.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch"), "classes")
    lists = stored(postings(classes, how), "lists")
    listed = lists.select("id").distinct()
    classes = stored(classes.join(listed, "id", "left_semi"), "listed")
    texts = id_and_text(docs).select(F.col("doc_id").alias("id"), "text").join(listed, "id", "left_semi")
    groups = links(lists, classes, stored(texts, "texts"), how)
    named = rows.select("doc_id", "n_shingles", "f1", "f2").join(least, ["f1", "f2"], "left")
    named = named.join(groups, F.col("id") == F.col("node"), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def representatives(docs: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """``doc_id, text, rest`` of one row of each group of near-duplicate rows.

    Each row stands for itself here, whatever its id: repeated rows are copies of each other, rows without an id are
    compared as others are, and two texts under one id are two. Of a group stays the row with the smallest id (null
    after all others), of several such the one with the smallest hash of its text. Texts without words all stay.
    """
    columns = F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.xxhash64("text").alias("print"), *rest(docs, True)
    rows = stored(docs.select(*columns), "rows")  # numbered once, so that all that follows sees the same numbers
    groups = deduplicated(rows.select(F.col("row").alias("doc_id"), "text"), how)
    groups = groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    members = stored(rows.select("row", "doc_id", "print").join(groups, "row"), "members")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "print", "row")
    first = members.groupBy("component").agg(F.count("*").alias("times"), F.min(order).alias("first")).where("times > 1")
    gone = members.join(first, "component").where(F.col("row") != F.col("first.row")).select("row")
    return rows.join(stored(gone, "gone"), "row", "left_anti").select("doc_id", "text", "rest")
