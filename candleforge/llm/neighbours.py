"""Near-duplicate embeddings by NN-descent.

1. Rows with equal directions form classes; everything below works on classes with multiplicities.
2. A neighbour graph starts from random-projection buckets: within a bucket (a large one is split) every vector
   takes its nearest others.
3. Rounds refine it: for every vector the neighbours it lists and those that list it meet, all pairs of that
   bounded set are compared, and lists are merged. A list that is full of links is *saturated* and may hold twice
   as many from then on.
4. Edges of at least the threshold are kept; they connect components.
5. Links are counted exactly within components, without listing pairs: vectors within half the threshold angle
   of the component's mean are pairwise linked by the triangle inequality, so only the others are compared, block
   by block.
6. Recall is audited class by class: a sampled class is right if the links found are all it truly has, by brute force
   against all vectors. Samples are drawn among classes of large components, of small ones and without links, and
   the target must be met by all classes and by those outside large components. Until then, buckets and rounds are
   added; a run that stops short of the target fails.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candleforge.llm.common import checkpointed
from candleforge.llm.components import components

log = logging.getLogger(__name__)

THRESHOLD = 0.95
#: Length of a neighbour list at first and at most.
K, MOST_K = 8, 64
TABLES, ROUNDS = 8, 2
#: Vectors of a bucket, on average and at most; vectors that a Python group holds at once.
BUCKET, MOST_BUCKET, GROUP = 32, 256, 16384
BLOCK = 512
#: Classes sampled of each kind, share of linked ones that must be right, attempts before the run fails.
AUDIT, RECALL, ATTEMPTS = 256, 0.98, 16
#: Classes of a component that counts as large.
LARGE = 64
EDGE = "a long, b long, s double"


def unit(vector: list[float | None] | None) -> np.ndarray | None:
    """Direction in double precision, None for a vector that has none; scaled first, so squares stay finite."""
    if not vector or None in vector:
        return None
    v = np.asarray(vector, dtype=np.float64)
    most = np.abs(v).max()
    if not (0 < most < np.inf):  # false for NaN too
        return None
    v = v / most
    return v / np.sqrt(v @ v)


def directions(rows: DataFrame) -> DataFrame:
    """(id long, u array<double>) of rows (id, v array); u is NULL where there is no direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([unit(v) for v in batch.column("v").to_pylist()], pa.list_(pa.float64()))], names=["id", "u"])

    return rows.mapInArrow(run, "id long, u array<double>")


def stacked(lists: list | pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; missing components of shorter ones are 0."""
    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _best(ids: np.ndarray, v: np.ndarray, k: int | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, s): each vector's k nearest others among these."""
    n = len(ids)
    s = v @ v.T
    np.fill_diagonal(s, -2.0)
    most = min(n - 1, int(np.max(k)))
    near = np.argpartition(-s, most - 1, axis=1)[:, :most] if most < n - 1 else np.argsort(-s, axis=1)[:, :most]
    row = np.repeat(np.arange(n), near.shape[1])
    col = near.ravel()
    return ids[row], ids[col], s[row, col]


def _runs(keys: np.ndarray) -> Iterator[slice]:
    """Slices of equal rows of a sorted key array."""
    if len(keys):
        edge = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(keys)]):
            yield slice(a, b)


def _frame(parts: list[tuple]) -> pd.DataFrame:
    if not parts:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "s": np.zeros(0)})
    a, b, s = (np.concatenate(x) for x in zip(*parts))
    return pd.DataFrame({"a": a, "b": b, "s": s})


class Graph:
    """Neighbour lists of the classes `nodes` (cid long, u array<double>, m long, least long)."""

    def __init__(self, nodes: DataFrame, n: int, width: int, threshold: float, k: int) -> None:
        self.nodes, self.n, self.width, self.threshold, self.k = nodes, n, width, threshold, k
        spark = nodes.sparkSession
        self.edges = spark.createDataFrame([], EDGE)
        self.limits = spark.createDataFrame([], "a long, most int")

    def _local(self, members: DataFrame, keys: list[str], k: int) -> DataFrame:
        """Nearest others within each group (keys, cid); groups are small and many go to one Python call."""
        width = self.width
        calls = max(1, members.count() // GROUP)

        def run(df: pd.DataFrame) -> pd.DataFrame:
            df = df.sort_values([*keys, "cid"])
            v, ids, parts = stacked(df["u"], width), df["cid"].to_numpy(), []
            for own in _runs(df[keys].to_numpy()):
                if own.stop - own.start > 1:
                    parts.append(_best(ids[own], v[own], k))
            return _frame(parts)

        dealt = members.join(self.nodes.select("cid", "u"), "cid").withColumn("_call", F.pmod(F.xxhash64(*keys), F.lit(calls)))
        return dealt.groupBy("_call").applyInPandas(run, EDGE)

    def _merge(self, found: DataFrame) -> None:
        """Lists keep the nearest of what they had and of what was found, in either direction."""
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")).unionByName(self.edges)
        one = both.repartition("a").groupBy("a", "b").agg(F.max("s").alias("s"))
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
        kept = one.withColumn("_r", rank).join(self.limits, "a", "left").where(F.col("_r") <= F.coalesce("most", F.lit(self.k)))
        self.edges = checkpointed(kept.select("a", "b", "s"))

    def enlarge(self) -> None:
        """Saturated lists, full of links, may hold twice as many."""
        full = self.edges.groupBy("a").agg(F.count("*").alias("n"), F.min("s").alias("least")).join(self.limits, "a", "left")
        most = F.coalesce("most", F.lit(self.k))
        grown = full.where((F.col("n") >= most) & (F.col("least") >= self.threshold)).select("a", F.least(most * 2, F.lit(MOST_K)).alias("grown"))
        after = self.limits.join(grown, "a", "full").select("a", F.coalesce("grown", "most").cast("int").alias("most"))
        self.limits = checkpointed(after)

    def buckets(self, tables: range) -> None:
        """Add each vector's nearest others within random-projection buckets."""
        bits, width = max(1, min(40, round(math.log2(max(2, self.n / BUCKET))))), self.width

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = (1 << np.arange(bits)).astype(np.int64)
            planes = [np.random.default_rng(7919 + t).normal(size=(width, bits)) for t in tables]
            for batch in batches:
                v = stacked(batch.column("u").to_pylist(), width)
                for t, p in zip(tables, planes):
                    code = ((v @ p) > 0) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, dtype=np.int32)), pa.array(code.astype(np.int64)), batch.column("cid")], names=["t", "code", "cid"])

        rows = checkpointed(self.nodes.select("u", "cid").mapInArrow(codes, "t int, code long, cid long"))
        crowded = rows.groupBy("t", "code").agg(F.count("*").alias("n")).where(F.col("n") > MOST_BUCKET)
        crowded = checkpointed(crowded.select("t", "code", F.ceil(F.col("n") / MOST_BUCKET).cast("int").alias("parts")))
        part = F.coalesce(F.pmod(F.xxhash64("cid", "t"), F.col("parts")), F.lit(0)).cast("int")
        self._merge(self._local(rows.join(crowded, ["t", "code"], "left").withColumn("part", part).drop("parts"), ["t", "code", "part"], self.k))

    def descend(self) -> None:
        """One round: neighbours of a vector meet each other."""
        back = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("s"), "a"))
        listed = self.edges.select(F.col("a").alias("at"), F.col("b").alias("cid"))
        listing = self.edges.withColumn("_r", back).where(F.col("_r") <= self.k).select(F.col("b").alias("at"), F.col("a").alias("cid"))
        selves = self.edges.select(F.col("a").alias("at"), F.col("a").alias("cid"))
        members = checkpointed(listed.unionByName(listing).unionByName(selves).distinct())
        self._merge(self._local(members, ["at"], self.k))
        self.enlarge()

    def links(self) -> DataFrame:
        return self.edges.where(F.col("s") >= self.threshold).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _counts(nodes: DataFrame, roots: DataFrame, width: int, threshold: float) -> DataFrame:
    """(cid, root, links): rows linked to each of a class, itself not counted, among its component."""
    members = checkpointed(nodes.join(roots, nodes["cid"] == roots["node"]).select("cid", "u", "m", "root"))
    sums = members.groupBy("root").agg(*[F.sum(F.coalesce(F.try_element_at("u", F.lit(i + 1)), F.lit(0.0))).alias(f"_{i}") for i in range(width)])
    mean = directions(sums.select(F.col("root").alias("id"), F.array(*[F.col(f"_{i}") for i in range(width)]).alias("v"))).select(F.col("id").alias("root"), F.col("u").alias("mean"))
    dot = F.aggregate(F.zip_with("u", "mean", lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x)
    near = math.sqrt((1 + threshold) / 2) + 1e-9
    placed = checkpointed(members.join(mean, "root").select("cid", "u", "m", "root", F.coalesce(dot >= near, F.lit(False)).alias("core")))
    facts = placed.groupBy("root").agg(F.sum(F.when(F.col("core"), F.col("m"))).alias("core_rows"), F.count("*").alias("n_all"), F.count_if(~F.col("core")).alias("n_out"))
    facts = checkpointed(facts.select("root", F.coalesce("core_rows", F.lit(0).cast("long")).alias("core_rows"), F.ceil(F.col("n_all") / BLOCK).cast("int").alias("all_blocks"), F.ceil(F.col("n_out") / BLOCK).cast("int").alias("out_blocks")))
    rows = placed.join(facts.where("out_blocks > 0"), "root")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda c: F.pmod(F.xxhash64("cid"), F.col(c)).cast("int")
    left = rows.withColumn("x", mine("all_blocks")).withColumn("y", every("out_blocks"))
    right = rows.where(~F.col("core")).withColumn("y", mine("out_blocks")).withColumn("x", every("all_blocks"))
    calls = F.pmod(F.xxhash64("root", "x", "y"), F.lit(max(1, placed.where(~F.col("core")).count() // 1024)))

    def run(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        ids, adds = [], []
        groups = {k: g for k, g in other.groupby(["root", "x", "y"])}
        for key, a in one.groupby(["root", "x", "y"]):
            b = groups.get(key)
            if b is None:
                continue
            s = stacked(a["u"], width) @ stacked(b["u"], width).T >= threshold
            s &= a["cid"].to_numpy()[:, None] != b["cid"].to_numpy()[None, :]
            ids += [a["cid"].to_numpy(), b["cid"].to_numpy()]
            adds += [s @ b["m"].to_numpy(), np.where(a["core"].to_numpy(), a["m"].to_numpy(), 0) @ s]
        if not ids:
            return pd.DataFrame({"cid": np.zeros(0, np.int64), "add": np.zeros(0, np.int64)})
        return pd.DataFrame({"cid": np.concatenate(ids), "add": np.concatenate(adds).astype(np.int64)})

    own = lambda df: df.select(*[F.col(c).alias(c) for c in ("root", "x", "y", "cid", "u", "m", "core")], calls.alias("call")).groupBy("call")
    compared = own(left).cogroup(own(right)).applyInPandas(run, "cid long, add long")
    added = compared.groupBy("cid").agg(F.sum("add").alias("add"))
    sure = F.when(F.col("core"), F.col("core_rows")).otherwise(F.col("m"))
    return placed.join(facts, "root").join(added, "cid", "left").select("cid", "root", (sure - 1 + F.coalesce("add", F.lit(0))).alias("links"))


def _audited(nodes: DataFrame, found: DataFrame, width: int, threshold: float, sample: int) -> tuple[float, float]:
    """Estimated share of right classes among those with true links to other rows: of all, and of those outside large
    components. Links are counted in full within a component, so a class is right if its count is: then all that it
    links to is in its component. Classes without links to other rows don't count; a share of nothing is 1."""
    sizes = checkpointed(found.groupBy("root").agg(F.count("*").alias("size")))
    kind = F.when(F.col("size") > LARGE, 0).when(F.col("size") > 1, 1).otherwise(2)
    placed = nodes.select("cid", "u", "m").join(found, "cid", "left").join(sizes, "root", "left").withColumn("kind", kind)
    placed = checkpointed(placed.select("cid", "u", "m", "kind", F.coalesce("links", F.col("m") - 1).alias("links")))
    held = {r.kind: r.n for r in placed.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    picked = []
    for one in held:
        picked += placed.where(F.col("kind") == one).orderBy(F.xxhash64("cid", F.lit("audit")), "cid").limit(sample).collect()
    if not picked:
        return 1.0, 1.0
    asked = nodes.sparkSession.sparkContext.broadcast(stacked([r.u for r in picked], width).T)  # samples x width numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(asked.value.shape[1], dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                total += part.column("m").to_numpy() @ (stacked(part.column("u").to_pylist(), width) @ asked.value >= threshold)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "n"])

    true = {r.i: r.n for r in nodes.select("u", "m").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    drawn, right, linked = ({k: 0 for k in held} for _ in range(3))
    for i, r in enumerate(picked):
        drawn[r.kind] += 1
        if true[i] > r.m:  # its own rows are always found
            linked[r.kind] += 1
            right[r.kind] += r.links + 1 >= true[i]

    def share(kinds: set[int]) -> float:
        whole, part = (sum(x[k] * held[k] / drawn[k] for k in kinds) for x in (linked, right))
        return part / whole if whole else 1.0

    return share(set(held)), share(set(held) - {0})


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, k: int = K, tables: int = TABLES, rounds: int = ROUNDS, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    n_links: other rows with a cosine of at least `threshold` that were found, in double precision; component_id:
    the least id reachable by links; an audit that never meets `recall` raises a RuntimeError; kept: whether it is the row's own. Vectors that are null, empty, zero or hold
    a null or non-finite component link with nothing. Shorter vectors count as padded with zeros. Rows repeated
    under one id count each; a row with a null id takes part without being a least id, and is never kept. An empty
    table gives an empty result; other columns are not read.
    """
    source = checkpointed(directions(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))))
    classes = source.where(F.col("u").isNotNull()).groupBy("u").agg(F.count("*").alias("m"), F.min("id").alias("least"))
    nodes = checkpointed(classes.withColumn("cid", F.monotonically_increasing_id()))
    facts = nodes.agg(F.count("*").alias("n"), F.max(F.size("u")).alias("d")).first()
    width = facts.d or 1
    graph = Graph(nodes, facts.n, width, threshold, k)
    for attempt in range(ATTEMPTS):
        graph.buckets(range(attempt * tables, (attempt + 1) * tables))
        for _ in range(rounds):
            graph.descend()
        roots = components(graph.links())
        found = checkpointed(_counts(nodes, roots, width, threshold))
        right, small = _audited(nodes, found, width, threshold, AUDIT)
        log.info("NN-descent, attempt %d: %.4f of all linked classes are right, %.4f outside large components", attempt + 1, right, small)
        if min(right, small) >= recall:
            break
    else:
        raise RuntimeError(f"op2: after {ATTEMPTS} attempts {right:.4f} of all linked classes are right and {small:.4f} outside large components, not {recall}")
    named = nodes.join(found, "cid", "left").select("u", "m", "least", F.coalesce("root", "cid").alias("root"), F.coalesce("links", F.col("m") - 1).alias("links"))
    least = checkpointed(named.groupBy("root").agg(F.min("least").alias("component")))
    named = named.join(least, "root").select("u", "links", "component")
    linked = source.where(F.col("u").isNotNull()).join(named, "u").select("id", "links", "component")
    alone = source.where(F.col("u").isNull()).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias("vec_id"), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
