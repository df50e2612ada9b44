"""Shards by a weighted hash tree of regions, racks and shards.

A document descends the tree: at each level every child draws an exponential variate with its weight as rate, from a hash of
the document's key and the child, and the least draw wins, so children win in proportion to their weights. Only the children
of the node that was chosen draw.

Weight that comes later draws for itself. Each change of the tree is a generation with the weight that it adds; at the top the
regions of all generations draw together, and below it a document goes on among the weights of the generation that won. The
least of exponentials is again one with the sum of their rates, so shares follow the weights of all generations together, and
documents whose first generation wins stay where they were: added weight takes documents only into the shards that it was
added to. Weight taken away lowers the rates on the path to its shard, and documents leave only subtrees on that path.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfare.llm.columns import keyed_text, unsigned_share

#: Numbering blocks per shard; slots are counted inside blocks, so no task has to order a whole shard.
SLOT_BLOCKS = 256
REGION, RACK, SHARD = range(3)


@dataclass(frozen=True)
class Tree:
    """Shard weights, and how many shards a rack and racks a region hold; shard numbers fill racks in order.

    ``added`` has the later generations: the weights that each of them added, by shard.
    """

    weights: tuple[float, ...]
    rack_shards: int = 5
    region_racks: int = 4
    added: tuple[tuple[tuple[int, float], ...], ...] = ()

    @staticmethod
    def even(shards: int, rack_shards: int = 5, region_racks: int = 4) -> Tree:
        return Tree((1.0,) * shards, rack_shards, region_racks)

    def grown(self, extra: Mapping[int, float]) -> Tree:
        """The tree with more weight on some shards, old or new; documents move only into these."""
        if any(weight <= 0 for weight in extra.values()):
            raise ValueError("added weights are positive")
        return replace(self, added=(*self.added, tuple(sorted(extra.items()))))

    def shrunk(self, shard: int, factor: float) -> Tree:
        """The tree with the weight of a shard times ``factor``, from 0 to 1; documents leave only its region."""
        if not 0 <= factor <= 1:
            raise ValueError("the factor is from 0 to 1")
        weights = tuple(weight * (factor if number == shard else 1) for number, weight in enumerate(self.weights))
        added = tuple(tuple((number, weight * (factor if number == shard else 1)) for number, weight in change) for change in self.added)
        return replace(self, weights=weights, added=added)

    def generations(self) -> list[dict[int, float]]:
        return [dict(enumerate(self.weights)), *map(dict, self.added)]

    def node_weights(self, level: int) -> list[dict[int, float]]:
        """The weight of each node of a level that has any, by generation."""
        size = {REGION: self.rack_shards * self.region_racks, RACK: self.rack_shards, SHARD: 1}[level]
        sums: list[dict[int, float]] = []
        for shards in self.generations():
            sums.append({})
            for shard, weight in shards.items():
                if weight > 0:
                    sums[-1][shard // size] = sums[-1].get(shard // size, 0.0) + weight
        return sums


def draw(key: Column, level: int, generation: Column, node: Column, weight: Column) -> Column:
    """The variate of a node; without weight it never wins."""
    share = unsigned_share(F.xxhash64(key, F.lit(level), generation, node))
    return F.when(weight > 0, -F.log(share) / weight).otherwise(F.lit(float("inf")))


def _winner(draws: Iterable[tuple[Column, int]]) -> Column:
    """The number beside the least draw, the smaller one in a tie."""
    pairs = [F.struct(drawn.alias("draw"), F.lit(number).alias("number")) for drawn, number in draws]
    return (F.least(*pairs) if len(pairs) > 1 else pairs[0])["number"]


def assign(docs: DataFrame, tree: Tree, *, key: str = "doc_id", into: str = "shard") -> DataFrame:
    """Add the shard of each row. A null key is a key like any other; equal keys share a shard.

    A row draws once per (generation, region), then once per rack of its region and once per shard of its rack.
    """
    tops = [(generation, region, weight) for generation, nodes in enumerate(tree.node_weights(REGION)) for region, weight in sorted(nodes.items())]
    if not tops:
        raise ValueError("a tree needs a shard with a positive weight")
    key_col = F.coalesce(F.col(key).cast("string"), F.lit(""))
    top = _winner((draw(key_col, REGION, F.lit(g), F.lit(region), F.lit(weight)), i) for i, (g, region, weight) in enumerate(tops))
    listed = F.array(*[F.struct(F.lit(g).alias("generation"), F.lit(region).alias("node")) for g, region, _ in tops])
    at = listed[top]
    for level, fan in ((RACK, tree.region_racks), (SHARD, tree.rack_shards)):
        at = _below(at, key_col, level, fan, tree.node_weights(level))
    return docs.withColumn(into, F.coalesce(at["node"], F.lit(-1)))


def _below(at: Column, key: Column, level: int, fan: int, weights: list[dict[int, float]]) -> Column:
    """(generation, node) of the child that wins under a node.

    The node is bound by a function of one array entry. Each level names it once for all draws, so the expression stays small
    when a filter on the shard is pushed through.
    """
    nodes = fan * (1 + max(max(own, default=0) for own in weights) // fan)
    table = F.array(*[F.lit(float(own.get(n, 0.0))) for own in weights for n in range(nodes)])

    def descend(here: Column) -> Column:
        generation, first = here["generation"], here["node"] * fan
        draws = [(draw(key, level, generation, first + child, table[generation * nodes + first + child]), child) for child in range(fan)]
        return F.struct(generation.alias("generation"), (first + _winner(draws)).alias("node"))

    return F.transform(F.array(at), descend)[0]


def slots(rows: DataFrame, shard: str, key: str, *, into: str = "slot", blocks: int = SLOT_BLOCKS) -> DataFrame:
    """Number the rows of each shard from 0 without a gap.

    Rows are ordered inside (shard, block) and shifted by the rows of the shard's earlier blocks. The table of block
    sizes has shards x blocks rows whatever the input, which bounds the broadcast. All columns say which block a row is in, so
    that rows of one key spread too; only rows that are equal in all of them stay together.
    """
    blocked = rows.withColumn("_block", F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)).cast("int"))
    sizes = blocked.groupBy(shard, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(shard).alias("_shard"), F.col("_block").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(shard, "_block").orderBy(key)
    placed = blocked.withColumn("_place", F.row_number().over(inside).cast("long") - 1)
    joined = placed.join(F.broadcast(starts), (F.col(shard) == F.col("_shard")) & (F.col("_block") == F.col("_at")))
    return joined.withColumn(into, F.col("_start") + F.col("_place")).drop("_block", "_shard", "_at", "_start", "_place")


def shard_table(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", row_overhead: int = 16) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard (the shard with one more of them).

    Null texts count as empty and have only the overhead; rows with equal ids share a shard and get slots of their own.
    """
    rows = keyed_text(docs, id_col, text_col).select(
        "doc_id", (F.octet_length("text") + F.lit(row_overhead)).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32")
    )
    tree = Tree.even(shards)
    placed = assign(assign(rows, tree), tree.grown({shards: 1.0}), into="grown_shard")
    numbered = slots(placed, "shard", "doc_id")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
