"""Record linkage: canonical keys from links, and pairs by shared tokens and similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sku as S
from ..functions import text as X
from ..functions.seeded import random32
from ..session import checkpointed, measured
from .components import connected_components

#: Blocks of items and parts of a pinned set that is too large to broadcast.
CELLS = 32
#: Keys of a group that are put beside its members in one part.
EXPANDED = 1000


def _tasks(frame: DataFrame) -> int:
    """Tasks for work that is much larger than its input, so that the engine doesn't join them into few."""
    spark = frame.sparkSession
    return max(CELLS, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def canonical_map(links: DataFrame) -> DataFrame:
    """sku and canonical (the least key of its link group by the order of representatives) for every linked key."""
    named = connected_components(links.select(F.col("from_sku").alias("src"), F.col("to_sku").alias("dst")))
    least = named.groupBy("component").agg(F.min_by("node", S.representative_order(F.col("node"))).alias("canonical"))
    return named.join(least, "component").select(F.col("node").alias("sku"), "canonical")


def canonicalise(rows: DataFrame, mapping: DataFrame, key: str = "sku") -> DataFrame:
    """Rows with canonical: their key's representative, or the key itself. The engine broadcasts the map where statistics show it small."""
    m = mapping.select(F.col("sku").alias(key), "canonical")
    return rows.join(m, key, "left").withColumn("canonical", F.coalesce("canonical", key))


def mapped_keys(links: DataFrame) -> DataFrame:
    return links.select(F.col("from_sku").alias("sku")).union(links.select("to_sku")).distinct()


def without_ignored(pairs: DataFrame, ignores: DataFrame) -> DataFrame:
    """Pairs (a, b) that no ignore rule names in either order."""
    keyed = ignores.select(S.pair_key(F.col("sku_a"), F.col("sku_b")).alias("k_")).where("k_ <> ''").distinct()
    return pairs.withColumn("k_", S.pair_key(F.col("a"), F.col("b"))).join(keyed, "k_", "left_anti").drop("k_")


def store_overlap(pairs: DataFrame, stores: DataFrame) -> DataFrame:
    """Pairs of known keys with whether a store has both."""
    a, b = stores.select(F.col("sku").alias("a"), F.col("stores").alias("sa")), stores.select(F.col("sku").alias("b"), F.col("stores").alias("sb"))
    return pairs.join(a, "a").join(b, "b").withColumn("overlap", F.arrays_overlap("sa", "sb")).drop("sa", "sb")


def without_store_overlap(pairs: DataFrame, stores: DataFrame) -> DataFrame:
    """Pairs whose keys have no store in common."""
    return store_overlap(pairs, stores).where("not overlap").drop("overlap")


def token_blocks(items: DataFrame, tokens: int = 10, bucket: int = 500, candidates: int = 250) -> DataFrame:
    """Candidate pairs (a < b) that share one of their first ``tokens`` distinct tokens, with the number of shared ones.

    The caps are the report's: a token's ``bucket`` first keys and a key's
    ``candidates`` with most shared tokens; they bound the pairs of any token.
    """
    each = items.select("sku", F.explode(F.slice(F.array_distinct(X.tokens(F.col("name"))), 1, tokens)).alias("token"))
    capped = each.withColumn("r_", F.row_number().over(Window.partitionBy("token").orderBy("sku"))).where(F.col("r_") <= bucket).drop("r_")
    pairs = capped.toDF("a", "token").join(capped.toDF("b", "token"), "token").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return pairs.withColumn("r_", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "b"))).where(F.col("r_") <= candidates).drop("r_")


def scored(pairs: DataFrame, items: DataFrame, fine: int = 10, least: float = 0.6) -> DataFrame:
    """Pairs with their exact similarity: each key's ``fine`` best by the cheap score are scored exactly."""
    toks = items.select("sku", "name", X.similarity_tokens(F.col("name")).alias("t"))
    a, b = toks.toDF("a", "name_a", "ta"), toks.toDF("b", "name_b", "tb")
    both = pairs.join(a, "a").join(b, "b")
    args = [F.col(c) for c in ("name_a", "name_b", "ta", "tb")]
    cheap = both.withColumn("cheap", F.round(X.cheap_similarity(*args), 9))
    best = cheap.withColumn("r_", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cheap"), "b"))).where(F.col("r_") <= fine)
    return best.withColumn("score", F.round(X.similarity(*args), 6)).where(F.col("score") >= least).select("a", "b", "cheap", "score")


def _beside(mine: DataFrame, right: DataFrame, small: bool, on: list[str]) -> DataFrame:
    """Pinned rows (a, ...) with items (b, ...) that agree on the columns ``on``; without any, all of them, in blocks.

    Pinned rows of checked size pass each block of items as a broadcast; more of them are copied
    once for each part of the items, so that a value that many items have is no single task.
    """
    if small:
        # Each item costs as many scores as there are pinned ones beside it, so the items are dealt out even if one small file holds them.
        dealt = right.repartition(_tasks(right), "b")
        return dealt.join(F.broadcast(mine), on) if on else dealt.withColumn("cell", F.lit(0)).join(F.broadcast(mine.withColumn("cell", F.lit(0))), "cell").drop("cell")
    every = F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))
    block = F.pmod(F.xxhash64("b"), F.lit(CELLS)).cast("int")
    if on:
        return right.withColumn("block", block).join(mine.withColumn("block", every), [*on, "block"]).drop("block")
    blocks = right.withColumn("block", block).withColumn("part", every)
    return blocks.join(mine.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(CELLS)).cast("int")).withColumn("block", every), ["block", "part"]).drop("block", "part")


def similar_to(pinned: DataFrame, items: DataFrame, k: int = 60, mapped: DataFrame | None = None) -> DataFrame:
    """The k most similar items of each pinned one: a top-k report.

    An equal first token scores 3 x 0.55 = 1.65 at least, another one (2.2 x 0.12 + 0.15) x
    1.12 < 0.47 at most, and an equal society code comes before both. So a pinned name with
    k items of its first token or code has its k best among them, and only the others are
    scored against every item. The pinned names are a query set: they are stored and their
    size is checked (see ``_beside``). A synthetic key on either side raises the score.

    A score depends on the names and on whether the keys are synthetic, so items that agree
    on both are one class and are scored once. Of a class only the first k + 1 items can be
    among a name's k best (one of them may be the name's own), and of the classes, by score
    and first item, only the first k + 1.
    """
    kind = F.concat(F.when(F.col("sku").startswith("u:"), "u").otherwise("k"), F.coalesce(F.concat(F.lit("n"), "name"), F.lit("")))
    rows = items.select("sku", "name", kind.alias("class"))
    asked = checkpointed(rows.join(pinned.select("sku").distinct(), "sku", "left_semi").select("class", F.col("sku").alias("a"), "name"))
    if mapped is not None:
        rows = rows.join(mapped.select("sku"), "sku", "left_anti")
    firsts = rows.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("sku"))).where(F.col("place") <= k + 1)
    firsts = checkpointed(firsts.select(F.col("class").alias("b"), "place", "sku", "name"))

    def tokens(classes: DataFrame, side: str) -> DataFrame:
        name = F.col("name")
        toks = classes.select(F.col("class").alias(side), name.alias(f"name_{side}"), X.similarity_tokens(name).alias(f"t{side}"), X.code_key(name).alias(f"code_{side}"))
        return toks.withColumn(f"first_{side}", F.get(f"t{side}", F.lit(0)))

    mine, small = measured(tokens(asked.select("class", "name").distinct(), "a"))
    right = tokens(firsts.where("place = 1").select(F.col("b").alias("class"), "name"), "b")
    least = firsts.where("place = 1").select("b", F.col("sku").alias("least"))

    def best(scores: DataFrame, by: str, item: str, n: int) -> DataFrame:
        return scores.withColumn("r_", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), item))).where(F.col("r_") <= n).drop("r_")

    def scores(both: DataFrame) -> DataFrame:
        unknown = F.col("a").startswith("u") | F.col("b").startswith("u")
        score = X.similarity(F.col("name_a"), F.col("name_b"), F.col("ta"), F.col("tb")) * F.when(unknown, 1.12).otherwise(1.0)
        score = F.when((F.col("code_a") != "") & (F.col("code_a") == F.col("code_b")), 1e9).otherwise(F.round(score, 6))
        classes = best(both.select("a", "b", score.alias("score")).where("score > 0").join(least, "b"), "a", "least", k + 1)
        return best(classes.join(firsts, "b").select("a", "sku", "score"), "a", "sku", k + 1)

    same_first = _beside(mine.withColumn("first", F.col("first_a")), right.withColumn("first", F.col("first_b")), small, ["first"])
    same_code = _beside(mine.where("code_a <> ''").withColumn("code", F.col("code_a")), right.where("code_b <> ''").withColumn("code", F.col("code_b")), small, ["code"]).where("not (first_a <=> first_b)")
    columns = ["a", "name_a", "ta", "code_a", "b", "name_b", "tb", "code_b"]
    near = checkpointed(scores(same_first.select(*columns).unionByName(same_code.select(*columns))))
    full = near.groupBy("a").count().where(F.col("count") > k).select("a")
    short = checkpointed(mine.join(full, "a", "left_anti"))
    if not short.isEmpty():
        near = near.join(full, "a", "left_semi").unionByName(scores(_beside(short, right, small, [])))
    found = near.select(F.col("a").alias("class"), F.col("sku").alias("b"), "score").join(asked.select("class", "a"), "class").where("a <> b")
    return best(found.select("a", "b", "score"), "a", "b", k)


def same_code(items: DataFrame, rank: Column) -> DataFrame:
    """Each code's best item with the others of that code."""
    coded = items.withColumn("code", X.code_key(F.col("name"))).where("code <> ''").withColumn("rank_", rank)
    anchor = coded.groupBy("code").agg(F.max_by("sku", F.struct("rank_", F.col("sku"))).alias("anchor"))
    return coded.join(anchor, "code").where("sku <> anchor").select("code", "anchor", "sku")


def _order(*names: str) -> Column:
    return F.struct((-F.col("score")).alias("s"), *names)


#: Rounds between looks at components, and pairs up to which a component is settled by one task.
ROUNDS, SETTLED = 8, 100_000


def _settled(left: DataFrame, a: str, b: str, choose: Callable[[list, list, list], list[bool]], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of pairs in components of at most SETTLED pairs those that are taken, and the pairs of larger components.

    choose gets pairs of whole components, each in its order (columns), and says which it
    takes. Components share no key, so many are settled in a task, a batch at a time.
    """
    src, dst = F.concat(F.lit("a:"), F.col(a).cast("string")), F.concat(F.lit("a:" if a == "a" else "b:"), F.col(b).cast("string"))
    named = connected_components(left.select(src.alias("src"), dst.alias("dst"))).toDF("src", "component")
    marked = left.withColumn("src", src).join(named, "src").drop("src")
    sizes = marked.groupBy("component").agg((F.count("*") <= SETTLED).alias("small"))
    marked = checkpointed(marked.join(sizes, "component"))
    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in chain(batches, [None]):
            joined = rest if batch is None else batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if joined is None or joined.empty:
                continue
            # The last component may go on in the next batch.
            open_ = joined["component"] == joined["component"].iloc[-1]
            done, rest = (joined, None) if batch is None else (joined[~open_], joined[open_])
            yield done.loc[choose(*(done[c].tolist() for c in columns)), [a, b, "score"]]

    dealt = marked.where("small").repartition("component").sortWithinPartitions("component", "o").select("component", a, b, "score", *[c for c in columns if c not in (a, b)])
    return dealt.mapInPandas(run, f"`{a}` {kinds[a]}, `{b}` {kinds[b]}, score {kinds['score']}"), marked.where("not small").select(*left.columns)


def _rounds(left: DataFrame, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]], settle: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """What steps take, with components that have become small settled after every ROUNDS steps, so that a long chain of pairs that wait for each other takes no round a pair."""
    done, taken = 0, left.limit(0)
    while not left.isEmpty():
        chosen, left = settle(left) if done % (ROUNDS + 1) == ROUNDS else step(left)
        left, done = checkpointed(left), done + 1
        taken = taken.select(*chosen.columns).unionByName(checkpointed(chosen))
        if done % (ROUNDS + 1) == 0:
            taken = checkpointed(taken)
    return taken


def _one_to_one(a: list, b: list) -> list[bool]:
    used, out = set(), []
    for x, y in zip(a, b, strict=True):
        free = x not in used and y not in used
        if free:
            used |= {x, y}
        out.append(free)
    return out


def _with_room(anchor: list, sku: list, room: list) -> list[bool]:
    used, count, out = set(), {}, []
    for x, y, most in zip(anchor, sku, room, strict=True):
        free = y not in used and count.get(x, 0) < most
        if free:
            used.add(y)
            count[x] = count.get(x, 0) + 1
        out.append(free)
    return out


def greedy_match(pairs: DataFrame, limit: int | None = None, stores: DataFrame | None = None) -> DataFrame:
    """One-to-one pairs (a, b, score) by falling score, then a and b; with ``limit``, the first so many that are accepted.

    A pair that both its keys have as their best is accepted in any order of work, so each
    round takes all such pairs and drops the others of their keys. After every few rounds
    the components left are settled one by one, each by a task, where they have at most
    ``SETTLED`` pairs; rounds go on with larger ones. Pairs with a null key are left out.
    With stores (sku, stores), pairs whose keys share a store are out.
    """
    if stores is not None:
        pairs = without_store_overlap(pairs, stores)
    left = checkpointed(pairs.where("a <> b").groupBy("a", "b").agg(F.max("score").alias("score")).withColumn("o", _order("a", "b")))

    def step(left: DataFrame) -> tuple[DataFrame, DataFrame]:
        best = left.select(F.col("a").alias("k"), "o").union(left.select("b", "o")).groupBy("k").agg(F.min("o").alias("m"))
        chosen = checkpointed(left.join(best.toDF("a", "ma"), "a").join(best.toDF("b", "mb"), "b").where("o = ma and o = mb").select("a", "b", "score"))
        used = chosen.select(F.col("a").alias("k")).union(chosen.select("b")).distinct()
        return chosen, left.join(used.toDF("a"), "a", "left_anti").join(used.toDF("b"), "b", "left_anti").select("a", "b", "score", "o")

    out = _rounds(left, step, lambda left: _settled(left, "a", "b", _one_to_one, ["a", "b"])).select("a", "b", "score")
    return out if limit is None else out.orderBy(F.desc("score"), "a", "b").limit(limit)


def preferred_key(group: DataFrame) -> DataFrame:
    """The preferred key of each group (grp, sku, region): 100 real, +25 with a row of region AB, -10 with one of BC, -1000 synthetic; then the smallest."""
    has = lambda name: F.max((F.col("region") == name).cast("int"))
    score = F.when(F.col("sku").startswith("u:"), -1000).otherwise(100) + F.coalesce(25 * has("AB"), F.lit(0)) - F.coalesce(10 * has("BC"), F.lit(0))
    return group.groupBy("grp", "sku").agg(score.alias("score")).groupBy("grp").agg(F.min_by("sku", F.struct((-F.col("score")).alias("s"), "sku")).alias("sku"))


def capped_pairs(pairs: DataFrame, uses: int = 6) -> DataFrame:
    """Each anchor with at most ``uses`` partners and each partner (sku) once, by falling score, then anchor and partner.

    A partner whose best anchor is full goes to the next. A pair is sure where it is its
    partner's best one left and no more pairs of its anchor that come before it are left
    than the anchor has room for; each round takes these. After every few rounds small
    components are settled, as in ``greedy_match``. Pairs with a null key are left out.
    """
    known = pairs.where("anchor is not null and sku is not null")
    left = checkpointed(known.groupBy("anchor", "sku").agg(F.max("score").alias("score")).withColumn("o", _order("anchor", "sku")).withColumn("room", F.lit(uses).cast("long")))

    def step(left: DataFrame) -> tuple[DataFrame, DataFrame]:
        ranked = left.withColumn("first", F.row_number().over(Window.partitionBy("sku").orderBy("o"))).withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy("o")))
        chosen = checkpointed(ranked.where("first = 1 and place <= room").select("anchor", "sku", "score"))
        full = chosen.groupBy("anchor").agg(F.count("*").alias("n"))
        rest = left.join(chosen.select("sku"), "sku", "left_anti").join(full, "anchor", "left").withColumn("room", F.col("room") - F.coalesce("n", F.lit(0)))
        return chosen, rest.where("room > 0").select(*left.columns)

    return _rounds(left, step, lambda left: _settled(left, "anchor", "sku", _with_room, ["anchor", "sku", "room"])).select("anchor", "sku", "score")


def item_rank(stores: Column, priced: Column, name: Column, sku: Column) -> Column:
    """Rank of an item in its code's bucket: 3 a store, 2 with a price, a half with a name, a quarter with a synthetic key."""
    flag = lambda c, w: F.when(c, w).otherwise(0.0)
    return 3.0 * F.coalesce(stores, F.lit(0)) + flag(priced, 2.0) + flag(F.coalesce(name, F.lit("")) != "", 0.5) + flag(sku.startswith("u:"), 0.25)


def directed(links: DataFrame, order: str) -> DataFrame:
    """from_sku with the target of its last link; a link to itself is none."""
    own = links.where(S.pair_key(F.col("from_sku"), F.col("to_sku"), True) != "")
    return own.groupBy("from_sku").agg(F.max_by("to_sku", F.struct(order, "to_sku")).alias("to_sku"))


def group_members(mapping: DataFrame) -> DataFrame:
    """canonical and its members, in order; the representative is one of them."""
    return mapping.groupBy("canonical").agg(F.array_sort(F.collect_set("sku")).alias("members"))


def expanded(keys: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every key (sku) with each member of its group, itself included: sku, member. The mapping has each key once.

    Keys and members are distinct before they meet, so the pairs are, and are written as
    they come. The keys of a group are dealt out in parts of about ``EXPANDED``, each with
    all members, so that a large group is no single task.
    """
    members = mapping.select("canonical", F.col("sku").alias("member")).union(mapping.select("canonical", "canonical")).distinct()
    parts = members.groupBy("canonical").agg(F.ceil(F.count("*") / EXPANDED).alias("parts"))
    copies = members.join(parts, "canonical").select("canonical", "member", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    named = canonicalise(keys.select("sku").distinct(), mapping).join(parts, "canonical", "left")
    dealt = named.withColumn("part", F.pmod(F.xxhash64("sku"), F.coalesce("parts", F.lit(1)))).repartition(_tasks(keys), "canonical", "part")
    return dealt.join(copies, ["canonical", "part"], "left").select("sku", F.coalesce("member", "sku").alias("member"))


def without_same_group(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Pairs (a, b) whose keys have different representatives."""
    both = canonicalise(canonicalise(pairs, mapping, "a").withColumnRenamed("canonical", "ca"), mapping, "b")
    return both.where("ca <> canonical").select(*pairs.columns)


def sampled(items: DataFrame, n: int = 5000, seed: int = 1, place: str | None = None) -> DataFrame:
    """n items in the order of their draws after a seed: the report's working set, the same on every run.

    An item's draw is the generator's at its place (a column of numbers), by default the crc32 of its key.
    """
    number = F.crc32(F.col("sku").cast("binary")) if place is None else F.col(place)
    return items.orderBy(random32(seed, number), "sku").limit(n)


def region(label: Column) -> Column:
    """The region of a store label, BC before AB. Fixed parts of labels."""
    name = F.lower(F.coalesce(label, F.lit("")))
    return F.when(name.rlike("bcl|strath|gull|legacy"), "BC").when(name.rlike(r"alberta|calgary|edmonton|\bab\b"), "AB").otherwise("")
