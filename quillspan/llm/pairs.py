"""Items that appear together: co-occurrence counts and how far they exceed chance.

Basket collapsing: baskets are deduplicated item arrays; identical arrays become one row with a
weight, pairs are enumerated once per distinct array, and the weights are summed. The items of a large basket are
dealt into blocks, and each pair of its blocks is an array that is collapsed and enumerated in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import materialize

LARGE_BASKET = 256
#: Items that are sent to every executor to number the rows: some 50 MB.
BROADCAST_ITEMS = 300_000


def _pairs_of(items: str) -> F.Column:
    """All (a, b), a < b, of a sorted array of ids, as an array of structs."""
    x = F.col(items)
    return F.flatten(
        F.transform(x, lambda a, i: F.transform(F.slice(x, i + 2, F.size(x)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )


def frequent_pairs(
    rows: DataFrame,
    basket: str,
    item: str,
    group: str | None = None,
    min_count: int = 5,
    min_lift: float = 4.0,
    large: int = LARGE_BASKET,
) -> DataFrame:
    """Pairs of items of one group as (grp, item_a, item_b, n_ab, n_a, n_b, n, lift, conviction).

    ``group`` restricts pairs to items of the same group and n to the baskets with any item of it
    (null: one group of all). A pair is kept if n_ab >= min_count and n_ab * n >= min_lift * n_a * n_b;
    item_a < item_b. lift = n_ab * n / (n_a * n_b), conviction of a -> b = (1 - n_b / n) / (1 - n_ab / n_a),
    null where every a has b.

    Null baskets and items are left out, repeated rows count once, an empty table gives no row, other
    columns are ignored.

    Exactness at any size: items with fewer than ``min_count`` baskets, or with n_a > n / min_lift,
    can be in no case (n_ab <= min(n_a, n_b)), so the one item a third of the baskets touch never
    reaches the enumeration when min_lift >= 3. Baskets of more than ``large`` remaining items are never
    gathered into one array: a pair of their items is in the one array of its two blocks (see ``_block_pairs``),
    so no task holds more than about ``large`` items of a basket, and all pairs are counted the same way."""
    g = F.col(group) if group else F.lit("")
    b = F.col(basket)
    # a basket is told by 128 bits of hashes, an item by a number given to it when its row is written
    base = rows.select(b.alias("basket"), F.col(item).alias("item"), F.coalesce(g.cast("string"), F.lit("")).alias("grp")).dropna(subset=["basket", "item"])
    base = base.select(F.xxhash64("basket").alias("b1"), F.xxhash64(F.lit(1), "basket").alias("b2"), "item", "grp")
    base = materialize(base.distinct(), "pair-rows")
    per_item = base.groupBy("grp", "item").agg(F.count(F.lit(1)).alias("n_i"))
    per_group = base.select("grp", "b1", "b2").distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    items = per_item.join(per_group, "grp").filter((F.col("n_i") >= min_count) & (F.col("n") >= min_lift * F.col("n_i")))
    items = materialize(items.select("grp", "item", "n_i", "n", F.monotonically_increasing_id().alias("i")), "pair-items")
    ids = items.select("grp", "item", "i")
    if items.count() <= BROADCAST_ITEMS:  # else the rows are shuffled to the items
        ids = F.broadcast(ids)
    kept = materialize(base.join(ids, ["grp", "item"]).select("b1", "b2", F.xxhash64("grp").alias("g"), "i"), "pair-kept")
    keys = ["g", "b1", "b2"]
    sizes = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > large)
    wide = materialize(sizes, "pair-large-baskets")
    some_wide = not wide.isEmpty()
    narrow = kept.join(wide.select(*keys), keys, "left_anti") if some_wide else kept
    arrays = narrow.groupBy(*keys).agg(F.array_sort(F.collect_list("i")).alias("items")).filter(F.size("items") > 1)
    collapsed = arrays.groupBy("items").agg(F.count(F.lit(1)).alias("w"))  # items of two groups have other numbers
    pairs = collapsed.select("w", F.explode(_pairs_of("items")).alias("p"))
    if some_wide:
        pairs = pairs.unionByName(_block_pairs(kept.join(wide, keys), keys, large))
    counted = pairs.groupBy(F.col("p.a").alias("ia"), F.col("p.b").alias("ib")).agg(F.sum("w").alias("n_ab"))
    counted = counted.filter(F.col("n_ab") >= min_count)
    a = items.select(F.col("i").alias("ia"), "grp", F.col("item").alias("item_a"), F.col("n_i").alias("n_a"), "n")
    c = items.select(F.col("i").alias("ib"), F.col("item").alias("item_b"), F.col("n_i").alias("n_b"))
    out = counted.join(a, "ia").join(c, "ib")
    swap = F.col("item_a") > F.col("item_b")  # numbers needn't be in the order of the names
    x, y = (F.struct(F.col(f"item_{e}").alias("item"), F.col(f"n_{e}").alias("k")) for e in "ab")
    out = out.select("grp", F.when(swap, y).otherwise(x).alias("x"), F.when(swap, x).otherwise(y).alias("y"), "n_ab", "n")
    out = out.select("grp", F.col("x.item").alias("item_a"), F.col("y.item").alias("item_b"), "n_ab", F.col("x.k").alias("n_a"), F.col("y.k").alias("n_b"), "n")
    ab, na, nb, n = (F.col(c) for c in ("n_ab", "n_a", "n_b", "n"))
    return out.filter(ab * n >= min_lift * na * nb).select(
        "grp", "item_a", "item_b", "n_ab", "n_a", "n_b", "n",
        (ab * n / (na * nb)).alias("lift"),
        F.when(ab < na, (1 - nb / n) / (1 - ab / na)).alias("conviction"),
    )


def _block_pairs(rows: DataFrame, keys: list[str], large: int) -> DataFrame:
    """(w, p) of the pairs of items of large baskets: rows (keys, i, c).

    The items of a basket of c items are dealt by hash into blocks of about half of ``large``; each pair of blocks
    is one array, equal arrays are collapsed, and a pair of items is enumerated in the array of its two blocks alone."""
    r = rows.withColumn("k", F.ceil(F.col("c") / F.lit(max(large // 2, 1))).cast("int")).withColumn("b", F.pmod(F.xxhash64("i"), F.col("k")).cast("int"))
    met = r.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    met = met.groupBy(*keys, F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y")).agg(F.array_sort(F.collect_set(F.struct("i", "b"))).alias("items"))
    same = F.col("x") == F.col("y")
    arrays = met.groupBy("items", same.alias("same")).agg(F.count(F.lit(1)).alias("w")).filter(F.size("items") > 1)
    x = F.col("items")
    two = F.flatten(F.transform(x, lambda a, n: F.transform(F.filter(F.slice(x, n + 2, F.size(x)), lambda c: F.col("same") | (c["b"] != a["b"])), lambda c: F.struct(a["i"].alias("a"), c["i"].alias("b")))))
    return arrays.select("w", F.explode(two).alias("p"))
