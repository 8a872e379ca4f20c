"""Branches and components of the header forest by pointer jumping and level loops; lineage is cut with checkpoint()."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds after which a loop gives up: pointer jumping needs the logarithm of the longest chain.
MOST_ROUNDS = 40


def _folder(df: DataFrame) -> None:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "/tmp/checkpoints/pegtrail")


def roots(df: DataFrame) -> DataFrame:
    """(hash, root, steps): the ancestor of each row whose parent isn't among the rows, and the steps to it.

    Each round every row jumps to its pointer's pointer. Rows on a cycle, or above one, never settle; each gets the
    least hash that it can reach, and steps -1.
    """
    _folder(df)
    nodes = df.select("hash", "prev_hash")
    known = nodes.select(F.col("hash").alias("prev_hash"), F.lit(True).alias("inside")).distinct()
    at = nodes.join(known, "prev_hash", "left").select("hash", F.when(F.col("inside"), F.col("prev_hash")).otherwise(F.col("hash")).alias("to"), F.when(F.col("inside"), 1).otherwise(0).cast("long").alias("steps"), (~F.coalesce("inside", F.lit(False))).alias("done"), F.least("hash", F.coalesce(F.when(F.col("inside"), F.col("prev_hash")), "hash")).alias("low")).checkpoint()
    before = None
    for _ in range(MOST_ROUNDS):
        # a round that settles no row leaves none that could settle: what is open then only looks for its least hash
        now = at.where("not done").agg(F.count("*"), F.sum(F.xxhash64("hash", "low").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        step = at.select(F.col("hash").alias("to"), F.col("to").alias("t2"), F.col("steps").alias("s2"), F.col("done").alias("d2"), F.col("low").alias("l2"))
        moved = at.where("not done").join(step, "to")
        at = at.where("done").unionByName(moved.select("hash", F.col("t2").alias("to"), (F.col("steps") + F.col("s2")).alias("steps"), F.col("d2").alias("done"), F.least("low", "l2").alias("low"))).checkpoint()
    return at.select("hash", F.when(F.col("done"), F.col("to")).otherwise(F.col("low")).alias("root"), F.when(F.col("done"), F.col("steps")).otherwise(F.lit(-1)).alias("steps"))


def branch_components(df: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Branches of at least `least` members: root, members, tips, and the least and greatest key.

    Tips (no child among the rows) come by key descending, then hash.
    """
    members = df.select("hash", "prev_hash", F.col(key).alias("k")).join(roots(df), "hash")
    parents = df.select(F.col("prev_hash").alias("hash"), F.lit(True).alias("has_child")).distinct()
    marked = members.join(parents, "hash", "left")
    tip = F.when(F.col("has_child").isNull(), F.struct((-F.col("k")).alias("neg"), "hash"))
    g = marked.groupBy("root").agg(F.count("*").alias("depth"), F.array_sort(F.collect_list("hash")).alias("members"), F.transform(F.array_sort(F.collect_list(tip)), lambda t: t["hash"]).alias("tips"), F.min("k").alias("low"), F.max("k").alias("high"))
    return g.where(F.col("depth") >= least)


def stale_branches(block: DataFrame) -> DataFrame:
    """Branches of stale blocks whose competitor is canonical."""
    canonical = block.where("kind = 'canonical'").select(F.col("hash").alias("competitor_hash"))
    return branch_components(block.where("kind = 'stale'").join(canonical, "competitor_hash", "left_semi"), "height")


def orphan_branches(block: DataFrame) -> DataFrame:
    """Branches of linked orphans."""
    from pegtrail.operators.joins import linked_orphans

    return branch_components(linked_orphans(block), "time")


def branch_detail(block: DataFrame) -> DataFrame:
    """For each stale block: its branch's root, its place there and the branch's size."""
    stale = block.where("kind = 'stale'")
    r = roots(stale)
    parents = stale.select(F.col("prev_hash").alias("hash"), F.lit(True).alias("has_child")).distinct()
    size = r.groupBy("root").agg(F.count("*").alias("depth"))
    joined = r.join(parents, "hash", "left").join(size, "root")
    is_root, is_tip = F.col("hash") == F.col("root"), F.col("has_child").isNull()
    place = F.when(is_root & is_tip, "root_and_tip").when(is_root, "root").when(is_tip, "tip").otherwise("interior")
    return joined.select("hash", "root", "depth", place.alias("position"))


def orphan_component(block: DataFrame, cap: int = 128) -> DataFrame:
    """(hash, root, size, capped) of unknown blocks: components by parent links, and whether they are above the cap."""
    r = roots(block.where("kind = 'unknown'"))
    size = r.groupBy("root").agg(F.count("*").alias("size"))
    return r.join(size, "root").select("hash", "root", "size", (F.col("size") > cap).alias("capped"))


def place_components(block: DataFrame, epochs: DataFrame) -> DataFrame:
    """Each component's root height: what its strict members agree on, else the lowest that they imply, else by its epoch.

    A member implies its height less its steps from the root.
    """
    unknown = block.where("kind = 'unknown'")
    r = roots(unknown).join(unknown.select("hash", "height", "time", "orphan_class"), "hash")
    implied = F.when((F.col("orphan_class") == "strict") & F.col("height").isNotNull(), F.col("height") - F.col("steps"))
    g = r.groupBy("root").agg(F.min(implied).alias("low"), F.max(implied).alias("high"), F.min(F.when(F.col("hash") == F.col("root"), F.col("time"))).alias("time"))
    from pegtrail.operators.joins import epoch_asof

    placed = epoch_asof(g, epochs, 1 << 62)
    basis = F.when(F.col("low") == F.col("high"), "exact").when(F.col("low").isNotNull(), "approximate").when(F.col("epoch").isNotNull(), "epoch")
    return placed.select("root", F.coalesce("low", "epoch").alias("root_height"), basis.alias("basis"))


def attach_roots(placed: DataFrame, block: DataFrame, reach: int = 16) -> DataFrame:
    """Each placed root's canonical neighbour: the block one height below if it is the root's parent, else the nearest by height."""
    spine = block.where("kind = 'canonical'").select(F.col("height").alias("h"), F.col("hash").alias("to_hash"))
    parents = block.select(F.col("hash").alias("root"), "prev_hash")
    want = placed.where("root_height is not null").join(parents, "root", "left")
    solid = want.join(spine, (F.col("h") == F.col("root_height") - 1) & (F.col("to_hash") == F.col("prev_hash")))
    around = want.select("root", "root_height", F.explode(F.sequence(F.col("root_height") - reach, F.col("root_height") + reach)).alias("h")).join(spine, "h")
    near = around.groupBy("root").agg(F.min(F.struct(F.abs(F.col("h") - F.col("root_height") + 1).alias("far"), "h", "to_hash")).alias("b"))
    return near.join(solid.select("root", F.col("to_hash").alias("solid")), "root", "left").select("root", F.coalesce("solid", "b.to_hash").alias("to_hash"), F.col("solid").isNotNull().alias("verified"))


def include_branches(block: DataFrame, passing: DataFrame) -> DataFrame:
    """Stale blocks of every branch that has a passing member (passing: hash)."""
    r = roots(block.where("kind = 'stale'"))
    chosen = r.join(passing, "hash", "left_semi").select("root").distinct()
    return r.join(chosen, "root", "left_semi").select("hash", "root")


def tree_edges(nodes: DataFrame, hidden: DataFrame) -> DataFrame:
    """Edges between nodes (hash, prev_hash, kind, height): by parent, and hidden ones along the spine."""
    parent = nodes.select(F.col("hash").alias("from_hash"), F.col("kind").alias("from_kind"))
    direct = nodes.join(parent, F.col("prev_hash") == F.col("from_hash"))
    kind = F.when((F.col("kind") == "canonical") & (F.col("from_kind") == "canonical"), "canonical").when((F.col("kind") == "stale") & (F.col("from_kind") == "canonical"), "stale_entry").otherwise(F.col("kind"))
    spine = nodes.where("kind = 'canonical'")
    skipped = hidden.where("hidden > 0").join(spine.select("height", F.col("hash").alias("to_hash")), "height").join(spine.select(F.col("height").alias("from_height"), F.col("hash").alias("from_hash")), "from_height")
    return direct.select("from_hash", F.col("hash").alias("to_hash"), kind.alias("edge_kind"), F.lit(0).cast("long").alias("hidden")).unionByName(skipped.select("from_hash", "to_hash", F.lit("hidden").alias("edge_kind"), F.col("hidden").cast("long").alias("hidden")))


def cascade(changed: DataFrame, block: DataFrame) -> DataFrame:
    """(hash, round): what must be looked at again: children of what changed, and stale blocks whose competitor did, to a fixpoint.

    A row's round is the least number of links from anything changed. Rounds below 2**k are known after k steps, each of
    which follows paths of twice the length, so that a chain of a million blocks takes twenty. What a step reaches for
    the first time has a round of 2**k or more, and where rounds go on there is one of just 2**k: a step that reaches
    nothing is the last, cycles included.
    """
    _folder(block)
    links = block.select(F.col("prev_hash").alias("source"), "hash").unionByName(block.where("competitor_hash is not null").select(F.col("competitor_hash").alias("source"), "hash"))
    known = block.select(F.col("hash").alias("source")).distinct()
    paths = links.join(known, "source", "left_semi").unionByName(links.join(changed.select(F.col("hash").alias("source")), "source", "left_semi")).distinct().checkpoint()
    seen, length = changed.select("hash", F.lit(0).cast("long").alias("round")).distinct().checkpoint(), 1
    while True:
        new = seen.withColumnRenamed("hash", "source").join(paths, "source").groupBy("hash").agg(F.min(F.col("round") + length).alias("round")).join(seen.select("hash"), "hash", "left_anti").checkpoint()
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new).checkpoint()
        paths = paths.join(paths.select(F.col("source").alias("hash"), F.col("hash").alias("end")), "hash").select("source", F.col("end").alias("hash")).distinct().checkpoint()
        length *= 2


def infer_stale(block: DataFrame) -> DataFrame:
    """(hash, height, competitor_hash): unknown blocks that follow a stale one, one height up, where a canonical block stands there.

    Where blocks have `bits`, those of the unknown block and of the canonical one must be equal. Each round is a height
    up, so the loop ends with the heights of the spine.
    """
    _folder(block)
    bits = ["bits"] if "bits" in block.columns else []
    spine = block.where("kind = 'canonical'").select("height", F.col("hash").alias("competitor_hash"), *bits)
    open_ = block.where("kind = 'unknown'").select("hash", "prev_hash", *bits).checkpoint()
    front = block.where("kind = 'stale'").select(F.col("hash").alias("prev_hash"), F.col("height").alias("below")).checkpoint()
    found = None
    while found is None or not front.isEmpty():
        new = open_.join(front, "prev_hash").select("hash", (F.col("below") + 1).alias("height"), *bits).join(spine, ["height", *bits]).select("hash", "height", "competitor_hash").checkpoint()
        found = new if found is None else found.unionByName(new)
        front = new.select(F.col("hash").alias("prev_hash"), F.col("height").alias("below"))
    return found
