"""Groups of duplicates: connected components, representative-validated grouping, chain splitting."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.config import ScanConfig
from kinframe.functions import kernels as K
from kinframe.operators.blocks import _bytes, _differences

_ALL = (1 << 64) - 1


def _folder(spark: SparkSession) -> str:
    """The cluster's shared folder; only where all runs in one process, one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="kinframe-media-")
        atexit.register(shutil.rmtree, own, True)
        where = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """Where intermediate tables go."""
    return _folder(spark)


def kept(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again, which cuts its lineage and survives lost executors."""
    path = f"{_folder(df.sparkSession)}/media-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component) of the graph with long edges a, b; component is the smallest id.

    Alternates large-star and small-star steps, each one shuffle of the edges, until nothing changes; the
    number of rounds grows with the logarithm of the graph.
    """
    left = kept(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = kept(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    before = None
    for _ in range(rounds):
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        left = kept(small.select("e.a", "e.b").where("a <> b").distinct())
        state = left.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"connected_components: the graph hasn't settled in {rounds} rounds")
    low = left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
    return nodes.join(low, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def similarity_test(config: ScanConfig):
    """similar(x, y) of two members by the configured metric, without any gate: what representatives are held to.

    A member has image, hashes (one a position; videos) and frame (bytes, all positions one after the other).
    Images go by frames in every mode; masks hold here too.
    """
    single = np.float32(config.limit)

    def similar(x: dict, y: dict) -> bool:
        if config.use_phash and not x["image"]:
            a, b = x["hashes"], y["hashes"]
            return len(a) == len(b) > 0 and None not in a and None not in b and all(((int(p) ^ int(q)) & _ALL).bit_count() <= config.max_bits for p, q in zip(a, b))
        a, b = x["frame"], y["frame"]
        if not a or not b or len(a) != len(b):
            return False
        a, b = (np.frombuffer(f, dtype=np.uint8)[None] for f in (a, b))
        many = 1 if x["image"] else x["positions"]
        return bool(_differences(a, b, many, config.ignore_black, config.ignore_white)[0, 0].astype(np.float32) <= single)

    return similar


def link_matrix(members: list[dict], config: ScanConfig) -> np.ndarray:
    """similarity_test() of all members with one another, by blocks: entry [i, j] says whether i is similar to j."""
    n, single = len(members), np.float32(config.limit)
    out = np.zeros((n, n), dtype=bool)
    by_hash = np.array([config.use_phash and not m["image"] for m in members], dtype=bool)
    if by_hash.any():
        sizes: dict[int, list[int]] = {}
        for i, m in enumerate(members):
            if len(m["hashes"]) and not any(h is None for h in m["hashes"]):
                sizes.setdefault(len(m["hashes"]), []).append(i)
        for ids in sizes.values():
            h = np.array([[int(x) & _ALL for x in members[i]["hashes"]] for i in ids], dtype=np.uint64)
            for k in range(0, len(ids), 256):
                near = (np.bitwise_count(h[k : k + 256, None] ^ h[None]) <= config.max_bits).all(axis=2)
                out[np.ix_(ids[k : k + 256], ids)] = near
        out &= by_hash[:, None]
    sizes = {}
    for i, m in enumerate(members):
        if m["frame"]:
            sizes.setdefault(len(m["frame"]), []).append(i)
    for size, ids in sizes.items() if not by_hash.all() else ():
        f = np.frombuffer(b"".join([members[i]["frame"] for i in ids]), dtype=np.uint8).reshape(len(ids), size)
        for many in {1 if members[i]["image"] else members[i]["positions"] for i in ids}:
            rows = [k for k, i in enumerate(ids) if not by_hash[i] and (1 if members[i]["image"] else members[i]["positions"]) == many]
            for k in range(0, len(rows), 256):
                some = rows[k : k + 256]
                with np.errstate(invalid="ignore"):
                    out[np.ix_([ids[r] for r in some], ids)] = _differences(f[some], f, many, config.ignore_black, config.ignore_white).astype(np.float32) <= single
    np.fill_diagonal(out, False)
    return out


def resolve(members: dict[int, dict], pairs: list[tuple[int, int, float, bool]], similar, known: dict[int, int] | None = None, merged: dict[int, int] | None = None) -> dict[int, dict]:
    """Greedy grouping, pairs in order of (a, b): {id: group, difference, flipped} of the items that it admits.

    A pair of ungrouped items founds a group whose representative is the smaller one; its id names the group. An item
    joins, and two groups merge, only if ``similar(representative, other)`` holds without any gate; the group of the
    pair's first item absorbs the other. Each item keeps the difference of the pair that first admitted it.
    ``known`` tells the groups of items that earlier pairs have put there; ``merged`` is filled with the groups that
    another one absorbed, and that one.
    """
    merged = {} if merged is None else merged
    group: dict[int, int] = dict(known or {})
    out: dict[int, dict] = {}

    def of(i):
        g = group.get(i)
        while g in merged:
            g = merged[g]
        return g

    def admit(i, g, diff, flip):
        group[i] = g
        out[i] = {"difference": diff, "flipped": flip}

    for a, b, diff, flip in sorted(pairs, key=lambda p: p[:2]):
        ga, gb = of(a), of(b)
        if ga is None and gb is None:
            admit(a, a, diff, False)
            admit(b, a, diff, flip)
        elif ga is not None and gb is not None:
            if ga != gb and similar(members[ga], members[gb]):
                merged[gb] = ga
        elif ga is not None:
            if similar(members[ga], members[b]):
                admit(b, ga, diff, flip)
        elif similar(members[gb], members[a]):
            admit(a, gb, diff, False)
    for i in out:
        out[i]["group"] = of(i)
    for g in list(merged):
        while merged[g] in merged:
            merged[g] = merged[merged[g]]
    return out


def peel(ids: list[int], link: np.ndarray) -> list[list[int]]:
    """Parts of a group in which everyone is similar to at least half: the first least-linked member goes until
    that holds; those that went form components by similarity, which are split by the same rule. Parts have two or more.

    link[i, j] says whether the i-th is similar to the j-th. Degrees are kept while members go, a row of numbers each.
    """
    work, done = [np.arange(len(ids))], []
    while work:
        now = work.pop(0)
        if len(now) < 2:
            continue
        if len(now) == 2:
            done.append([ids[i] for i in now])
            continue
        own = link[np.ix_(now, now)]
        degree, left, there, gone = own.sum(axis=1).astype(np.int64), len(now), np.ones(len(now), dtype=bool), []
        while left > 1:
            least = int(np.where(there, degree, len(now)).argmin())  # the first of the least linked
            if degree[least] >= left // 2:
                break
            there[least] = False
            gone.append(least)
            left -= 1
            degree[own[least]] -= 1
        if left > 1:
            done.append([ids[i] for i in now[there]])
        away = ~there
        for i in gone:
            if away[i]:
                part, front = [], np.array([i])
                away[i] = False
                while len(front):
                    part += front.tolist()
                    front = np.flatnonzero(own[front].any(axis=0) & away)
                    away[front] = False
                if len(part) < len(now):
                    work.append(now[np.sort(part)])
    return done


def split_chains(ids: list[int], linked) -> list[list[int]]:
    """peel() by a test of two members."""
    return peel(ids, np.array([[i != j and bool(linked(i, j)) for j in ids] for i in ids], dtype=bool).reshape(len(ids), len(ids)))


def _as_bytes(frames: pd.Series) -> pd.Series:
    return pd.Series([_bytes(f) for f in frames], dtype=object)


_MEMBER = ["image", "hashes", "frame"]


def _info(rows: pd.DataFrame, positions: int) -> dict[int, dict]:
    return {i: {"image": im, "hashes": () if h is None else h, "frame": f, "positions": positions} for i, im, h, f in zip(rows["id"].tolist(), rows["image"].tolist(), rows["hashes"], rows["frame"])}


def _in_tasks(left: DataFrame, state: DataFrame, members: DataFrame, config: ScanConfig, positions: int) -> DataFrame:
    """(kind, id, to, difference, flipped) after resolve() of the pairs ``left``, a component a task: items that a group admits, and groups that another one absorbs.

    Only items of these pairs and the representatives of their groups go along.
    """
    similar = similarity_test(config)
    ids = left.select("part", F.explode(F.array("a_id", "b_id")).alias("id")).distinct()
    ids = ids.join(state.select("id", "rep"), "id", "left")
    need = ids.select("part", "id", "rep", F.lit(True).alias("own")).unionByName(ids.where("rep IS NOT NULL").select("part", F.col("rep").alias("id"), F.col("rep"), F.lit(False).alias("own")))
    need = need.groupBy("part", "id").agg(F.max("rep").alias("rep"), F.max("own").alias("own"))  # a representative's group is its own id
    need = need.select(F.col("part").alias("component"), "id", "rep", "own").join(members, "id")

    def one(m: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        known = {int(i): int(r) for i, r in zip(m["id"], m["rep"]) if r == r and r is not None}
        merged: dict[int, int] = {}
        found = resolve(_info(m, positions), list(zip(e["a_id"].tolist(), e["b_id"].tolist(), e["difference"].tolist(), e["flipped"].tolist())), similar, known, merged)
        rows = [("admit", i, x["group"], x["difference"], x["flipped"]) for i, x in found.items()]
        rows += [("merge", g, to, 0.0, False) for g, to in merged.items()]
        return pd.DataFrame(rows, columns=["kind", "id", "to", "difference", "flipped"])

    kind = "kind string, id long, to long, difference double, flipped boolean"
    return need.groupBy("component").cogroup(left.groupBy("part")).applyInPandas(one, kind)


def _reserved(left: DataFrame, state: DataFrame, members: DataFrame, config: ScanConfig, positions: int) -> tuple[DataFrame, DataFrame]:
    """(pairs that are settled, changes as _in_tasks() tells them) of one round of reservations.

    A pair touches two things, each a group or an item in none: it writes the item that it would admit, both items
    if it would found a group, or the group that would be absorbed; the other thing it reads, as its representative
    stays what it is. But what it writes becomes part of what it reads: from then on, other pairs of the one touch the
    other. A pair is settled now if no earlier one writes what it touches, none touches what it writes, and nothing
    that it touches gains a part which another pair touches before its turn. Then the sequential order would
    settle it in the same state; the first pair of all always is, and all items of a group mostly join in one round.
    """
    of = lambda s: state.select(F.col("id").alias(f"{s}_id"), F.col("rep").alias(f"g{s}"))
    named = left.join(of("a"), "a_id", "left").join(of("b"), "b_id", "left")
    prio, write_a, write_b = F.struct("a_id", "b_id"), F.col("ga").isNull(), F.col("gb").isNull() | F.col("ga").isNotNull()
    named = kept(named.select("*", prio.alias("prio"), F.coalesce("ga", "a_id").alias("ca"), F.coalesce("gb", "b_id").alias("cb"), write_a.alias("wa"), write_b.alias("wb")))
    same = named.where("ga = gb")
    open_ = named.where("ga IS NULL OR gb IS NULL OR ga <> gb")
    touches = open_.select("prio", F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("wa").alias("w")), F.struct(F.col("cb").alias("c"), F.col("wb").alias("w")))).alias("x")).select("prio", "x.c", "x.w")
    first = touches.groupBy("c").agg(F.min("prio").alias("any"), F.min(F.when(F.col("w"), F.col("prio"))).alias("write"))
    second = touches.join(first.select("c", "any"), "c").where(F.col("prio") > F.col("any")).groupBy("c").agg(F.min("prio").alias("next"))
    first = first.join(second, "c", "left")
    # when what is read gains a part that another pair touches
    gains = open_.where("wa <> wb").select("prio", F.when(F.col("wb"), F.col("ca")).otherwise(F.col("cb")).alias("reads"), F.when(F.col("wb"), F.col("cb")).otherwise(F.col("ca")).alias("c"))
    other = F.when(F.col("any") == F.col("prio"), F.col("next")).otherwise(F.col("any"))
    gains = gains.join(first, "c").select("reads", F.col("prio").alias("p"), other.alias("o")).where("o IS NOT NULL").groupBy(F.col("reads").alias("c")).agg(F.min(F.greatest("p", "o")).alias("gain"))
    first = kept(first.join(gains, "c", "left"))
    for s in ("a", "b"):
        open_ = open_.join(first.select(F.col("c").alias(f"c{s}"), F.col("any").alias(f"any_{s}"), F.col("write").alias(f"write_{s}"), F.col("gain").alias(f"gain_{s}")), f"c{s}")
        not_before = lambda c: F.col(c).isNull() | (F.col(c) >= F.col("prio"))
        open_ = open_.where(not_before(f"write_{s}") & not_before(f"gain_{s}") & (~F.col(f"w{s}") | not_before(f"any_{s}")))
    free = open_.select("a_id", "b_id", "difference", "flipped", "ga", "gb")
    founds = F.col("ga").isNull() & F.col("gb").isNull()
    tested = free.where(~founds).select("*", F.coalesce("ga", "gb").alias("rep"), F.when(F.col("ga").isNull(), F.col("a_id")).when(F.col("gb").isNull(), F.col("b_id")).otherwise(F.col("gb")).alias("other"))
    side = lambda s: members.select(F.col("id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in _MEMBER))
    tested = tested.join(side("rep"), "rep").join(side("other"), "other")
    similar, names = similarity_test(config), ["a_id", "b_id", "difference", "flipped", "ga", "gb"]

    def test(batches):
        for b in batches:
            info = [{"image": im, "hashes": () if h is None else h, "frame": f, "positions": positions} for s in ("rep", "other") for im, h, f in zip(b[f"{s}_image"].tolist(), b[f"{s}_hashes"], b[f"{s}_frame"])]
            ok = [similar(x, y) for x, y in zip(info[: len(b)], info[len(b) :])]
            yield b[names].assign(ok=ok)

    checked = tested.mapInPandas(test, "a_id long, b_id long, difference double, flipped boolean, ga long, gb long, ok boolean")
    settled = kept(free.where(founds).withColumn("ok", F.lit(True)).unionByName(checked))
    row = lambda k, i, to, flip: F.struct(F.lit(k).alias("kind"), i.alias("id"), to.alias("to"), "difference", flip.alias("flipped"))
    no, a, b = F.lit(False), F.col("a_id"), F.col("b_id")
    change = F.when(founds, F.array(row("admit", a, a, no), row("admit", b, a, F.col("flipped"))))
    change = change.when(F.col("gb").isNull(), F.array(row("admit", b, F.col("ga"), F.col("flipped")))).when(F.col("ga").isNull(), F.array(row("admit", a, F.col("gb"), no)))
    change = change.otherwise(F.array(row("merge", F.col("gb"), F.col("ga"), no)))
    changes = settled.where("ok").select(F.explode(change).alias("r")).select("r.*")
    return settled.select("a_id", "b_id").unionByName(same.select("a_id", "b_id")), changes


def _applied(state: DataFrame, changes: DataFrame) -> DataFrame:
    merges = changes.where("kind = 'merge'").select(F.col("id").alias("rep"), F.col("to").alias("into"))
    moved = state.join(merges, "rep", "left").select("id", F.coalesce("into", "rep").alias("rep"), "difference", "flipped")
    return kept(moved.unionByName(changes.where("kind = 'admit'").select("id", F.col("to").alias("rep"), "difference", "flipped")))


#: Pairs of a component that one task resolves, and share of the pairs that a round of reservations should settle at least.
PER_TASK, SHARE = 100_000, 0.05


def resolved(members: DataFrame, pairs: DataFrame, config: ScanConfig, positions: int = 1, per_task: int | None = None) -> DataFrame:
    """(id, rep, difference, flipped) of grouped items: what resolve() makes of all pairs in order, rep naming the group.

    ``members`` has id, image, hashes and frame; ``pairs`` part (the component), a_id, b_id, difference and flipped.
    Components of up to ``per_task`` pairs are resolved in a task each. Larger ones go by rounds of reservations over
    all tasks; where a round settles little, as on a long chain, the first ``per_task`` pairs of all are resolved
    in tasks, which is their order as well. So no task holds more, and rounds are bounded by the number of pairs.
    """
    per_task, spark = per_task or PER_TASK, members.sparkSession
    left = pairs.select("part", "a_id", "b_id", "difference", "flipped")
    state = spark.createDataFrame([], "id long, rep long, difference double, flipped boolean")
    while True:
        sizes = left.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        large = kept(sizes.where(F.col("n") > per_task))
        n = large.agg(F.sum("n")).first()[0]
        here = left.join(large, "part", "left_anti") if n else left
        state = _applied(state, kept(_in_tasks(here, state, members, config, positions)))
        if not n:
            return state
        left = left.join(large.select("part"), "part", "left_semi")
        done, changes = _reserved(left, state, members, config, positions)
        state = _applied(state, kept(changes))
        after = kept(left.join(done, ["a_id", "b_id"], "left_anti"))
        if after.count() > (1 - SHARE) * n:
            some = kept(after.orderBy("a_id", "b_id").limit(per_task))
            state = _applied(state, kept(_in_tasks(some, state, members, config, positions)))
            after = kept(after.join(some.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti"))
        left = after


def duplicate_groups(items: DataFrame, pairs: DataFrame, config: ScanConfig, split: bool = True, per_task: int | None = None) -> DataFrame:
    """(id, group_id, difference, flipped) of grouped items; group_id is the group's smallest id.

    ``pairs`` has a_id, b_id, difference, flipped; ``items`` id, lo, hi, frame (or hashes and frames, one a
    position) and is_image. Pairs are resolved in the order of (a_id, b_id), so the result doesn't depend on
    partitions; see resolved() for how large components are spread. Groups of three or more are split where members
    are similar to less than half of them, a group a task: its links are computed by blocks of members, one byte each.
    """
    pairs = kept(pairs.select("a_id", "b_id", "difference", "flipped"))
    comp = kept(connected_components(pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))))
    hashes = F.col("hashes") if "hashes" in items.columns else F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.array(K.whole_hash(F.col("lo"), F.col("hi"))))
    image = F.coalesce("is_image", F.lit(False)) if "is_image" in items.columns else F.lit(False)
    several = "frames" in items.columns
    frame = F.pandas_udf(_as_bytes, "binary")("frames" if several else "frame") if not config.use_phash or "is_image" in items.columns else F.lit(None).cast("binary")
    members = kept(items.join(comp.select("id"), "id", "left_semi").select("id", image.alias("image"), hashes.alias("hashes"), frame.alias("frame")))
    edges = pairs.join(comp.withColumnRenamed("id", "a_id"), "a_id").select(F.col("component").alias("part"), "a_id", "b_id", "difference", "flipped")
    positions = config.positions if several else 1
    found = resolved(members, kept(edges), config, positions, per_task)
    groups = kept(found.groupBy("rep").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")))
    named = found.join(groups, "rep")
    whole = named if not split else named.where("n < 3")
    whole = whole.select("id", "group_id", "difference", "flipped")
    if not split:
        return whole
    links = config

    def parts_of(m: pd.DataFrame) -> pd.DataFrame:
        m = m.sort_values("id")
        info = _info(m, positions)
        ids = m["id"].tolist()
        part = {i: min(p) for p in peel(ids, link_matrix([info[i] for i in ids], links)) for i in p}
        m = m[[i in part for i in ids]]
        return pd.DataFrame({"id": m["id"], "group_id": [part[i] for i in m["id"].tolist()], "difference": m["difference"], "flipped": m["flipped"]})

    large = named.where("n > 2").join(members, "id").select("group_id", "id", "difference", "flipped", *_MEMBER)
    return whole.unionByName(large.groupBy("group_id").applyInPandas(parts_of, "id long, group_id long, difference double, flipped boolean"))
