"""Near-duplicates: fast similarity sketches, banding, exact verification, connected components.

The sketch throws every shingle of a text into one of T bins per round; rounds go on until every bin is full, and
rounds T to 2T-1 fill one bin each for certain, so each coordinate is filled, agrees between two sets with a probability
equal to their Jaccard similarity, and concentrates like independent ones.

Pairs are never made from all members of a bucket. Equal sets are one row. In each bucket the members are first held
against one hub, the member with the smallest share of shingles of its own; members without enough shingles in common
with others cannot link and go. Buckets that the links through hubs leave in several parts are searched in blocks inside
tasks, where the rarest shingles of each set make the candidates; only links that join components come out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.hashing import U, chunks, mix, shingle_sets, words
from tidewatch.llm.skew import fresh, salted_join, spread_join
from tidewatch.operators.components import connected_components
from tidewatch.runtime import again, forget, maybe_broadcast, written

COORDINATES, BANDS = 128, 32
#: Shingles (8 bytes each) of the two sides of a task that searches blocks, and of a shard that counts shingles.
BLOCK, OTHERS, SHARD = 1 << 18, 1 << 20, 1 << 20
KEY_BYTES = 48


def sketch(elements: np.ndarray, owner: np.ndarray, n: int, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches of ``n`` sets, ``t`` (a power of two up to 128) coordinates each: for every bin the
    smallest (round, hash) that fell into it. Sets without elements keep unfilled bins."""
    bits, best = t.bit_length() - 1, np.full(n * t, ~U(0), U)
    for i in range(2 * t):
        h = mix(elements ^ mix(np.array([i + 1], U) * U(0xD1B54A32D192ED03)))
        bin_ = (h >> U(64 - bits)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(best, owner * t + bin_, (U(i) << U(56)) | ((h << U(bits)) >> U(8)))
        open_ = (best.reshape(n, t) == ~U(0)).any(1)[owner]
        elements, owner = elements[open_], owner[open_]
        if not len(elements):
            break
    return best.reshape(n, t)


def band_keys(sketches: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, t = sketches.shape
    parts = sketches.reshape(n, bands, t // bands)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U)), (n, bands)).copy()
    for k in range(t // bands):
        out = mix(out * U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, n_shingles, digest of the set, band keys (null digest and keys for empty sets)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            ids = x["id"]
            for start, texts in chunks(x["text"].tolist()):
                sets = shingle_sets(*words(texts), len(texts), shingle)
                sizes = np.array([len(s) for s in sets])
                keys = band_keys(sketch(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets)))
                yield pd.DataFrame({
                    "id": ids.iloc[start : start + len(texts)].to_numpy(), "n": sizes,
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "keys": [k if m else None for k, m in zip(keys, sizes)],
                })

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, "id string, n long, digest binary, keys array<long>")
    return out.withColumn("id", F.col("id").cast(kind))


def set_rows(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int, limit: int) -> DataFrame:
    """id and sorted shingle hashes (binary) of the wanted ids, from whole texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            ids = x["id"]
            for start, texts in chunks(x["text"].tolist()):
                sets = shingle_sets(*words(texts), len(texts), shingle)
                yield pd.DataFrame({"id": ids.iloc[start : start + len(texts)].to_numpy(), "set": [s.tobytes() for s in sets]})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(maybe_broadcast(wanted.select("id"), 24, limit), "id", "left_semi").withColumn("id", F.col("id").cast("string"))
    return rows.mapInPandas(run, "id string, set binary").withColumn("id", F.col("id").cast(kind))


def own_counts(sets: DataFrame, bits: int) -> DataFrame:
    """id and how many of its shingles no other row of ``sets`` has. Shingles travel packed, by batch and shard; ``bits``
    of a shingle's hash choose its shard."""
    kind = sets.schema["id"].dataType.simpleString()

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            for a in range(0, len(x), 512):
                own = [np.frombuffer(s, U) for s in x["set"].iloc[a : a + 512]]
                ids = x["id"].iloc[a : a + 512].to_numpy()
                hashes, at = np.concatenate(own), np.repeat(np.arange(len(own), dtype=np.int32), [len(s) for s in own])
                shard = (hashes >> U(63 - bits) >> U(1)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                hashes, at, edges = hashes[order], at[order], np.searchsorted(shard[order], np.arange((1 << bits) + 1))
                rows = [(s, ids[np.unique(at[i:j])].tolist(), hashes[i:j].tobytes(), np.unique(at[i:j], return_inverse=True)[1].astype(np.int32).tobytes()) for s, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if i < j]
                yield pd.DataFrame(rows, columns=["shard", "ids", "hashes", "at"])

    def alone(x: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([np.frombuffer(b, U) for b in x["hashes"]])
        first = np.cumsum([0, *(len(i) for i in x["ids"])])
        at = np.concatenate([np.frombuffer(b, np.int32) + k for b, k in zip(x["at"], first)])
        ids = np.concatenate([np.asarray(i) for i in x["ids"]])
        _, where, counts = np.unique(hashes, return_index=True, return_counts=True)
        n = np.bincount(at[where[counts == 1]], minlength=len(ids))
        return pd.DataFrame({"id": ids[n > 0], "own": n[n > 0]})

    dealt = sets.mapInPandas(deal, f"shard long, ids array<{kind}>, hashes binary, at binary")
    return dealt.groupBy("shard").applyInPandas(alone, f"id {kind}, own long").groupBy("id").agg(F.sum("own").alias("own"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    @F.pandas_udf("boolean")
    def linked(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in parts:
            out = []
            for x, y in zip(left, right):
                both = np.concatenate([np.frombuffer(x, U), np.frombuffer(y, U)])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                out.append(100 * shared >= percent * (len(both) - shared))
            yield pd.Series(out, dtype=bool)

    pairs = written(pairs.select("a", "b"), "near-pairs")
    of_b = written(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("pairs")), "near-of-b")
    total = of_b.agg(F.sum("pairs")).first()[0] or 0
    rows = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")  # a stands in a few pairs, b may in many
    rows = salted_join(rows, of_b.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b"), "b", "pairs", total, ["a"])
    out = written(rows.filter(linked("set_a", "set_b")).select("a", "b"), "near-links")
    forget(pairs, of_b)
    return out


def joining_links(few: list, rest: list, percent: int, parent: dict | None = None) -> list[tuple]:
    """Links between sets of ``few`` and of ``rest`` (each: id, component, sorted hashes) that join components still
    apart (in ``parent``, which is kept up), each a pair of ids. Exact: with the shingles of both sides ordered from rare to common, sets that are similar
    enough share one of the first n - ceil(n percent / 100) + 1."""
    parent = {} if parent is None else parent

    def root(c):
        while parent.setdefault(c, c) != c:
            c = parent[c] = parent[parent[c]]
        return c

    index: list = []

    def overlaps(y: np.ndarray, found: list) -> list[int]:
        """The intersections of ``y`` with sets of ``few``, one by one if they are few, else counted over an index."""
        if len(found) < 16:
            return [len(np.intersect1d(y, few[x][2], assume_unique=True)) for x in found]
        if not index:
            hashes, of = np.concatenate([s for _, _, s in few]), np.repeat(np.arange(len(few)), [len(s) for _, _, s in few])
            order = np.argsort(hashes)
            index.extend((hashes[order], of[order]))
        low, n = np.searchsorted(index[0], y), np.searchsorted(index[0], y, "right")
        n -= low
        hit = index[1][np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return np.bincount(hit, minlength=len(few))[found].tolist()

    size = np.array([len(s) for _, _, s in (*few, *rest)], np.int64)
    flat = np.concatenate([s for _, _, s in (*few, *rest)])
    order = np.argsort(flat)
    first = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
    counts = np.diff(np.concatenate([first, [len(flat)]]))
    rank = np.empty(len(flat), U)
    rank[order] = np.repeat(np.minimum(counts, 0xFFFF), counts)
    rank = (rank << U(48)) | (flat >> U(16))  # rare before common, then by hash; equal ranks only make more candidates
    need = size - (-(-size * percent // 100)) + 1
    prefix = [np.partition(part, n - 1)[:n] for part, n in zip(np.split(rank, np.cumsum(size)[:-1]), need.tolist())]
    seek, held = np.concatenate(prefix[: len(few)]), np.repeat(np.arange(len(few)), need[: len(few)])
    order = np.argsort(seek)
    seek, held, own = seek[order], held[order], size[: len(few)]
    out = []
    for at in range(0, len(rest), 256):
        part = prefix[len(few) + at : len(few) + at + 256]
        sought, who = np.concatenate(part), np.repeat(np.arange(len(part)), [len(x) for x in part])
        low, n = np.searchsorted(seek, sought), np.searchsorted(seek, sought, "right")
        n -= low
        match = held[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        k, j = np.divmod(np.unique(np.repeat(who, n) * len(few) + match), len(few))
        sizes = size[len(few) + at + k], own[j]
        fits = 100 * np.minimum(*sizes) >= percent * np.maximum(*sizes)
        k, j = k[fits], j[fits]
        edges = np.searchsorted(k, np.arange(len(part) + 1))
        for n in range(len(part)):
            i, c, y = rest[at + n]
            found = [x for x in j[edges[n] : edges[n + 1]].tolist() if root(few[x][1]) != root(c)]
            for x, shared in zip(found, overlaps(y, found)):
                a, b = root(c), root(few[x][1])
                if a != b and 100 * shared >= percent * (len(y) + len(few[x][2]) - shared):
                    parent[a] = b
                    out.append((i, few[x][0]))
    return out


def linked_in_blocks(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different components inside buckets; ``apart`` has key, id, n (shingles), component.

    Buckets with the same members count once. The members outside a bucket's largest component, in blocks of BLOCK
    shingles, meet all its members, in blocks of OTHERS, so every pair of a bucket that is not joined yet is looked for
    on full sets, inside one task for each two blocks (a document over a block's size is a block). Buckets of one block
    share tasks, small ones with the same first member the same task, which gets each of its sets once. Only links that
    join two components still apart in the task leave it: fewer than documents."""
    same = apart.groupBy("key").agg(F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("ids"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(20,0)")).alias("more"), F.count(F.lit(1)).alias("members"))
    once = same.groupBy("ids", "more", "members").agg(F.min("key").alias("key")).select("key")
    sizes = apart.join(once, "key", "left_semi").groupBy("key", "component").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("members"), F.min("id").alias("first"))
    top = F.max(F.struct("n", "component")).alias("top")
    sizes = sizes.groupBy("key").agg(top, F.sum("n").alias("all"), F.sum("members").alias("members"), F.min("first").alias("first"))
    blocks = lambda n, size: F.greatest(F.ceil(n / size), F.lit(1).cast("long"))
    sizes = sizes.select("key", "members", "first", "all", F.col("top.component").alias("main"), blocks(F.col("all") - F.col("top.n"), BLOCK).alias("ks"), blocks(F.col("all"), OTHERS).alias("js"))
    sizes = written(sizes.withColumn("alone", F.expr("ks > 1 or js > 1")), "near-buckets")
    sums = sizes.agg(F.sum("members"), F.sum(F.when(~F.col("alone"), F.col("all")))).first()
    total, tasks = sums[0] or 0, max(1, 4 * (sums[1] or 0) // BLOCK)
    placed = sizes.withColumn("task", F.when(F.col("alone"), F.col("key")).otherwise(F.pmod(F.xxhash64(F.when(F.col("all") > BLOCK // 16, F.col("key")), "first"), F.lit(tasks)))).drop("all", "first")
    docs = spread_join(apart.select("key", "id", "component"), placed, ["key"], "members", total, KEY_BYTES).filter("main is not null")
    slot = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = ["alone", "task", "k", "j"]
    few = docs.filter("component <> main").withColumns({"k": slot("ks"), "j": every("js"), "few": F.lit(True)})
    rest = docs.withColumns({"k": every("ks"), "j": slot("js"), "few": F.lit(False)})
    members = written(few.unionByName(rest).select(*place, "key", "few", "id", "component"), "near-blocks")
    held = again(members).select(*place, "id").distinct().join(sets, "id")
    kind = sets.schema["id"].dataType.simpleString()

    def search(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        of, parent, out = {i: np.frombuffer(s, U) for i, s in zip(y["id"].tolist(), y["set"])}, {}, []
        rows: dict = {}
        for key, is_few, i, c in sorted(zip(x["key"].tolist(), x["few"].tolist(), x["id"].tolist(), x["component"].tolist())):
            rows.setdefault(key, ([], []))[0 if is_few else 1].append((i, c, of[i]))
        for few, rest in rows.values():
            if few and rest:
                out += joining_links(few, rest, percent, parent)
        return pd.DataFrame(out, columns=["a", "b"])

    out = members.groupBy(*place).cogroup(held.groupBy(*place)).applyInPandas(search, f"a {kind}, b {kind}").distinct()
    out = written(out, "near-links")
    forget(sizes, members)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, broadcast_limit: int = 32 << 20) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id of its component), ``kept``.

    Documents link when the Jaccard similarity of their sets of ``shingle``-word shingles is at least ``percent``.
    A-Z are lowered; words are runs without blank, tab, newline and their like. Fewer words than ``shingle``: all of
    them are one shingle. Null, empty and blank texts have no shingles and link with nothing. A pair at the threshold
    shares a bucket with a probability of 1 - (1 - 0.8^4)^32, all but 5 in 10^8 of them; every link is confirmed on full
    sets. Very long texts are whole sets, one of them in a task's memory at a time where they are hashed. Rows that
    repeat an id count as one document and are ``kept`` alike (ids are keys, of any type that has an order). A row with
    a null id links with copies of its set alone. Other columns are ignored whatever their names. An empty table gives
    an empty table.

    Buckets, hubs and groups of copies may hold any share of the rows: what is known of one goes to its members by
    :func:`spread_join` or, where it is a whole set, by :func:`salted_join`.
    """
    sk = written(sketches(docs, id_col, text_col, shingle), "near-sketches")
    reps = written(sk.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "near-reps")

    # one row per set and band; buckets with one member are gone
    first = sk.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", "keys").dropDuplicates(["id"])
    keyed = first.select("id", "n", F.explode("keys").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "near-keys")
    total = shared.agg(F.sum("members")).first()[0] or 0
    bucketed = spread_join(keyed, shared, ["key"], "members", total, KEY_BYTES, broadcast_limit).filter("members is not null")
    bucketed = written(bucketed.select("key", "id", "n"), "near-members")
    wanted = written(bucketed.select("id", "n").distinct(), "near-wanted")
    sets = written(set_rows(docs, wanted, id_col, text_col, shingle, broadcast_limit).dropDuplicates(["id"]), "near-sets")
    shingles = wanted.agg(F.sum("n")).first()[0] or 0
    own = written(own_counts(sets, max(0, (shingles // SHARD).bit_length())), "near-own")
    members = bucketed.join(own, "id", "left").select("key", "id", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))
    # a link needs common / n >= percent on its own: intersection <= common, union >= n
    members = written(members.filter(F.col("common") * 100 >= F.col("n") * percent), "near-members")
    forget(shared, bucketed, wanted, own)

    def possible(n_a, c_a, n_b, c_b):
        """The intersection is at most either one's common shingles and at most either set."""
        most = F.least(n_a, n_b, c_a, c_b)
        return most * 100 >= (n_a + n_b - most) * percent

    hub = F.min(F.struct((-F.col("common") / F.col("n")).alias("rank"), "id", "n", "common")).alias("hub")
    hubs = written(members.groupBy("key").agg(hub, F.count(F.lit(1)).alias("members")).filter("members > 1"), "near-hubs")
    spokes = spread_join(members, hubs, ["key"], "members", total, 2 * KEY_BYTES, broadcast_limit).filter("hub is not null and id <> hub.id")
    spokes = spokes.filter(possible(F.col("n"), F.col("common"), F.col("hub.n"), F.col("hub.common")))
    links = verified(spokes.select(F.col("id").alias("a"), F.col("hub.id").alias("b")).distinct(), sets, percent)
    label = connected_components(links, "a", "b")

    # buckets that the hubs left in several parts
    placed = members.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members")).filter("low <> high")
    parts = written(parts.select("key", "members", F.lit(True).alias("apart")), "near-parts")
    apart = spread_join(placed, parts, ["key"], "members", total, KEY_BYTES, broadcast_limit).filter("apart")
    apart = written(apart.select("key", "id", "n", "component"), "near-apart")
    more = linked_in_blocks(apart, sets, percent)
    if not more.isEmpty():
        forget(label)
        label = connected_components(links.unionByName(more), "a", "b")
    forget(members, hubs, parts, apart, sets, links, more)

    of_rep = reps.join(label, reps.rep == label.node, "left").select("digest", "copies", F.coalesce("component", "rep").alias("component"))
    of_rep = written(of_rep, "near-of-rep")
    forget(reps, label)
    copies = of_rep.agg(F.sum("copies")).first()[0] or 0
    filled = spread_join(sk.filter("digest is not null").select("id", "n", "digest"), of_rep, ["digest"], "copies", copies, KEY_BYTES, broadcast_limit).select("id", "n", "component")
    out = filled.unionByName(sk.filter("digest is null").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns stay, whatever their names.
    Rows that share an id stay together."""
    stays = fresh("kept", docs.columns)
    kept = near_duplicates(docs, id_col, text_col, shingle, percent).filter("kept").select(F.col(id_col).alias(stays)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(stays)), "left_semi")
