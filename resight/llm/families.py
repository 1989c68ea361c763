"""Links inside families: groups of sets which some candidate step has thrown together.

A small family is compared pair by pair in one task. A large one is never: its sets are described by
their difference d(x) from the family's core, the tokens that are common in it. For any
core the symmetric difference of x and y is |d(x)| + |d(y)| - 2 |d(x) & d(y)|, so with the slack
s(x) = (den - num) |x| - (den + num) |d(x)| two sets reach similarity num / den exactly if
s(x) + s(y) + 2 (den + num) |d(x) & d(y)| >= 0. Pairs without a common token of d need s(x) + s(y) >= 0, and then
both reach the member with the greatest slack too: one star holds them all. Other pairs share a
token of d; they meet by the rarest tokens of d (a prefix as long as the least overlap that
could help allows). Only prefixes become rows: rarity is read from a table of bounded size. Tokens that many still share make families of their holders, which
get a core of their own; what is still frequent after ``LEVELS`` such rounds is met block by block. So near copies of one text cost a row for each token they differ in,
not one for each pair, and nothing is left out.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from resight.llm.graph import components
from resight.llm.words import U, chunks, freeing, mix, shingles, split
from resight.session import settle, settle_lookup

LEAF = 24
LEVELS = 5
#: Members of large families that one task describes.
MEMBERS = 512
#: The holders of a token meet directly if they are at most so many, or if so few of them are still to be joined.
HOLDERS = 256
FEW = 32
#: Tokens are counted in a table of up to 2 ** MOST_BITS buckets, which comes from the tasks in SLICES; a task counts BUFFER tokens at a time, and deals with TOKENS.
MOST_BITS = 22
SLICES = 16
BUFFER = 1 << 20
TOKENS = 1 << 18


def sets_of(batch, shingle: int, word):
    """For each row of a batch: its distinct shingle hashes, sorted."""
    for c in chunks(batch.column("text")):
        h, first = shingles(split(c, word), shingle)
        some = np.flatnonzero(np.diff(first))
        for a, b in zip(first[some], first[some + 1]):
            if b - a > 1:
                h[a:b].sort()
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[1:] != h[:-1]
        fresh[first[some]] = True
        at = np.concatenate([[0], np.cumsum(fresh)])[first]
        h = h[fresh]
        yield from (h[a:b] for a, b in zip(at[:-1], at[1:]))


def sums(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    return int(s.sum(dtype=U).astype(np.int64)), int(mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U).astype(np.int64))


def distinct_sets(rows: DataFrame) -> DataFrame:
    """(rep, s1, s2, n, first) of the distinct sets of rows (id, n, s1, s2), first being the smallest id that has it."""
    known = rows.where("n > 0 and id is not null")
    same = known.groupBy("s1", "s2", "n").agg(F.min("id").alias("first"))
    return settle(same.select(F.monotonically_increasing_id().alias("rep"), "s1", "s2", "n", "first"))


def repeats(rows: DataFrame) -> bool:
    """Whether an id has several rows with a set."""
    return rows.where("n > 0 and id is not null").groupBy("id").count().where("count > 1").limit(1).count() > 0


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    i = int((both[1:] == both[:-1]).sum())
    return den * i >= num * (len(a) + len(b) - i)


def small_links(members: DataFrame, split_sets, num: int, den: int) -> DataFrame:
    """Links (a, b) that join what is similar in rows (fam, rep, text) of families of at most ``LEAF`` members.

    ``split_sets`` turns a batch into its rows' sorted sets. Pairs that other links join already aren't compared.
    """

    def solve(rows):
        top = list(range(len(rows)))

        def find(i):
            while top[i] != i:
                i = top[i]
            return i

        for j in range(len(rows)):
            for i in range(j):
                x, y = find(i), find(j)
                if x != y and similar(rows[i][1], rows[j][1], num, den):
                    top[max(x, y)] = min(x, y)
                    yield rows[i][0], rows[j][0]

    def run(batches):
        fam, held = None, []
        for b in batches:
            out = []
            reps = b.column("rep").to_pylist()
            for f, rep, s in zip(b.column("fam").to_pylist(), reps, split_sets(b)):
                if f != fam:
                    out += solve(held)
                    fam, held = f, []
                held.append((rep, s))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
        out = list(solve(held))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return members.select("fam", "rep", "text").repartition("fam").sortWithinPartitions("fam", "rep").mapInArrow(run, "a long, b long")


def _later(held: list[tuple[int, np.ndarray]], num: int, den: int):
    """The reps of (rep, sorted set), in order, that are similar to an earlier one.

    More than ``LEAF`` meet by the tokens of their prefixes, the rarest of the family first.
    """
    if len(held) <= LEAF:
        yield from (rep for j, (rep, s) in enumerate(held) if any(similar(x, s, num, den) for _, x in held[:j]))
        return
    at = np.cumsum([0] + [len(s) for _, s in held])
    _, which, count = np.unique(np.concatenate([s for _, s in held]), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    ranks, once = rank[which], int((count == 1).sum())
    sets: list[np.ndarray] = []
    holders: dict[int, list[int]] = {}
    for (rep, _), a, b in zip(held, at[:-1], at[1:]):
        s, seen, late = np.sort(ranks[a:b]), set(), False
        prefix = s[: (b - a) - -(-num * (b - a) // den) + 1]
        for t in prefix[prefix >= once].tolist():
            mine = holders.setdefault(t, [])
            for k in mine:
                if not late and k not in seen:
                    seen.add(k)
                    late = similar(sets[k], s, num, den)
                if late:
                    break
            mine.append(len(sets))
        if late:
            yield rep
        sets.append(s)


def later_in_small(members: DataFrame, split_sets, num: int, den: int) -> DataFrame:
    """(rep) of what is similar to an earlier member, of rows (fam, rep, s1, id, line, text) of families that a task can hold.

    (id, line) is the order; a row whose set does not have the sum s1 is no member.
    """

    def run(batches):
        fam, last, held = None, None, []
        for b in batches:
            out = []
            for f, rep, s1, s in zip(b.column("fam").to_pylist(), b.column("rep").to_pylist(), b.column("s1").to_pylist(), split_sets(b)):
                if f != fam:
                    out += _later(held, num, den)
                    fam, last, held = f, None, []
                if rep != last and int(s.sum(dtype=U).astype(np.int64)) == s1:
                    last = rep
                    held.append((rep, s))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["rep"])
        yield pa.RecordBatch.from_arrays([pa.array(list(_later(held, num, den)), pa.int64())], ["rep"])

    cols = ("fam", "rep", "s1", "id", "line", "text")
    return members.select(*cols).repartition("fam").sortWithinPartitions("fam", "id", "line").mapInArrow(freeing(run), "rep long")


def _blocks(rows: DataFrame, sizes: DataFrame, columns) -> DataFrame:
    """Groups (by key) too large to meet at once, dealt into blocks which meet two by two."""
    of = rows.join(sizes.select("key", F.ceil(F.col("n") / FEW).cast("int").alias("blocks")), "key")
    of = of.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return of.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).select(*columns)


def _dealt(rows: DataFrame) -> DataFrame:
    """A written table of members, so many to a task whatever their families and number."""
    return rows.repartition(max(1, -(-rows.count() // MEMBERS)), "rep")


def _recentred(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (fam, rep, n, d, ...) with d taken against the family's core, and the slack s.

    The core are the tokens of d more than half as frequent as the most frequent one: the middle of the largest
    cluster. To members far from it the core is one more run of frequent tokens, which no prefix reaches. Where it would
    more than double what the family's members hold (a chain of texts has no middle, and tokens of two texts are
    frequent in it), the core are the tokens that more than half of the members have: those only shorten d. Frequencies are read
    from a count table of bounded size; any core is as right as another.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_counts(rows))
    rows = _dealt(rows)
    total = rows.groupBy("fam").agg(F.count("*").alias("m"), F.sum(F.size("d").cast("long")).alias("tokens"))
    seen = settle(rows.select("fam", "d").mapInArrow(freeing(_frequent(shared)), "fam long, token long, k long").distinct())
    most = seen.groupBy("fam").agg(F.max("k").alias("most")).join(total, "fam")
    core = seen.join(settle_lookup(most), "fam").where("2 * k > most")
    added = core.groupBy("fam").agg(F.sum(F.col("m") - 2 * F.col("k")).alias("added"))
    core = core.join(settle_lookup(added), "fam").where("added <= tokens or 2 * k > m").groupBy("fam").agg(F.collect_list("token").alias("core"))
    rows = rows.join(settle_lookup(core), "fam", "left").withColumn("core", F.coalesce("core", F.array().cast("array<bigint>")))
    rows = rows.withColumn("d", F.concat(F.array_except("d", "core"), F.array_except("core", "d"))).drop("core")
    return settle(rows.withColumn("s", (den - num) * F.col("n") - (den + num) * F.size("d")))


def _keys(batches):
    """Runs of rows with d, each with its tokens' keys (of family and token) and the number of them in each row."""
    for b in batches:
        at, lo = b.column("d").offsets.to_numpy().astype(np.int64), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + TOKENS, side="right")) - 1)
            run, n = b.slice(lo, hi - lo), np.diff(at[lo : hi + 1])
            token, fam = (np.asarray(x).astype(np.int64).view(U) for x in (run.column("d").flatten(), run.column("fam")))
            yield run, mix(token + np.repeat(mix(fam), n)), n
            lo = hi


def _bucket(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> U(64 - bits)).astype(np.int64)


def _counted(bits: int):
    """Rows with d -> (slice, block): how many tokens a task has in each bucket of a slice, packed."""

    def run(batches):
        def flush():
            v, c = np.unique(np.concatenate(held), return_counts=True)
            edge = np.searchsorted(v, np.arange(SLICES + 1) << (bits - 4))
            some = [k for k in range(SLICES) if edge[k] < edge[k + 1]]
            packed = [np.stack([v[edge[k] : edge[k + 1]] - (k << (bits - 4)), c[edge[k] : edge[k + 1]]]).astype(np.int32).tobytes() for k in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], ["slice", "block"])

        held: list[np.ndarray] = []
        for _, key, _ in _keys(batches):
            held.append(_bucket(key, bits))
            if sum(map(len, held)) > BUFFER:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return run


def _added(bits: int):
    def run(key, pdf):
        import pandas as pd

        total = np.zeros(1 << (bits - 4), np.int64)
        for x in pdf["block"]:
            v, c = np.frombuffer(x, np.int32).reshape(2, -1)
            total[v] += c
        return pd.DataFrame({"slice": [key[0]], "block": [total.astype(np.uint32).tobytes()]})

    return run


def _counts(rows: DataFrame) -> np.ndarray:
    """How many tokens of d, of all families, lie in each bucket of their keys; the table's size is bounded."""
    tokens = rows.agg(F.coalesce(F.sum(F.size("d").cast("long")), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(16, int(8 * tokens).bit_length()))
    got = rows.select("fam", "d").mapInArrow(freeing(_counted(bits)), "slice int, block binary").groupBy("slice").applyInPandas(_added(bits), "slice int, block binary").collect()
    out = np.zeros(1 << bits, np.uint32)
    for r in got:
        out[r["slice"] << (bits - 4) : (r["slice"] + 1) << (bits - 4)] = np.frombuffer(r["block"], np.uint32)
    return out


def _frequent(shared):
    """Rows with d -> (fam, token, k): a run's tokens more than half as frequent as its family's most frequent one, by their buckets."""

    def run(batches):
        table = shared.value
        bits = len(table).bit_length() - 1
        for b, key, n in _keys(batches):
            fams, fam = np.unique(np.repeat(np.asarray(b.column("fam")).astype(np.int64), n), return_inverse=True)
            k = table[_bucket(key, bits)].astype(np.int64)
            most = np.zeros(len(fams), np.int64)
            np.maximum.at(most, fam, k)
            some = np.flatnonzero((k > 1) & (2 * k > most[fam]))
            some = some[np.unique(key[some], return_index=True)[1]]
            token = np.asarray(b.column("d").flatten()).astype(np.int64)[some]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fams[fam[some]], token, k[some])], ["fam", "token", "k"])

    return run


def _prefixes(shared, columns):
    """Rows (columns, need, d) -> (columns, key, left): of the tokens in buckets that repeat the rarest ones, all but need - 1."""

    def run(batches):
        table = shared.value
        bits = len(table).bit_length() - 1
        for b, key, n in _keys(batches):
            row, count = np.repeat(np.arange(len(n)), n), table[_bucket(key, bits)]
            some = count > 1
            row, key, count = row[some], key[some], count[some]
            order = np.lexsort((key, count, row))
            row, key = row[order], key[order]
            of = np.bincount(row, minlength=len(n))
            left = of[row] - 1 - (np.arange(len(row)) - (np.cumsum(of) - of)[row])
            take = left + 2 > b.column("need").to_numpy()[row]
            at = pa.array(row[take])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in columns), pa.array(key[take].view(np.int64)), pa.array(left[take].astype(np.int32))], [*columns, "key", "left"])

    return run


def _shared_tokens(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Rows with the key of a token of d that another of the family may have too: the rarest ones, as many as a link could need.

    Rarity comes from a count table of bounded size (``_counts``), which only orders the tokens and leaves out some that no
    other member has: any one order serves. Tokens become rows only if they are in a prefix.
    """
    both = den + num
    most = F.floor(F.lit(den - num) * (F.col("n") + F.floor(F.col("n") * den / F.lit(num))) / F.lit(both))
    reach = (den - num) * F.floor(F.col("n") * den / F.lit(num)) - both * F.greatest(F.lit(0), F.size("d") - most)
    top = settle_lookup(rows.groupBy("fam").agg(F.max("s").alias("hs")))
    # the overlap of differences that the best partner within reach would leave to need
    need = F.greatest(F.lit(1).cast("long"), F.ceil(-(F.col("s") + F.least("hs", reach)) / F.lit(2 * both)))
    shared = rows.sparkSession.sparkContext.broadcast(_counts(rows))
    wanted = _dealt(rows).join(top, "fam").withColumn("need", need).drop("n", "hs")
    columns = [c for c in wanted.columns if c not in ("need", "d")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.select(*columns).schema)
    return settle(wanted.mapInArrow(freeing(_prefixes(shared, columns)), f"{kinds}, key long, left int"))


def _room(x: str, y: str, num: int, den: int):
    """Whether two sets that first meet at a token have tokens enough behind it, in the order of rarity."""
    col = lambda side, c: F.col(f"{side}.{c}")
    return col(x, "s") + col(y, "s") + 2 * (den + num) * (1 + F.least(col(x, "left"), col(y, "left"))) >= 0


def _overlapping(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (fam, a, b) those which are similar by what they differ in from their family's core."""
    side = lambda c: rows.select("fam", F.col("rep").alias(c), F.col("s").alias(f"s{c}"), F.col("d").alias(f"d{c}"))
    met = pairs.join(side("a"), ["fam", "a"]).join(side("b"), ["fam", "b"])
    return met.where(F.col("sa") + F.col("sb") + 2 * (den + num) * F.size(F.array_intersect("da", "db")) >= 0).select("a", "b").distinct()


def _split(each: DataFrame, sizes: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose holders meet directly, with ``ask`` for those who have to meet someone, and the tokens that get a family of their own).

    A member's leader is the most frequent of its frequent tokens. Two holders of a token with the same leader meet in the
    leader's family if not here, so a token whose holders follow, but for a few, one other leader needs these few to
    meet the others, and no family.
    """
    few = sizes.where(f"n <= {HOLDERS} or few <= {FEW}").select("key")
    hot = sizes.where(f"n > {HOLDERS} and few > {FEW}").select("key", "n")
    nobody = F.lit(None).cast("long")
    groups = each.join(few, "key").select(*each.columns, nobody.alias("leader"))
    rows = each.join(hot, "key")
    if level == LEVELS - 1:
        return groups.union(_blocks(rows, hot, each.columns).withColumn("leader", nobody)), hot.select("key").limit(0)
    leader = rows.groupBy("fam", "rep").agg(F.max_by("key", F.struct("n", "key")).alias("leader"))
    rows = settle(rows.drop("n").join(leader, ["fam", "rep"]).select(*each.columns, "leader"))
    follow = rows.groupBy("key", "leader").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "leader")).alias("top"))
    follow = settle(follow.select("key", F.col("top.leader").alias("top"), ((F.col("n") - F.col("top.c") <= FEW) & (F.col("top.leader") != F.col("key"))).alias("led")))
    led = rows.join(follow.where("led").select("key", "top"), "key").withColumn("ask", F.col("leader") != F.col("top")).drop("top")
    return groups.select(*led.columns).union(led), follow.where("not led").select("key")


def _met(groups: DataFrame, valid, num: int, den: int) -> DataFrame:
    """Pairs x, y of holders of a token, one of whom asks, that are valid and could be similar."""
    x, y = groups.where("ask").alias("x"), groups.alias("y")
    once = ~F.col("y.ask") | (F.col("x.rep") < F.col("y.rep"))
    elsewhere = F.coalesce((F.col("x.leader") == F.col("y.leader")) & (F.col("x.leader") != F.col("x.key")), F.lit(False))
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") != F.col("y.rep")) & once & ~elsewhere & valid & _room("x", "y", num, den))


def _inside(each: DataFrame, hot: DataFrame, rows: DataFrame, *keep: str) -> DataFrame:
    """The members of the families that frequent tokens make."""
    of = each.join(hot, "key").select("key", "fam", "rep")
    return of.join(rows.select("fam", "rep", "n", "d", *keep), ["fam", "rep"]).drop("fam").withColumnRenamed("key", "fam")


def large_links(members: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b), enough to connect what is similar, of rows (fam, rep, n, d): d the distinct tokens of a set of n."""
    links, rows = None, members
    for level in range(LEVELS):
        rows = _recentred(rows, num, den)
        hub = rows.groupBy("fam").agg(F.max(F.struct("s", (-F.col("rep")).alias("r"))).alias("h")).select("fam", F.col("h.s").alias("hub_s"), (-F.col("h.r")).alias("hub"))
        hub = settle_lookup(hub)
        starred = F.when((F.col("s") + F.col("hub_s") >= 0) | (F.col("rep") == F.col("hub")), F.col("hub")).otherwise(F.col("rep"))
        labelled = rows.join(hub, "fam").withColumn("label", starred)
        star = labelled.where("label = hub and rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
        each = _shared_tokens(labelled.drop("hub", "hub_s"), num, den).withColumn("ask", F.col("label") == F.col("rep"))
        # members of the star need no more links among themselves, so the others are who has to meet someone
        sizes = each.groupBy("key").agg(F.count("*").alias("n"), F.count_if("ask").alias("few"), F.min("label").alias("la"), F.max("label").alias("lb"))
        sizes = settle(sizes.where("n > 1 and la <> lb"))
        groups, hot = _split(each, sizes, level)
        pairs = _met(groups, F.col("x.label") != F.col("y.label"), num, den)
        pairs = pairs.select("x.fam", F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
        found = settle(star.union(_overlapping(pairs, rows, num, den)))
        links = found if links is None else links.union(found)
        if not hot.limit(1).count():
            break
        rows = settle(_inside(each, hot, rows))
    return links


def later_in_large(members: DataFrame, num: int, den: int) -> DataFrame:
    """(rep) of what is similar to an earlier member, of rows (fam, rep, n, d, place); ``place`` orders all sets and is unique.

    By slack alone x is similar to y if s(x) + s(y) >= 0, so for each slack the first place with that much is all that
    a family has to keep; who is left looks for earlier sets with a common token of d.
    """
    gone, rows = None, members.withColumn("late", F.lit(False))
    for level in range(LEVELS):
        rows = _recentred(rows, num, den)
        firsts = rows.groupBy("fam", "s").agg(F.min("place").alias("place")).groupBy("fam").agg(F.collect_list(F.struct("s", "place")).alias("firsts"))
        early = F.exists("firsts", lambda e: (e["s"] + F.col("s") >= 0) & (e["place"] < F.col("place")))
        rows = settle(rows.join(settle_lookup(firsts), "fam").withColumn("late", F.col("late") | early).drop("firsts"))
        got = rows.where("late").select("rep")
        asking = F.coalesce(F.max(F.when(~F.col("late"), F.col("place"))) > F.min("place"), F.lit(False))
        each = _shared_tokens(rows, num, den).withColumn("ask", ~F.col("late"))
        sizes = each.groupBy("key").agg(F.count("*").alias("n"), F.count_if("ask").alias("few"), asking.alias("asking"))
        sizes = settle(sizes.where("n > 1 and asking"))
        groups, hot = _split(each, sizes, level)
        behind = F.col("x.place") > F.col("y.place")
        pairs = _met(groups, ~F.when(behind, F.col("x.late")).otherwise(F.col("y.late")), num, den)
        later, earlier = (F.when(behind == first, F.col("x.rep")).otherwise(F.col("y.rep")) for first in (True, False))
        pairs = pairs.select("x.fam", later.alias("a"), earlier.alias("b")).distinct()
        got = settle(got.union(_overlapping(pairs, rows, num, den).select(F.col("a").alias("rep"))).distinct())
        gone = got if gone is None else gone.union(got)
        if not hot.limit(1).count():
            break
        inside = _inside(each, hot, rows, "place").join(got.withColumn("late", F.lit(True)), "rep", "left")
        rows = settle(inside.withColumn("late", F.coalesce("late", F.lit(False))))
    return gone.distinct()


def links_within(members: DataFrame, texts: DataFrame, split_sets, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect the similar sets of each family; rows (fam, rep), texts (rep, text), a row for each rep."""
    sizes = members.groupBy("fam").count()
    members = settle(members.join(sizes, "fam").where("count > 1"))
    small = members.where(f"count <= {LEAF}").select("fam", "rep")
    found = settle(small_links(texts.join(small, "rep"), split_sets, num, den))
    large = settle(members.where(f"count > {LEAF}").select("fam", "rep"))
    if large.limit(1).count():

        def run(batches):
            for b in batches:
                s = list(split_sets(b))
                at = np.concatenate([[0], np.cumsum([len(x) for x in s])]).astype(np.int32)
                flat = np.concatenate([*s, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("fam"), b.column("rep"), pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(at, pa.array(flat))], ["fam", "rep", "n", "d"])

        sets = texts.join(large, "rep").select("fam", "rep", "text").mapInArrow(run, "fam long, rep long, n long, d array<long>")
        found = found.union(large_links(settle(sets), num, den))
    return found


def _of_the_set(texts: DataFrame, shingle, word) -> DataFrame:
    """Of rows (rep, s1, s2, text) those whose text has the sums, one for each rep."""

    def run(batches):
        for b in batches:
            got = [sums(s) for s in sets_of(b, shingle, word)]
            ok = [x == y for x, y in zip(got, zip(b.column("s1").to_pylist(), b.column("s2").to_pylist()))]
            yield b.select(["rep", "text"]).filter(pa.array(ok, pa.bool_()))

    return texts.select("rep", "s1", "s2", "text").mapInArrow(run, "rep long, text string").groupBy("rep").agg(F.min("text").alias("text"))


def resolve(slim: DataFrame, rows: DataFrame, same: DataFrame, ties: DataFrame, shingle: int, num: int, den: int, word) -> DataFrame:
    """(id, n_shingles, component_id) of every row: what is similar among sets that the ties (a, b) hold together.

    ``slim`` has (id, text), ``rows`` (id, n, s1, s2) of each, ``same`` the distinct sets. Rows that repeat an id are one
    document, similar to what any of them is similar to. A row without a set is linked with nothing, a null id has a null component.
    """
    family = settle(components(ties).select(F.col("id").alias("rep"), F.col("component").alias("fam")))
    wanted = settle_lookup(same.join(family, "rep").select("rep", F.col("first").alias("id"), "s1", "s2"))
    texts = slim.join(wanted, "id")
    known = rows.where("n > 0 and id is not null")
    repeated = repeats(rows)
    if repeated:
        # an id with several rows: one with the set's own sums
        texts = _of_the_set(texts, shingle, word)
    links = links_within(family, texts.select("rep", "text"), partial(sets_of, shingle=shingle, word=word), num, den)
    if repeated:
        of = known.join(same, ["s1", "s2", "n"]).select("id", "rep")
        links = links.union(of.join(of.groupBy("id").agg(F.min("rep").alias("a")), "id").where("a <> rep").select("a", F.col("rep").alias("b")))
    label = components(links)
    classes = settle(same.join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    least = classes.groupBy("component").agg(F.min("first").alias("of_set"))
    out = rows.join(classes.join(least, "component").select("s1", "s2", "n", "of_set"), ["s1", "s2", "n"], "left")
    own = F.when(F.col("n") > 0, F.coalesce("of_set", "id")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"))
