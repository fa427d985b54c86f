"""Exact Jaccard self-join on word shingles with a token-group matrix.

1. Equal shingle sets fall into one class, known by the hash of the set.
2. Put all tokens in one order. Two sets that link share the first k of their common tokens
   among the first n - ceil(0.8 n) + k tokens of either, for any k; here k = 1 + n // 10. Only
   those tokens are shuffled, and classes with fewer than k tokens in common with classes of
   a fitting size are out. The order puts tokens of many documents last, so that what is
   shuffled seldom meets much.
3. Classes that share the smallest hash of some token permutation meet a leader, and are linked to
   it if their similarity reaches the threshold. Similar classes are then put into groups: those
   linked already, which need not meet again, and those left with the same leader.
4. The token-group matrix has a row for each token of a group part, with the range of sizes and the
   first place of the token in its members. A class looks up its tokens in it. Of two sets that
   link, neither has more tokens before the first common one than it may have outside the
   other, which their sizes bound: other meetings do not count. For each part that is hit, the
   overlap with the part's token union bounds the similarity to every member; only parts that
   reach the bound are opened, and their members are compared exactly.
5. Components of all links found give each document its class id.

No link is lost but those inside what is linked already, which do not change components.
Copies are never paired: they carry their class's hash. Parts hold about PART members, and a
part with many lookups is copied for each batch of them, so no task meets a whole large group.

Order statistics (which tokens are frequent) come from all documents, but only decide the
order, never the result. Shingles and sets are known by 64-bit hashes.

Defined cases: null text or one without words has an empty set and links with nothing (its
component is its own doc_id); fewer than five words form one shingle; a null doc_id never
names a component unless all its members are null; repeated rows are copies; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from xxhash import xxh3_64_intdigest

from twinsift.llm.frames import map_batches
from twinsift.session import materialise

WORDS = 5
NEEDED, OF = 80, 100          # a link: OF * overlap >= NEEDED * union
FREQUENT = 24                 # documents (copies in one task counted once) of a frequent token
FREQUENT_TABLE = 200_000      # at most so many frequent tokens are known to the tasks: 1.6 MB
ROUNDS = 3
FILTER_BITS = 16              # bits of the filter of wanted texts for each of them,
FILTER_LIMIT = 1 << 30        # and its most bits: 128 MB. Beyond it more sets are written in vain.
PART = 64
STEPS = 64
LOOKUPS = 512
BLOCK_TOKENS = 2_000_000

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                     0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        out += h[j:j + n] * _FACTORS[j]
    return np.unique(mixed(out))


def least_shared(n: int) -> int:
    """So many of the tokens that are looked up must be shared, by either set's size."""
    return 1 + n // 10


def prefix_length(n: int) -> int:
    return n - -(-NEEDED * n // OF) + least_shared(n)


def linked(overlap: int, n: int, m: int) -> bool:
    return OF * overlap >= NEEDED * (n + m - overlap)


def set_hash(tokens: np.ndarray) -> int:
    return int(np.uint64(xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def ordered(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Tokens, as numbers, in the common order: by hash, frequent ones last."""
    keys = tokens >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = frequent[at] == tokens
        keys = np.sort(np.where(often, keys | np.uint64(1 << 63), keys))
    return keys


def frequent_tokens(docs: DataFrame) -> np.ndarray:
    """Hashes of the most frequent tokens, at most FREQUENT_TABLE, counted over all documents."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held, size, seen = [], 0, set()

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1      # a token met once in a block adds nothing worth moving
            return {"token": tokens[often].view(np.int64), "n": counts[often]}

        for batch in batches:
            for text in batch["text"]:
                tokens = shingles(text)
                if len(tokens) and (key := set_hash(tokens)) not in seen:
                    seen.add(key)
                    held.append(tokens)
                    size += len(tokens)
                    if size > BLOCK_TOKENS:
                        yield flush()
                        held, size, seen = [], 0, set()
        if held:
            yield flush()

    counted = map_batches(docs.select("text"), run, "token long, n long")
    rows = (counted.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
            .orderBy(F.desc("n"), "token").limit(FREQUENT_TABLE).select("token").collect())
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))


def profiles(docs: DataFrame) -> DataFrame:
    """Per row doc_id, n, sid (hash of its set), th (hash of its text) and group keys.

    Only the first row of a set in a task has group keys.
    """
    schema = StructType([
        StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n", LongType()),
        StructField("sid", LongType()), StructField("th", LongType()),
        StructField("keys", ArrayType(LongType()))])
    salts = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * _FACTORS[0])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        seen: set[int] = set()
        for batch in batches:
            sizes, sids, keys = [], [], []
            for text in batch["text"]:
                tokens = shingles(text)
                sizes.append(len(tokens))
                sids.append(set_hash(tokens) if len(tokens) else None)
                if not len(tokens) or sids[-1] in seen:
                    keys.append([])
                    continue
                seen.add(sids[-1])
                keys.append([int(mixed(tokens ^ s).min().astype(np.int64)) for s in salts])
            yield {"doc_id": batch["doc_id"], "n": sizes, "sid": sids, "th": batch["th"],
                   "keys": keys}

    return map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), run, schema)


def postings(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(token, sid, place) for the first tokens of every set.

    `place` packs the set's size and how far up the order the token stands, in 64ths of the size.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        seen: set[int] = set()
        for batch in batches:
            tokens_out, sids_out, places_out = [], [], []
            for text in batch["text"]:
                tokens = shingles(text)
                if not len(tokens) or (sid := set_hash(tokens)) in seen:
                    continue
                seen.add(sid)
                order = ordered(tokens, frequent)
                first = order[:prefix_length(len(order))]
                tokens_out.append(first)
                sids_out.append(np.full(len(first), sid, dtype=np.int64))
                n = len(order)
                places_out.append(n * STEPS + np.arange(len(first)) * STEPS // n)
            if tokens_out:
                yield {"token": np.concatenate(tokens_out).view(np.int64),
                       "sid": np.concatenate(sids_out), "place": np.concatenate(places_out)}

    return map_batches(docs.select("text"), run, "token long, sid long, place long")


def wanted_filter(wanted: DataFrame) -> np.ndarray:
    """Bits set at the text hashes (th) of the wanted rows: one-sided, of bounded size."""
    bits = 1 << 16
    count = wanted.count()
    while bits < min(FILTER_BITS * count, FILTER_LIMIT):
        bits *= 2
    at = F.pmod(F.col("th"), F.lit(bits))
    words = (wanted.select(F.shiftright(at, 6).alias("word"),
                           F.expr(f"shiftleft(1L, cast(pmod(th, {bits}) % 64 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bit")).collect())
    out = np.zeros(bits // 64, dtype=np.int64)
    out[[w["word"] for w in words]] = [w["bit"] for w in words]
    return out.view(np.uint64)


def token_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid and tokens (sorted 64-bit numbers) of the wanted texts (th), and of a few more.

    May repeat a sid.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted_filter(wanted))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        words, seen = shared.value, set()
        bits = len(words) * 64
        for batch in batches:
            out = {"sid": [], "tokens": []}
            for th, text in zip(batch["th"], batch["text"]):
                at = th % bits
                if int(words[at >> 6]) >> (at & 63) & 1 and th not in seen:
                    seen.add(th)
                    tokens = shingles(text)
                    if len(tokens):
                        out["sid"].append(set_hash(tokens))
                        out["tokens"].append(tokens.tobytes())
                if len(out["sid"]) >= 1000:
                    yield out
                    out = {"sid": [], "tokens": []}
            yield out

    texts = docs.select(F.xxhash64("text").alias("th"), "text")
    return map_batches(texts, run, "sid long, tokens binary")


def by_group(rows: DataFrame, keys: list[str], order: list[str], fn, schema: str) -> DataFrame:
    """Stream the rows of each key, in order, through `fn(rows) -> rows` (tuples)."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    columns, names = dealt.columns, StructType.fromDDL(schema).names
    at = [columns.index(k) for k in keys]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        tuples = itertools.chain.from_iterable(
            zip(*[b[c] for c in columns]) for b in batches)
        out: list[tuple] = []
        for _, group in itertools.groupby(tuples, key=lambda r: [r[i] for i in at]):
            out += fn(group)
            if len(out) > 10_000:
                yield dict(zip(names, zip(*out)))
                out = []
        if out:
            yield dict(zip(names, zip(*out)))

    return map_batches(dealt, run, schema)


def _as_set(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _meet_leader(rows: Iterator[tuple]) -> list[tuple]:
    """Rows (leader, salt, kind, sid, tokens): the leader (kind 0), then members (kind 1).

    A member joins the first leader that it links with, else it leads those that come after it.
    """
    out, leaders, last = [], [], None
    for _, _, kind, sid, blob in rows:
        if (kind, sid) == last:
            continue
        last, mine = (kind, sid), _as_set(blob)
        for other, tokens in leaders:
            if (OF * min(len(tokens), len(mine)) >= NEEDED * max(len(tokens), len(mine))
                    and linked(overlap(tokens, mine), len(tokens), len(mine))):
                out.append((sid, other))
                break
        else:
            leaders.append((sid, mine))
    return out


def leader_links(keyed: DataFrame, sized: DataFrame,
                 sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (sid, leader) between classes that share a key, and the pairs that met.

    The leader of a key is the class with the largest share of tokens met elsewhere: of
    near copies, that is the text they stem from or the one least changed. What it does not
    reach is grouped among itself, in batches of bounded size.
    """
    share = F.struct(F.col("met") / F.col("n"), "sid")
    first = (keyed.join(sized, "sid").groupBy("round", "key")
             .agg(F.max_by("sid", share).alias("leader")))
    pairs = (keyed.join(first, ["round", "key"]).filter("sid != leader")
             .select("sid", "leader").distinct().join(sized.select("sid", "n"), "sid")
             .join(sized.select(F.col("sid").alias("leader"), F.col("n").alias("m")), "leader")
             .filter(OF * F.least("n", "m") >= NEEDED * F.greatest("n", "m"))
             .select("sid", "leader"))
    pairs = materialise(pairs, "pairs")
    salts = materialise(pairs.groupBy("leader").agg(
        F.ceil(F.count("*") / F.lit(2 * LOOKUPS)).cast("int").alias("salts")), "leaders")
    members = pairs.join(salts, "leader").select(
        "leader", F.pmod(F.hash("sid"), F.col("salts")).alias("salt"), F.lit(1).alias("kind"), "sid")
    heads = salts.select(
        "leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(0).alias("kind"), F.col("leader").alias("sid"))
    rows = members.unionByName(heads).join(sets, "sid").select(
        "leader", "salt", "kind", "sid", "tokens")
    return by_group(rows, ["leader", "salt"], ["kind", "sid"], _meet_leader,
                    "sid long, leader long"), pairs


def _open_part(rows: Iterator[tuple]) -> list[tuple]:
    """Rows (part, salt, kind, sid, tokens): lookups (kind 1) against the members (kind 0)."""
    out, members, union, last = [], [], None, None
    for _, _, kind, sid, blob in rows:
        tokens = _as_set(blob)
        if kind == 0:
            if sid != last:
                members.append((sid, tokens))
        elif (kind, sid) != last:
            if union is None:
                union = members[0][1] if len(members) == 1 else np.unique(
                    np.concatenate([m[1] for m in members]))
            if OF * overlap(tokens, union) >= NEEDED * len(tokens):
                out += [(sid, other) for other, theirs in members if other != sid
                        and OF * min(len(tokens), len(theirs)) >= NEEDED * max(len(tokens), len(theirs))
                        and linked(overlap(tokens, theirs), len(tokens), len(theirs))]
        last = (kind, sid) if kind else sid
    return out


def matrix_links(shared: DataFrame, sized: DataFrame, sets: DataFrame, groups: DataFrame,
                 pairs: DataFrame) -> DataFrame:
    """Links (sid, leader) between classes that are not linked yet.

    `shared` has token, sid and pos, `sized` sid and n, `groups` sid and grp of what is linked,
    `pairs` sid and leader of what has met.
    """
    families = pairs.groupBy("sid").agg(F.min("leader").alias("family"))
    grouped = (sized.select("sid", "n").join(groups, "sid", "left").join(families, "sid", "left")
               .select("sid", "n", F.coalesce("grp", "sid").alias("own"),
                       F.coalesce("grp", "family", "sid").alias("pack")))
    counts = grouped.groupBy("pack").agg(F.ceil(F.count("*") / F.lit(PART)).alias("parts"))
    placed = materialise(grouped.join(counts, "pack").select(
        "sid", "n", "own", F.when(F.col("parts") == 1, F.col("pack")).otherwise(F.xxhash64(
            "pack", F.pmod(F.hash("sid"), F.col("parts")))).alias("part")), "parts")
    rows = (shared.filter(OF * (F.col("n") - F.col("pos")) >= NEEDED * F.col("n"))
            .select("token", "sid", "pos").join(placed, "sid"))
    matrix = rows.groupBy("token", F.col("part").alias("other")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("pos").alias("place"),
        F.min("own").alias("lo"), F.max("own").alias("hi"))
    # 180 overlap >= 80 (n + m): what either set can have outside the other.
    n, least, most, one = F.col("n"), F.col("least"), F.col("most"), OF + NEEDED
    linked_already = (F.col("lo") == F.col("own")) & (F.col("hi") == F.col("own"))
    hits = materialise(
        rows.join(matrix, "token")
        .filter((F.col("part") <= F.col("other")) & ~linked_already
                & (one * (n - F.col("pos")) >= NEEDED * (n + least))
                & (one * (most - F.col("place")) >= NEEDED * (n + most)))
        .select("sid", F.col("other").alias("part")).distinct(), "hits")
    copies = hits.groupBy("part").agg(
        F.ceil(F.count("*") / F.lit(LOOKUPS)).cast("int").alias("salts"))
    lookups = hits.join(copies, "part").select(
        "part", F.pmod(F.hash("sid"), F.col("salts")).alias("salt"), F.lit(1).alias("kind"), "sid")
    held = placed.select("sid", "part").join(copies, "part").select(
        "part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(0).alias("kind"), "sid")
    both = lookups.unionByName(held).join(sets, "sid").select(
        "part", "salt", "kind", "sid", "tokens")
    return by_group(both, ["part", "salt"], ["kind", "sid"], _open_part,
                    "sid long, leader long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest node) of every connected component, by alternating stars.

    Each round turns neighbourhoods into stars around their smallest node; rounds grow with the
    logarithm of the component size. Every round is written, so lineage stays short.
    """
    stars = materialise(edges.filter("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        stars = materialise(
            small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
        if now == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def repeated_tokens(rows: DataFrame) -> DataFrame:
    """The rows (token, sid, n, pos) whose token also stands in a set of a fitting size."""
    w = W.Window.partitionBy("token").orderBy("n", "sid")
    return (rows.withColumns({"before": F.lag("n").over(w), "after": F.lead("n").over(w)})
            .filter((OF * F.col("before") >= NEEDED * F.col("n"))
                    | (NEEDED * F.col("after") <= OF * F.col("n")))
            .select("token", "sid", "n", "pos"))


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles of all rows, and links (a, b) between classes: enough for all components."""
    frequent = frequent_tokens(docs)
    profile = materialise(profiles(docs), "profiles")
    # A token stands at least at `pos`: its place is known to a 64th of the size.
    size, step = F.floor(F.col("place") / STEPS), F.col("place") % STEPS
    rows = (postings(docs, frequent).repartition("token").dropDuplicates(["token", "sid"])
            .select("token", "sid", size.alias("n"), F.ceil(step * size / STEPS).alias("pos")))
    shared = materialise(repeated_tokens(rows), "postings")
    # A set that links shares at least so many tokens, even with the smallest set it can link to.
    least = 1 + F.floor(F.col("n") * NEEDED / (OF * 10))
    for _ in range(2):
        enough = (shared.groupBy("sid").agg(F.count("*").alias("met"), F.first("n").alias("n"))
                  .filter(F.col("met") >= least).select("sid"))
        shared = materialise(repeated_tokens(shared.join(enough, "sid", "left_semi")), "postings")
    sized = (shared.groupBy("sid").agg(F.count("*").alias("met"), F.first("n").alias("n"))
             .filter(F.col("met") >= least))
    sized = materialise(sized, "sized")
    keyed = materialise(profile.filter(F.size("keys") > 0).join(sized, "sid", "left_semi")
                        .select("sid", F.posexplode("keys").alias("round", "key")).distinct(), "keys")
    wanted = profile.filter("n > 0").groupBy("sid").agg(F.min("th").alias("th")).join(
        sized, "sid", "left_semi")
    sets = materialise(token_sets(docs, wanted), "sets")
    met, pairs = leader_links(keyed, sized, sets)
    met = materialise(met, "met")
    groups = components(met.select(F.col("sid").alias("a"), F.col("leader").alias("b"))).select(
        F.col("node").alias("sid"), F.col("root").alias("grp"))
    links = met.unionByName(matrix_links(shared, sized, sets, groups, pairs))
    return profile, links.select(F.col("sid").alias("a"), F.col("leader").alias("b"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (its smallest doc_id) of every row."""
    profile, links = jaccard_links(docs)
    roots = materialise(components(links), "roots")
    rows = profile.select("doc_id", "n", "sid").join(
        roots, F.col("sid") == F.col("node"), "left").select(
        "doc_id", "n", F.coalesce("root", "sid").alias("root"))
    smallest = rows.filter(F.col("root").isNotNull()).groupBy(F.col("root").alias("__root")).agg(
        F.min("doc_id").alias("smallest"))
    return rows.join(smallest, F.col("root") == F.col("__root"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("smallest", "doc_id").alias("component_id"))


def keep_one_row(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns: null and repeated doc_ids are told apart too.

    The row of the smallest doc_id stays (nulls last), then of the smallest text hash; of rows
    alike in both, one. Rows without words are not like any other, and all stay.
    """
    profile, links = jaccard_links(docs)
    roots = materialise(components(links), "roots")
    rows = (profile.filter(F.col("sid").isNotNull()).select("doc_id", "th", "sid")
            .join(roots, F.col("sid") == F.col("node"), "left")
            .select("doc_id", "th", F.coalesce("root", "sid").alias("root"))
            # Repeated rows are one row with a count from here on, so a hot one is no hot key.
            .groupBy("root", "doc_id", "th").agg(F.count("*").alias("n")))
    rows = materialise(rows, "members")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    best = rows.groupBy(F.col("root").alias("__root")).agg(F.min(order).alias("best"))
    ranked = rows.join(best, F.col("root") == F.col("__root")).withColumn(
        "first", order.eqNullSafe(F.col("best")))
    # Rows to leave out; of the first ones that are repeated, one comes back.
    out = materialise(ranked.filter(~F.col("first") | (F.col("n") > 1)).select(
        F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "first"), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th"))
    kept = docs.join(out, same, "left_anti")
    repeated = out.filter("first")
    if repeated.isEmpty():
        return kept
    one = (docs.join(repeated, same, "left_semi").groupBy("doc_id", F.xxhash64("text").alias("__th"))
           .agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row")))
    return kept.unionByName(one.select("__row.*"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` but those whose component has a smaller doc_id, with all columns.

    Rows that repeat a doc_id are one document and stay or go together; null doc_ids stay.
    """
    members = jaccard_components(docs)
    gone = materialise(members.filter(F.col("doc_id") != F.col("component_id"))
                       .select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
