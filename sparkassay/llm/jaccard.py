"""N-gram Jaccard join by size: small sets enumerate subsets, large sets share inverted lists.

Two sets that link differ in few members, and the bound follows from their sizes. Light sets (up to a boundary
chosen by cost) list, for every pair of sizes that can link, all subsets of the fixed size that a link must
have in common: equal subsets are links. Heavy sets deal their members to hash blocks, more blocks than they
may differ in, and enter an inverted list for each of their first blocks, keyed by the members
there: with d differences, one of the first d + 1 blocks of either set is equal in both. Keys of
single members would be simpler, but a passage that thousands of texts share would put all of these into
one list.

Equal sets are one set from the start, named by a hash of its members, so a group of copies costs one row a task and
key. Lists are scanned from a pivot, the least set: members are verified against it, exactly. Lists that then
still hold several components are scanned from their centre, and what strays from the centre's component is
compared with its family. A large family first loses the sets that have too many members to themselves to link with
another; what is then still too large for one task is compared in blocks. A block hands on a star for each component
it sees, not its pairs.

That settles the components, and every link lies inside one. Links are then counted, not listed: a set is stored as
its differences from its component's centre. Two sets whose differences are few enough together link whatever they are, so
a running sum over the component counts these pairs; only the others are compared, in blocks, and a
block hands on one count a set.

Hashes have 64 bits; equal hashes count as equal words, shingles and sets.

Defined results: NULL and texts without words have no shingles and link with nothing; rows that
share an id are one node; rows that share id and set are one document; a row without id has component NULL and
no links; an empty table gives no rows; whole texts are shingled; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations as subsets
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.llm.common import few, release, settled

from sparkassay.llm.components import components

WORDS, SIMILARITY = 5, (80, 100)
#: Largest set that may be enumerated, whatever the cost says.
MOST_LIGHT = 24
#: What a row of an inverted list costs, with its later verification, in enumerated subsets.
LIST_COST = 4
#: Keys that a task gathers before it hands them on.
TOGETHER = 500_000
#: Bytes of texts that a task's Python side takes at once. Sets and keys of a batch come to a few times that.
TEXT_BYTES = 1 << 20
#: Bytes of texts that are hashed by one set of calls; a longer text by itself.
AT_ONCE = 1 << 15
#: Members of sets that are dealt to hash blocks at once; a larger set by itself.
MEMBERS = 1 << 17
#: Pairs are sifted by every PART-th hash of their sets before whole sets are compared.
PART = 4
#: Sets that a task compares with each other at once, on each side.
BLOCK = 1024
#: Members that all sets of one side of a block have together, about.
ROOM = 1 << 20
#: Hashes that are counted by one product of tables, and pairs of sets that are counted at once.
COLUMNS, PAIRS = 1024, 1 << 19
#: A hash goes to such a product if at least this share of the pairs of sets have it; else its pairs are listed.
COMMON = 1 / 256
#: Sets, about, that say what the middle of a component holds.
MIDDLE = 15
#: At least so many more blocks than differences are expected to be filled.
SPARE = 1.35
#: Sets are copied to their families and blocks in rounds, each of at most so many times the members that are copied from.
COPIES = 4

ROW = "kind byte, doc_id long, sid long, n int, key long, side byte, pivot long, pivot_n int"
DOCUMENT, FIRST, NEXT = range(3)

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted values, each once. Sorting whole numbers is several times as fast as the hash table of np.unique."""
    h = np.sort(h)
    new = h[1:] != h[:-1]
    return h if new.all() else h[np.concatenate([[True], new])]


class Shingler:
    """Sets of 64-bit hashes of word shingles. A word's hash is a difference of running polynomial sums."""

    def __init__(self, words: int):
        rng = np.random.default_rng(20)
        self.words = words
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.byte[65:91] = self.byte[97:123]  # A-Z count as a-z
        self.base = 0x9E3779B97F4A7C15
        self.inverse = pow(self.base, -1, 1 << 64)
        self.factors = rng.integers(1, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = self.backs = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers), 1 << 14)
            steps = np.full((2, size), [[self.base], [self.inverse]], np.uint64)
            steps[:, 0] = 1
            self.powers, self.backs = np.cumprod(steps, axis=1)

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The set of every text. Texts are hashed many at once, for most are too short to be worth the calls."""
        texts = [(t or "").encode() for t in texts]
        first = held = 0
        for i, text in enumerate(texts):
            held += len(text) + 1
            if held >= AT_ONCE or i + 1 == len(texts):
                yield from self._sets(texts[first : i + 1])
                first, held = i + 1, 0

    def _sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        raw = np.frombuffer(b" ".join(texts), np.uint8)
        # spaces are 0x20 and 0x09 to 0x0D; words fill the gaps between them
        between = np.flatnonzero((raw == 0x20) | (raw - np.uint8(0x09) < 5))
        starts, ends = np.append(0, between + 1), np.append(between, len(raw))
        filled = starts < ends
        if not filled.all():
            starts, ends = starts[filled], ends[filled]
        self._grow(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.byte.take(raw, mode="clip") * self.powers[: len(raw)], out=sums[1:])
        word = mix((sums[ends] - sums[starts]) * self.backs[starts] + (ends - starts).astype(np.uint64))
        k = self.words
        total = np.zeros(max(0, len(word) - k + 1), np.uint64)
        for i in range(k):
            total += word[i : i + len(total)] * self.factors[i]
        total = mix(total)
        lengths = np.array([len(t) + 1 for t in texts])
        upto = np.searchsorted(starts, np.cumsum(lengths)).tolist()
        for begin, end in zip([0, *upto], upto):
            n = end - begin
            if n >= k:
                yield distinct(total[begin : end - k + 1])
            elif n:
                yield mix((word[begin:end] * self.factors[:n]).sum(keepdims=True) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)


class Sizes:
    """Arithmetic of one similarity p / q."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        self.known: dict[tuple[int, int], list] = {}

    def common(self, a: int, b: int) -> int:
        """Members that linked sets of these sizes share at least."""
        return -(-self.p * (a + b) // (self.p + self.q))

    def most(self, a: int) -> int:
        return a * self.q // self.p

    def least(self, a: int) -> int:
        return -(-a * self.p // self.q)

    def differences(self, a: int) -> int:
        """Members in which a set of size a can differ from a set it links with, at most."""
        return (a + self.most(a)) * (self.q - self.p) // (self.q + self.p)

    def partners(self, a: int, limit: int) -> list[tuple[int, int]]:
        """(size, common members) of sets up to `limit` that can link with a set of size a."""
        sizes = range(self.least(a), min(self.most(a), limit) + 1)
        return [(b, c) for b in sizes if (c := self.common(a, b)) <= min(a, b)]

    def light_cost(self, a: int, limit: int) -> int:
        return sum(comb(a, c) for _, c in self.partners(a, limit))

    def heavy_cost(self, a: int, floor: int) -> int:
        return (self.differences(a) + 1) * len(self.classes(a, floor)) * LIST_COST

    def classes(self, a: int, floor: int) -> list[tuple[int, int, int]]:
        """(class, blocks, side) of a heavy set: sizes double from class to class. A set is in its own, and
        in the class between two neighbours where it can link across."""
        if (a, floor) in self.known:
            return self.known[a, floor]
        k = (a // floor).bit_length() - 1
        low = floor << k
        out = [(2 * k, self.blocks(2 * low - 1), 2)]
        if k and a <= self.most(low):
            out.append((2 * k - 1, self.blocks(self.most(low)), 1))
        if self.most(a) >= 2 * low:
            out.append((2 * k + 1, self.blocks(self.most(2 * low)), 0))
        self.known[a, floor] = out
        return out

    def blocks(self, largest: int) -> int:
        """Blocks that leave enough of them filled for the largest set of a class."""
        need = SPARE * (self.differences(largest) + 1)
        m = need
        while m * (1 - np.exp(-largest / m)) < need and m < 8 * need:
            m *= 1.05
        return int(np.ceil(m))


def boundary(sizes: Sizes, counts: dict[int, int]) -> int:
    """Largest light size: the one with the least total cost for these counts of set sizes."""

    def cost(limit: int) -> int:
        floor = sizes.least(limit + 1)
        light = sum(n * sizes.light_cost(a, limit) for a, n in counts.items() if a <= limit)
        return light + sum(n * sizes.heavy_cost(a, floor) for a, n in counts.items() if a >= floor)

    return min(range(6, MOST_LIGHT + 1), key=cost)


def _hash(*parts: int) -> np.uint64:
    h = 0
    for p in parts:
        h = (h * 0x9E3779B97F4A7C15 + p + 1) % (1 << 64)
        h = (h ^ (h >> 30)) * int(_M1) % (1 << 64)
        h ^= h >> 27
    return np.uint64(h)


def light_keys(members: np.ndarray, sizes: Sizes, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sides) of every subset that a link with another light set can have in common. A subset's
    hash is the sum of its members' hashes, so dropping members subtracts them."""
    a, keys, sides = len(members), [], []
    mixed = mix(members)
    for b, c in sizes.partners(a, limit):
        dropped = np.array(list(subsets(range(a), a - c)), np.int64).reshape(comb(a, c), a - c)
        rest = mixed.sum(keepdims=True) - mixed[dropped].sum(axis=1, dtype=np.uint64)
        keys.append(mix(rest + _hash(1, min(a, b), max(a, b))))
        sides.append(np.full(len(rest), 2 if a == b else int(a > b), np.int8))
    return np.concatenate(keys), np.concatenate(sides)


def heavy_keys(sets: list[np.ndarray], sizes: Sizes, floor: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, sides, numbers of their sets) of the first filled blocks of every class of these sets."""
    lengths = [len(s) for s in sets]
    need = np.array([sizes.differences(a) + 1 for a in lengths])
    classes: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, a in enumerate(lengths):
        for kind, blocks, side in sizes.classes(a, floor):
            classes.setdefault((kind, blocks), []).append((i, side))
    for (kind, blocks), held in classes.items():
        own, side = np.array([i for i, _ in held]), np.array([x for _, x in held], np.int8)
        members = np.concatenate([sets[i] for i, _ in held])
        row = np.repeat(np.arange(len(own)), [lengths[i] for i, _ in held])
        slot = row * blocks + (members % np.uint64(blocks)).astype(np.int64)
        # numbers of two bytes are ordered by counting
        slot = slot.astype(np.uint16 if len(own) * blocks <= 1 << 16 else np.int64)
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        at = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        sums = np.add.reduceat(mix(members + np.uint64(1))[order], at)
        row, block = np.divmod(slot[at].astype(np.int64), blocks)
        filled = np.bincount(row, minlength=len(own))
        early = np.arange(len(at)) - (np.cumsum(filled) - filled)[row] < need[own][row]
        row = row[early]
        key = mix(sums[early] + _hash(2, kind) + block[early].astype(np.uint64) * _M1)
        # where every filled block is listed, only two such sets could still miss each other
        all_listed = np.flatnonzero(filled < need[own])
        row = np.append(row, all_listed)
        yield np.append(key, np.full(len(all_listed), _hash(3, kind))), side[row], own[row]


def named(members: np.ndarray) -> int:
    """The 64-bit name of a set."""
    import xxhash

    name = xxhash.xxh3_64_intdigest(members.tobytes())
    return name - (1 << 64) if name >> 63 else name


def listing(words: int, sizes: Sizes, limit: int):
    """Function of one task: its rows of kind DOCUMENT, FIRST and NEXT."""
    floor = sizes.least(limit + 1)
    types = [pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int8(), pa.int64(), pa.int32()]
    names = ["kind", "doc_id", "sid", "n", "key", "side", "pivot", "pivot_n"]

    def emit(kind: int, rows: int, **given) -> pa.RecordBatch:
        given["kind"] = np.full(rows, kind, np.int8)
        columns = [given.get(name, None) for name in names]
        made = [pa.nulls(rows, t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(made, names)

    def gathered(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, side, sid, n = (np.concatenate(column) for column in zip(*parts, strict=True))
        key = key.view(np.int64)
        order = np.lexsort((sid, side, key))
        key, side, sid, n = key[order], side[order], sid[order], n[order]
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (side[1:] != side[:-1])])
        at = np.flatnonzero(first)
        head = np.repeat(at, np.diff(np.append(at, len(key))))
        for a in range(0, len(at), 50_000):
            i = at[a : a + 50_000]
            yield emit(FIRST, len(i), sid=sid[i], n=n[i], key=key[i], side=side[i])
        rest = np.flatnonzero(~first & (sid != sid[head]))
        for a in range(0, len(rest), 50_000):
            i = rest[a : a + 50_000]
            yield emit(NEXT, len(i), sid=sid[i], n=n[i], key=key[i], side=side[i], pivot=sid[head[i]], pivot_n=n[head[i]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, known = Shingler(words), set()
        parts: list = []
        waiting = done = 0

        def taken(heavy: list[tuple[int, np.ndarray]]) -> int:
            names = np.array([sid for sid, _ in heavy], np.int64)
            lengths = np.array([len(members) for _, members in heavy], np.int32)
            before = len(parts)
            for key, side, own in heavy_keys([members for _, members in heavy], sizes, floor):
                parts.append((key, side, names[own], lengths[own]))
            return sum(len(p[0]) for p in parts[before:])

        for rows in batches:
            sizes_here, sids = [], []
            heavy, held = [], 0
            for doc_id, members in zip(rows["doc_id"].to_pylist(), shingle(rows["text"].to_pylist()), strict=True):
                a = len(members)
                sizes_here.append(a)
                sids.append(named(members) if a else None)
                if not a or doc_id is None or sids[-1] in known:
                    continue
                known.add(sids[-1])
                if a <= limit:
                    key, side = light_keys(members, sizes, limit)
                    parts.append((key, side, np.full(len(key), sids[-1], np.int64), np.full(len(key), a, np.int32)))
                    waiting += len(key)
                if a >= floor:
                    heavy.append((sids[-1], members))
                    held += a
                    if held > MEMBERS:
                        waiting += taken(heavy)
                        heavy, held = [], 0
                # short texts have thousands of keys each, so a batch is no bound
                if waiting > TOGETHER:
                    yield from gathered(parts)
                    parts.clear()
                    waiting = 0
            if heavy:
                waiting += taken(heavy)
            yield emit(DOCUMENT, len(sids), doc_id=rows["doc_id"], sid=sids, n=sizes_here, key=np.arange(done, done + len(sids)))
            done += len(sids)
        if parts:
            yield from gathered(parts)

    return work


def listed(docs: DataFrame, words: int, sizes: Sizes, limit: int) -> DataFrame:
    """Rows of kind DOCUMENT (one a row, with its set; its key is a running number), FIRST and NEXT (a key's first and further
    sets of a task's gathering, the latter with the first as pivot)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(listing(words, sizes, limit), ROW)


def sets_of(docs: DataFrame, firsts: DataFrame, sids: DataFrame, words: int, part: int = 1) -> DataFrame:
    """(sid, n, _set) of these sets: the size of a set and its sorted hashes, or of these only the multiples of
    `part`. `firsts` has a document (sid, doc_id) of every set; rows that repeat it repeat the set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for rows in batches:
            sets = list(shingle(rows["text"].to_pylist()))
            # a row of the same id may hold another text
            asked = [i for i, (s, sid) in enumerate(zip(sets, rows["sid"].to_pylist(), strict=True)) if len(s) and named(s) == sid]
            sets = [sets[i] for i in asked]
            parts = [(s[s % np.uint64(part) == 0] if part > 1 else s).view(np.int64) for s in sets]
            columns = [rows["sid"].take(pa.array(asked, pa.int32())), pa.array([len(s) for s in sets], pa.int32()), pa.array(parts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["sid", "n", "_set"])

    asked = settled(firsts.select("sid", "doc_id").join(sids, "sid"), "jaccard-asked")
    found = docs.select(F.col("doc_id").cast("long"), F.col("text")).join(few(asked), "doc_id").select("sid", "text")
    return settled(found.mapInArrow(work, "sid long, n int, _set array<long>"), "jaccard-sets", TEXT_BYTES)


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, _n, _m, _x, _y, _i): sizes of the sets of each pair, of what is stored of them and of its intersection."""
    left = sets.select(F.col("sid").alias("u"), F.col("n").alias("_n"), F.col("_set").alias("_a"))
    right = sets.select(F.col("sid").alias("v"), F.col("n").alias("_m"), F.col("_set").alias("_b"))
    sizes = [F.size("_a").cast("long").alias("_x"), F.size("_b").cast("long").alias("_y"), F.size(F.array_intersect("_a", "_b")).cast("long").alias("_i")]
    return pairs.join(left, "u").join(right, "v").select("u", "v", F.col("_n").cast("long"), F.col("_m").cast("long"), *sizes)


def plausible(pairs: DataFrame, parts: DataFrame, sizes: Sizes) -> DataFrame:
    """The pairs that parts of their sets do not rule out: sets that link differ in few members, and in a part in
    no more than in the whole."""
    p, q = sizes.p, sizes.q
    return _met(pairs, parts).where(f"({p} + {q}) * (_x + _y - 2 * _i) <= ({q} - {p}) * (_n + _m)").select("u", "v")


def verified(pairs: DataFrame, sets: DataFrame, sizes: Sizes) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""
    return _met(pairs, sets).where(f"{sizes.q} * _i >= {sizes.p} * (_n + _m - _i)").select("u", "v")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct()


def jaccard_components(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (smallest id reachable by links),
    n_links (all other documents, copies among them, whose sets link with the row's set)."""
    sizes = Sizes(*similarity)
    rows, groups = grouped(docs, words, sizes)
    weights = rows.where("sid IS NOT NULL AND doc_id IS NOT NULL").select("sid", "doc_id").distinct()
    weights = weights.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("weight"))
    placed = weights.join(groups.withColumnRenamed("node", "sid"), "sid", "left").withColumn("home", F.coalesce("component", "sid"))
    placed = settled(placed.drop("component"), "jaccard-placed")
    homes = placed.groupBy("home").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("_members"))
    homes = settled(homes, "jaccard-homes")
    linked = counted(docs, placed.join(homes.where("_members > 1").select("home"), "home"), words, sizes)
    found = placed.join(linked, "sid", "left").select("sid", "home", (F.coalesce("n", "weight") - 1).alias("n_links")).join(homes, "home")
    found = settled(found.select("sid", "component_id", "n_links"), "jaccard-found")
    # a row without words goes with its id
    moved = rows.where("doc_id IS NOT NULL").join(found, "sid").where("component_id != doc_id").select(F.col("doc_id").alias("_id"), F.col("component_id").alias("_c")).distinct()
    out = rows.join(found.select(F.col("sid").alias("_sid"), "n_links"), F.col("sid") == F.col("_sid"), "left").join(moved, F.col("doc_id") == F.col("_id"), "left")
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("_c", "doc_id").alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def grouped(docs: DataFrame, words: int, sizes: Sizes) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sid, n) of all rows, and the components (node, component) of the sets."""
    # the boundary only steers cost, so lengths in words are estimated from characters
    about = F.greatest(F.lit(1), F.floor(F.length("text") / 6) - words + 2).cast("int")
    rows = docs.where("text IS NOT NULL AND text != ''").select(F.least(about, F.lit(4 * MOST_LIGHT)).alias("a")).groupBy("a").count().collect()
    limit = boundary(sizes, {r["a"]: r["count"] for r in rows})
    keys = settled(_met_in_lists(listed(docs, words, sizes, limit)), "jaccard-keys", TEXT_BYTES)
    found = keys.where(F.col("kind") != DOCUMENT).select("key", "sid", "n", "pivot", "pivot_n")
    rows = settled(keys.where(F.col("kind") == DOCUMENT).select("doc_id", "sid", "n"), "jaccard-rows")

    named_rows = rows.where("sid IS NOT NULL AND doc_id IS NOT NULL")
    firsts = named_rows.groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    # rows that share an id are one node
    several = named_rows.groupBy("doc_id").agg(F.min("sid").alias("v"), F.max("sid").alias("_last")).where("v != _last")
    bridges = named_rows.join(several, "doc_id").where("sid != v").select(F.col("sid").alias("u"), "v").distinct()

    fits = f"least(n, pivot_n) * {sizes.q}L >= greatest(n, pivot_n) * {sizes.p}L"
    pairs = found.where(fits).select(F.greatest("sid", "pivot").alias("u"), F.least("sid", "pivot").alias("v")).distinct()
    pairs = settled(pairs, "jaccard-pairs")
    touched = found.select(F.explode(F.array("sid", "pivot")).alias("sid")).distinct()
    parts = sets_of(docs, firsts, touched, words, PART)
    likely = settled(plausible(pairs, parts, sizes), "jaccard-likely")
    sets = sets_of(docs, firsts, _ends(likely), words)
    links = settled(verified(likely, sets, sizes).union(bridges).distinct(), "jaccard-links")
    release(sets)
    groups = settled(components(links), "jaccard-groups")

    members = settled(mixed(found, groups), "jaccard-members")
    release(keys)
    if members.limit(1).count():
        family, worth = families(members)
        release(members)
        family = sifted(family, parts, sizes, PART)
        kept = "centre long, sid long, _stray boolean, _size int"
        small = [some.join(parts, "sid").groupBy("centre").applyInArrow(_surviving(sizes), kept) for some in _rounds(family.where("_fits"), parts)]
        family = in_turn([family.where("NOT _fits").drop("_fits"), *small], "jaccard-family")
        late = settled(plausible(around_centres(worth, sizes).distinct().join(pairs, ["u", "v"], "left_anti"), parts, sizes), "jaccard-late")
        release(worth)
        wanted = _ends(late).union(family.select("sid")).union(family.select("centre")).distinct()
        release(parts)
        sets = sets_of(docs, firsts, wanted, words)
        # each by itself, so that the disks hold the shuffles of one
        near = settled(verified(late, sets, sizes), "jaccard-near")
        inside = within_families(family, sets, sizes)
        release(sets)
        links = settled(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).union(near).union(inside), "jaccard-links")
        groups = components(links)
    # the smallest set of a component has no row in groups
    return rows, settled(groups, "jaccard-groups")


def _met_in_lists(keys: DataFrame) -> DataFrame:
    """The rows of kind DOCUMENT and NEXT, and those of kind FIRST that meet another set of their key, with it as pivot. Keys
    are shuffled as they come and never written otherwise, for few are met again. Further sets of a key are dealt out by
    themselves."""
    further = F.col("kind") == NEXT
    # few columns, and side by side those that differ from row to row: that packs best. A further set is in _other, its pivot in sid
    other = F.when(further, F.col("sid")).otherwise(F.col("doc_id")).alias("_other")
    what = (F.col("n").cast("long") * 16 + F.coalesce("side", F.lit(0)) * 4 + F.col("kind")).alias("_what")
    keys = keys.select("key", F.when(further, F.col("pivot")).otherwise(F.col("sid")).alias("sid"), what, other, "pivot_n")
    kind, side, n = F.expr("_what & 3"), F.expr("(_what >> 2) & 3"), F.expr("int(_what >> 4)")
    lists, first = Window.partitionBy("key", "_other"), kind == FIRST
    one = F.when(first & (side != 1), F.struct("sid", n.alias("n")))
    two = F.when(first & (side != 0), F.struct("sid", n.alias("n")))
    # a set of side 0 is verified against the least of side 1 and the other way round
    met = keys.withColumn("_one", F.min(one).over(lists)).withColumn("_two", F.min(two).over(lists))
    met = met.withColumn("_p", F.when(side == 0, F.col("_two")).otherwise(F.col("_one")))
    met = met.where(~first | (F.col("_p").isNotNull() & (F.col("_p.sid") != F.col("sid"))))
    return met.select(
        kind.cast("byte").alias("kind"),
        F.when(kind == DOCUMENT, F.col("_other")).alias("doc_id"),
        "key",
        F.when(kind == NEXT, F.col("_other")).otherwise(F.col("sid")).alias("sid"),
        n.alias("n"),
        F.when(first, F.col("_p.sid")).when(kind == NEXT, F.col("sid")).alias("pivot"),
        F.when(first, F.col("_p.n")).otherwise(F.col("pivot_n")).alias("pivot_n"),
    )


def mixed(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, sid, n, _c): members of the lists that hold more than one component."""
    of = groups.select(F.col("node"), F.col("component"))
    known = found.join(of.select(F.col("node").alias("sid"), F.col("component").alias("_c")), "sid", "left")
    known = known.join(of.select(F.col("node").alias("pivot"), F.col("component").alias("_pc")), "pivot", "left")
    known = known.withColumn("_c", F.coalesce("_c", "sid")).withColumn("_pc", F.coalesce("_pc", "pivot"))
    rows = known.join(known.where("_c != _pc").select("key").distinct(), "key")
    both = F.array(F.struct("sid", "n", "_c"), F.struct(F.col("pivot").alias("sid"), F.col("pivot_n").alias("n"), F.col("_pc").alias("_c")))
    return rows.select("key", F.explode(both).alias("_m")).select("key", "_m.*").distinct()


def centred(members: DataFrame) -> DataFrame:
    """Members with the centre of their list as `_top`: the set that meets most sets in its lists, as the
    text does that others are copies of."""
    own = Window.partitionBy("key")
    sized = members.withColumn("_m", F.count("*").over(own))
    degree = sized.groupBy("sid").agg(F.sum("_m").alias("_degree"))
    best = F.max(F.struct("_degree", (-F.col("sid")).alias("_order"), "sid", "n", "_c")).over(own)
    return members.join(degree, "sid").withColumn("_top", best)


def around_centres(centred_members: DataFrame, sizes: Sizes) -> DataFrame:
    """Pairs (u, v) of members with their list's centre."""
    fits = f"_c != _top._c AND least(n, _top.n) * {sizes.q}L >= greatest(n, _top.n) * {sizes.p}L"
    top = F.col("_top.sid")
    return centred_members.where(fits).select(F.greatest("sid", top).alias("u"), F.least("sid", top).alias("v"))


def families(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(centre, sid, _stray, _size), and the members with their centres. Lists with one centre are a family;
    its strays are outside the centre's component. The centre itself is left out: it meets all others anyway."""
    around = settled(centred(members), "jaccard-centred")
    family = around.select(F.col("_top.sid").alias("centre"), "sid", "n", (F.col("_c") != F.col("_top._c")).alias("_stray"))
    family = family.where("sid != centre").groupBy("centre", "sid").agg(F.max("_stray").alias("_stray"), F.max("n").alias("_size"))
    family = settled(family, "jaccard-family")
    worth = family.groupBy("centre").agg(F.count("*").alias("_members"), F.max("_stray").alias("_any"))
    return family.join(worth.where("_any AND _members > 1").select("centre"), "centre"), around


def _fitting(family: DataFrame, part: int) -> DataFrame:
    """Families with `_fits`: whether one task can compare all their sets, or every `part`-th hash of these."""
    fits = (F.count("*") <= BLOCK) & (F.sum("_size") <= part * ROOM)
    return family.join(family.groupBy("centre").agg(fits.alias("_fits")), "centre")


def in_turn(parts: list[DataFrame], purpose: str) -> DataFrame:
    """All parts, written one after the other, so that the disks hold the shuffles of one."""
    return reduce(DataFrame.union, [settled(part, purpose, TEXT_BYTES) for part in parts])


def _rounds(family: DataFrame, sets: DataFrame) -> list[DataFrame]:
    """The families in parts, for a set is in as many families as its lists have centres."""
    held = family.agg(F.sum("_size")).first()[0] or 0
    n = -(-held // (COPIES * max(1, sets.agg(F.sum("n")).first()[0] or 0)))
    return [family.where(F.pmod(F.xxhash64("centre"), F.lit(n)) == k) for k in range(n)] if n > 1 else [family]


def _dealt_to_rooms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets cut by their hashes, so that equal members of a family meet in one of its rooms."""
    for rows in batches:
        sets, rooms = rows["_set"], rows["_rooms"].to_numpy()
        flat, own = _flat(sets)
        if not len(flat):
            continue
        # hashes of a part are multiples, so rooms go by the upper half
        room = ((flat.view(np.uint64) >> np.uint64(32)) % rooms[own].astype(np.uint64)).astype(np.int64)
        slot = own * int(rooms.max()) + room
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        at = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        back = pa.array(own[order][at])
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)), pa.int32()), pa.array(flat[order]))
        columns = [rows["centre"].take(back), pa.array(room[order][at]), rows["sid"].take(back), rows["n"].take(back), lists]
        yield pa.RecordBatch.from_arrays(columns, ["centre", "_room", "sid", "n", "_set"])


def _alone(block: pa.Table) -> pa.Table:
    """For every set in a room, how many of its members no other set has."""
    block = _once(block)
    flat, own = _flat(_sets(block))
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    alone = np.bincount(own[times[at] == 1], minlength=len(block))
    return block.select(["centre", "sid", "n"]).append_column("_alone", pa.array(alone, pa.int64()))


def sifted(family: DataFrame, sets: DataFrame, sizes: Sizes, part: int) -> DataFrame:
    """Families (centre, sid, _stray, _size) with `_fits`, the large ones without sets that can link with none of the others:
    a set may have only so many members that a linked one lacks, and no other has those that it has to itself. Takes whole
    sets or parts of them. Each member goes to one room, so this grows with the members, not with their pairs."""
    known = settled(_fitting(family, part), "jaccard-family")
    large = known.where("NOT _fits").drop("_fits")
    if not large.limit(1).count():
        return known

    def left(some: DataFrame) -> DataFrame:
        rooms = some.groupBy("centre").agg(F.ceil(F.sum("_size") / (part * ROOM)).cast("long").alias("_rooms"))
        wide = some.select("centre", "sid").join(rooms, "centre").join(sets, "sid").select("centre", "_rooms", "sid", "n", "_set")
        dealt = wide.mapInArrow(_dealt_to_rooms, "centre long, _room long, sid long, n int, _set array<long>")
        alone = dealt.groupBy("centre", "_room").applyInArrow(_alone, "centre long, sid long, n int, _alone long")
        gone = alone.groupBy("centre", "sid").agg(F.sum("_alone").alias("_alone"), F.max("n").cast("long").alias("n"))
        gone = gone.where(f"{sizes.q} * _alone > ({sizes.q} - {sizes.p}) * n").select("centre", "sid")
        return some.join(gone, ["centre", "sid"], "left_anti")

    sift = in_turn([left(some) for some in _rounds(large, sets)], "jaccard-sifted")
    return known.where("_fits").unionByName(_fitting(sift, part))


def _flat(sets: pa.ListArray | list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The members of all sets, one set after the other, and the number of the set of each."""
    if isinstance(sets, list):
        flat, counts = np.concatenate(sets), [len(s) for s in sets]
    else:
        flat, counts = sets.flatten().to_numpy(), sets.value_lengths().to_numpy()
    return flat, np.repeat(np.arange(len(sets), dtype=np.int32), counts)


def _shared(a: pa.ListArray | list[np.ndarray], b: pa.ListArray | list[np.ndarray]) -> np.ndarray:
    """How many members every set of `a` has in common with every set of `b`. Members that many pairs have are counted by
    products of tables; of the others, which sets that do not link hold in great number, the pairs are listed."""
    shared = np.zeros((len(a), len(b)), np.int64)
    own, rows_a = _flat(a)
    own, n = np.unique(own, return_inverse=True)
    flat, rows_b = _flat(b)
    if not len(own) or not len(flat):
        return shared
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    hit = own[at] == flat
    rows_b, at = rows_b[hit], at[hit]
    count_a, count_b = np.bincount(n, minlength=len(own)), np.bincount(at, minlength=len(own))
    common = count_a * count_b > COMMON * shared.size

    number = np.cumsum(common) - 1
    one, two = common[n], common[at]
    left, right = (number[n[one]], rows_a[one]), (number[at[two]], rows_b[two])
    for c in range(0, int(common.sum()), COLUMNS):
        m, k = np.zeros((len(a), COLUMNS), np.float32), np.zeros((len(b), COLUMNS), np.float32)
        for table, (column, row) in ((m, left), (k, right)):
            here = (column >= c) & (column < c + COLUMNS)
            table[row[here], column[here] - c] = 1
        shared += (m @ k.T).astype(np.int64)

    rows_a = rows_a[np.argsort(n, kind="stable")]
    start = np.cumsum(count_a) - count_a
    rows_b, at = rows_b[~two], at[~two]
    upto = np.cumsum(count_a[at])
    first = 0
    while first < len(at):
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
        times = count_a[at[first:last]]
        place = np.repeat(start[at[first:last]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        pair = rows_a[place].astype(np.int64) * len(b) + np.repeat(rows_b[first:last], times)
        shared += np.bincount(pair, minlength=shared.size).reshape(shared.shape)
        first = last
    return shared


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """A column without nulls."""
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def _sets(block: pa.Table) -> pa.ListArray:
    return block["_set"].combine_chunks()


def _once(block: pa.Table) -> pa.Table:
    """A row for every set."""
    _, first = np.unique(_numbers(block["sid"]), return_index=True)
    return block if len(first) == len(block) else block.take(pa.array(np.sort(first)))


def _sides(block: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Left and right side of a block, every set once."""
    left = _numbers(block["_left"])
    return _once(block.filter(pa.array(left))), _once(block.filter(pa.array(~left)))


def _surviving(sizes: Sizes):
    """Function of one family, by parts of sets: the members that the parts do not rule out as ends of a link between a
    stray and another member."""
    p, q = sizes.p, sizes.q

    def survivors(block: pa.Table) -> pa.Table:
        right = _once(block)
        stray = _numbers(right["_stray"])
        if not stray.any():
            return right.select(["centre", "sid", "_stray", "_size"])
        b, sid, full = _sets(right), _numbers(right["sid"]), _numbers(right["n"]).astype(np.int64)
        y = b.value_lengths().to_numpy()
        good = (p + q) * (y[stray, None] + y - 2 * _shared(b.filter(pa.array(stray)), b)) <= (q - p) * (full[stray, None] + full)
        good &= (q * full[stray, None] >= p * full) & (q * full >= p * full[stray, None])
        good &= sid[stray, None] != sid
        kept = good.any(axis=0)
        kept[stray] |= good.any(axis=1)
        return right.select(["centre", "sid", "_stray", "_size"]).filter(pa.array(kept))

    return survivors


def _stars(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a table of links, a row of the same component (-1: no link)."""
    rows, columns = np.full(good.shape[0], -1), np.full(good.shape[1], -1)
    for start in np.flatnonzero(good.any(axis=1)):
        new = np.array([start]) if rows[start] < 0 else np.zeros(0, np.int64)
        while len(new):
            rows[new] = start
            met = np.flatnonzero(good[new].any(axis=0) & (columns < 0))
            columns[met] = start
            new = np.flatnonzero(good[:, met].any(axis=1) & (rows < 0))
    return rows, columns


def _strays(block: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The strays of a family and all its members, every set once."""
    block = _once(block)
    return block.filter(pa.array(_numbers(block["_stray"]))), block


def _comparing(sizes: Sizes, sides=_sides):
    """Function of one block: its links, as a star for each of their components."""
    p, q = sizes.p, sizes.q

    def compared(block: pa.Table) -> pa.Table:
        left, right = sides(block)
        if not len(left) or not len(right):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        shared = _shared(_sets(left), _sets(right))
        full_a, full_b = _numbers(left["n"]).astype(np.int64)[:, None], _numbers(right["n"]).astype(np.int64)
        rows, columns = _stars(q * shared >= p * (full_a + full_b - shared))
        one, two = _numbers(left["sid"]), _numbers(right["sid"])
        u = np.concatenate([one[rows >= 0], two[columns >= 0]])
        return pa.table({"u": u, "v": one[np.concatenate([rows[rows >= 0], columns[columns >= 0]])]})

    return compared


def _counting(sizes: Sizes):
    """Function of one block of differences from a centre: for its sets, the documents of the sets they link with,
    without those pairs that link whatever the differences are."""
    twice = 2 * (sizes.p + sizes.q)

    def compared(block: pa.Table) -> pa.Table:
        left, right = _sides(block)
        if not len(left) or not len(right):
            return pa.table({"sid": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        need = _numbers(left["_over"])[:, None] + _numbers(right["_over"])
        good = (need > 0) & (need <= twice * _shared(_sets(left), _sets(right)))
        one, two = _numbers(left["sid"]), _numbers(right["sid"])
        good &= one[:, None] != two
        # two sets of the left meet in two blocks, each on the left of one
        near = ~_numbers(right["_stray"])
        n = np.concatenate([good @ _numbers(right["weight"]), (_numbers(left["weight"]) @ good)[near]])
        return pa.table({"sid": np.concatenate([one, two[near]])[n > 0], "n": n[n > 0]})

    return compared


def _centred_on(members: DataFrame, middle: DataFrame, sets: DataFrame, sizes: Sizes) -> DataFrame:
    """Members (home, sid) with their set, that in the middle of their home (home, _mid), and their distance from it in rings:
    Jaccard distance is a metric, so sets whose distances differ by more than a link's distance do not link. The
    members of small homes are all in one ring; a middle is dealt to as many places as its members fill."""
    zero = F.lit(0).cast("long")
    places = members.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("_places"))
    middle = middle.join(places, "home").select("home", "_places", "_mid", F.explode(F.sequence(zero, F.col("_places") - 1)).alias("_place"))
    placed = members.join(places, "home").withColumn("_place", F.pmod(F.xxhash64("sid"), F.col("_places")))
    placed = placed.drop("_places").join(sets, "sid").join(middle, ["home", "_place"])
    x, y, both = F.size("_set"), F.size("_mid"), F.size(F.array_intersect("_set", "_mid"))
    width = (1 - sizes.p / sizes.q) * (1 + 1e-9)
    ring = F.when(F.col("_places") > 1, F.floor((1 - both / (x + y - both)) / width)).otherwise(zero)
    return placed.withColumn("_ring", ring).drop("_place", "_places")


def _majority(block: pa.Table) -> pa.Table:
    """The hashes that more than half of a home's sets have; of two sets, the first."""
    sets = _sets(_once(block).sort_by("sid"))
    hashes = np.sort(sets.flatten().to_numpy())
    at = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    often = hashes[at[2 * np.diff(np.append(at, len(hashes))) > len(sets)]]
    middle = pa.array([often], pa.list_(pa.int64())) if len(sets) > 2 else sets[:1]
    return pa.table({"home": block["home"].slice(0, 1), "_mid": middle})


def _in_blocks(placed: DataFrame, function, schema: str, carry: list[str]) -> list[DataFrame]:
    """`function` of Arrow tables over blocks that bring every stray of a home together with every member of its ring and the next
    ones: columns home, sid, _stray, _ring, _set and those carried. The blocks come in rounds, for a set is in many."""
    room = F.sum(F.size("_set"))
    stray_room = F.sum(F.when(F.col("_stray"), F.size("_set")))
    counts = placed.groupBy("home", "_ring").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK, room / ROOM)).cast("long").alias("_all"),
        F.coalesce(F.ceil(F.greatest(F.count_if("_stray") / BLOCK, stray_room / ROOM)).cast("long"), F.lit(0)).alias("_strays"),
        room.alias("_room"),
        F.coalesce(stray_room, F.lit(0)).alias("_stray_room"),
    )
    # a set of no members still fills a block
    counts = counts.withColumn("_all", F.greatest("_all", F.lit(1)))
    counts = counts.select("home", F.col("_ring").alias("_other"), "_all", "_strays").join(
        counts.select("home", "_ring", F.col("_all").alias("_own"), F.col("_strays").alias("_own_strays"), "_room", "_stray_room"), "home"
    )
    counts = counts.where("abs(_ring - _other) <= 1 AND (_strays > 0 OR _own_strays > 0)")
    held = counts.agg(F.sum(F.expr("_stray_room * _all + _room * _strays"))).first()[0] or 0
    rounds = max(1, -(-held // (COPIES * max(1, placed.agg(room).first()[0] or 0))))
    wide = placed.join(counts.drop("_room", "_stray_room"), ["home", "_ring"])
    part, zero = F.xxhash64("sid"), F.lit(0).cast("long")
    one = wide.where("_stray").select(
        "home", F.col("_ring").alias("_a"), F.col("_other").alias("_b"), F.pmod(part, "_own_strays").alias("_i"),
        F.explode(F.sequence(zero, F.col("_all") - 1)).alias("_j"), F.lit(True).alias("_left"), "sid", "_stray", "_set", *carry,
    )
    two = wide.where("_strays > 0").select(
        "home", F.col("_other").alias("_a"), F.col("_ring").alias("_b"),
        F.explode(F.sequence(zero, F.col("_strays") - 1)).alias("_i"), F.pmod(part, "_own").alias("_j"), F.lit(False).alias("_left"), "sid", "_stray", "_set", *carry,
    )
    block = ["home", "_a", "_b", "_i", "_j"]
    both = one.union(two)
    some = [both.where(F.pmod(F.xxhash64(*block), F.lit(rounds)) == k) for k in range(rounds)] if rounds > 1 else [both]
    return [x.groupBy(*block).applyInArrow(function, schema) for x in some]


def within_families(family: DataFrame, sets: DataFrame, sizes: Sizes) -> DataFrame:
    """Links (u, v) of the strays of families (centre, sid, _stray, _size) with other members: enough of them to show the
    components."""
    family = sifted(family, sets, sizes, 1)
    small = [some.join(sets, "sid").groupBy("centre").applyInArrow(_comparing(sizes, _strays), "u long, v long") for some in _rounds(family.where("_fits"), sets)]
    found = in_turn([links.where("u != v").distinct() for links in small], "jaccard-within")
    large = family.where("NOT _fits").select(F.col("centre").alias("home"), "sid", "_stray")
    if not large.limit(1).count():
        return found
    middle = sets.select(F.col("sid").alias("home"), F.col("_set").alias("_mid")).dropDuplicates(["home"])
    placed = settled(_centred_on(large, middle, sets, sizes).drop("_mid"), "jaccard-families")
    blocks = _in_blocks(placed, _comparing(sizes), "u long, v long", ["n"])
    blocks = in_turn([links.where("u != v").distinct() for links in blocks], "jaccard-within")
    release(placed)
    return found.union(blocks)


def counted(docs: DataFrame, members: DataFrame, words: int, sizes: Sizes) -> DataFrame:
    """(sid, n): the documents of a set and of all sets it links with, for the members (home, sid, doc_id,
    weight) of components of several sets."""
    p, q = sizes.p, sizes.q
    members = settled(members, "jaccard-counted")
    sets = sets_of(docs, members, members.select("sid"), words)
    # any middle will do; the majority of some members lies near most
    some = members.join(members.groupBy("home").agg(F.count("*").alias("_members")), "home")
    some = some.where((F.pmod(F.xxhash64("sid"), F.col("_members")) < MIDDLE) | (F.col("sid") == F.col("home"))).select("home", "sid")
    middle = some.join(sets, "sid").groupBy("home").applyInArrow(_majority, "home long, _mid array<long>")
    placed = _centred_on(members.drop("doc_id"), settled(middle, "jaccard-middle"), sets, sizes)
    apart = F.concat(F.array_except("_set", "_mid"), F.array_except("_mid", "_set"))
    placed = placed.withColumn("_set", apart).drop("_mid")
    placed = placed.withColumn("_over", (p + q) * F.size("_set").cast("long") - (q - p) * F.col("n").cast("long"))
    placed = settled(placed.withColumn("_stray", F.col("_over") > 0), "jaccard-apart")
    release(sets)

    # sets link if _over and the other's are at most 0 together, or share as many differences as they are beyond
    once = placed.select("home", "sid", "weight", "_over").distinct()
    levels = once.groupBy("home", "_over").agg(F.sum("weight").alias("_weight"))
    upto = Window.partitionBy("home").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    asked = levels.select("home", (-F.col("_over")).alias("_at"), F.lit(0).cast("long").alias("_weight"), F.col("_over").alias("_for"))
    there = levels.select("home", F.col("_over").alias("_at"), "_weight", F.lit(None).cast("long").alias("_for"))
    sums = asked.union(there).withColumn("_n", F.sum("_weight").over(upto)).where("_for IS NOT NULL").select("home", F.col("_for").alias("_over"), "_n")
    plain = once.join(sums, ["home", "_over"]).select("sid", (F.col("_n") + F.when(F.col("_over") > 0, F.col("weight")).otherwise(0)).alias("n"))
    rest = _in_blocks(placed.where(F.size("_set") > 0), _counting(sizes), "sid long, n long", ["weight", "_over"])
    counts = [x.groupBy("sid").agg(F.sum("n").alias("n")) for x in rest]
    return settled(plain.union(in_turn(counts, "jaccard-linked")).groupBy("sid").agg(F.sum("n").alias("n")), "jaccard-counts")
