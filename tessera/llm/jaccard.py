"""Exact Jaccard join of sets of word n-grams, size-aware: subsets for small sets, inverted lists for large ones.

Equal sets are one node, so copies cost one row. For a least similarity of t = NUM/DEN, two sets of a and b grams link when they share
at least o(a, b) = ceil(NUM (a + b) / (NUM + DEN)).

**Light.** For a set of at most ``boundary`` grams, all subsets of the sizes o(a, b) that a partner of up to that size could
share are enumerated; linked sets meet in an equal subset.
**Heavy.** Larger sets meet in inverted lists of their first a - ceil(t a) + 1 grams in one order of all grams: rare ones
first. That order puts the grams counted most often (at most ``FREQUENT``) last and goes by hash otherwise; whatever it is, no
link is lost. Small sets that may link with large ones are in those lists, too.
**Boundary.** The size from which lists cost less, by the counts of sizes, the numbers of subsets and the expected length
of a list.

Lists are built of 64-bit names of sets that begin with the logarithm of the size, so sets too far apart in size are told apart before
their sizes are known; a list of just two such sets is dropped. A shared name costs a candidate more and loses none.

Within a list, every set is first held against the list's first one: as many candidates as postings. Links are joined to
components. Only lists that still hold several components go on, in cells of at most ``CELL`` sets each: a set is held
against its nearest partners of other components, then against more, then all. So a group of near copies costs about its
size, and no pair that could join two components is left out. A candidate must pass the bound that its sizes and 256-bit parity
sketches give, which never rejects a link; then the two whole sets are intersected.
"""

from __future__ import annotations

import itertools
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _ODD, materialize, mix, release, slices, texts_of, word_hashes
from ..operators.graph import contracted

FREQUENT, CELL, BROADCAST_IDS = 65_536, 1024, 1_000_000
LARGEST_LIGHT = 24
RANKS = (4, 64, 2 * CELL)


class Rule:
    """Sizes and overlaps of a least similarity num / den."""

    def __init__(self, num: int = 9, den: int = 10):
        self.num, self.den = num, den

    def overlap(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))

    def partners(self, a: int) -> range:
        return range(-(-self.num * a // self.den), self.den * a // self.num + 1)

    def prefix(self, a: int) -> int:
        return a - -(-self.num * a // self.den) + 1 if a else 0

    def reach(self) -> int:
        """Sets that link have size codes at most so far apart."""
        return int(CODES * np.log2(self.den / self.num) + 1e-6) + 1

    def subset_sizes(self, a: int, most: int) -> set[int]:
        """Sizes of the subsets that a set of ``a`` grams is enumerated by, for unequal partners of at most ``most`` grams."""
        sizes = {self.overlap(a, b) for b in self.partners(a) if b <= most and self.overlap(a, b) <= min(a, b)}
        return {o for o in sizes if o < a or any(b > a and b <= most and self.overlap(a, b) == a for b in self.partners(a))}

    def boundary(self, sizes: dict[int, int], list_length: float) -> int:
        """The largest size whose sets are enumerated, at the least cost in rows written and read."""

        def cost(most: int) -> float:
            total = 0.0
            for a, n in sizes.items():
                if a <= most:
                    total += n * sum(comb(a, o) for o in self.subset_sizes(a, most))
                if a >= -(-self.num * (most + 1) // self.den):
                    total += n * self.prefix(a) * (1 + list_length)
            return total

        return min(range(LARGEST_LIGHT + 1), key=lambda most: (cost(most), most))


def gram_sets(texts: list[str], n: int = 3) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word n-grams, words lower-cased in A-Z.

    A text of fewer than n words has its whole sequence as one; a text without words has none.
    """
    words, counts = word_hashes(texts)
    times = [mix(np.array([i + 1], np.uint64) * _ODD)[0] | np.uint64(1) for i in range(n)]
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i, m in enumerate(times):
        grams += words[i : len(words) - n + 1 + i] * m
    grams = mix(grams)
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(grams[at : at + c - n + 1]))
        elif c:
            short = np.full(1, c, np.uint64)
            for k in range(at, at + c):
                short = mix(short * times[0] + words[k])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def node_of(grams: np.ndarray) -> bytes:
    """128-bit name of a set."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(grams.tobytes())


#: A name's first 11 bits are the logarithm of the size in steps of 1 / CODES, the other 52 are of the set's hash.
CODES, CODE_BITS = 64, 52


def short_names(sets: list[np.ndarray], nodes: list[bytes]) -> np.ndarray:
    """64-bit names of sets, in order of size."""
    code = (CODES * np.log2(np.maximum([len(s) for s in sets], 1))).astype(np.int64)
    return code << CODE_BITS | (np.frombuffer(b"".join(nodes), "<u8")[::2] >> np.uint64(64 - CODE_BITS)).astype(np.int64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Four 64-bit integers for each set: bit i is the parity of its grams that fall on i. Sets that differ in d grams differ in at most d bits."""
    size = [len(s) for s in sets]
    place = np.repeat(np.arange(len(sets)), size) * 256 + (np.concatenate(sets) & np.uint64(255)).astype(np.int64) if sum(size) else np.zeros(0, np.int64)
    odd = (np.bincount(place, minlength=256 * len(sets)) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(len(sets), 4)


#: Sets of at least so many grams also get a profile: in larger sets, parities tell little.
PROFILED = 800


def profile(s: np.ndarray) -> bytes | None:
    """Counts of a large set's grams by another 8 bits of theirs: sets that differ in d grams have counts that differ by at most d in all."""
    if len(s) < PROFILED:
        return None
    return np.minimum(np.bincount((s >> np.uint64(8) & np.uint64(255)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


SIGNS = "doc_id long, row long, n int, node binary, name long, s0 long, s1 long, s2 long, s3 long, profile binary, gram long, times long"
SKETCH = ("s0", "s1", "s2", "s3")


def signatures(docs: DataFrame, grams: int) -> DataFrame:
    """A row for each document, and rows (gram, times) of grams that several documents of a slice share."""

    def run(batches):
        names, kinds = [x.split()[0] for x in SIGNS.split(", ")], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        kinds = [kinds[x.split()[1]] for x in SIGNS.split(", ")]
        gram, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def rows(columns):
            n = max(map(len, columns.values()))
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)], names)

        def counts(some):
            return rows({"gram": gram[some].view(np.int64), "times": times[some]})

        for b in slices(batches, 1024, 2_000_000):
            sets = gram_sets(texts_of(b, "text"), grams)
            nodes, s = [node_of(x) for x in sets], sketches(sets)
            yield rows({"doc_id": b.column("doc_id"), "row": b.column("row"), "n": [len(x) for x in sets], "node": nodes, "name": short_names(sets, nodes), "profile": [profile(x) for x in sets], **{c: s[:, i] for i, c in enumerate(SKETCH)}})
            g, t = np.unique(np.concatenate(sets), return_counts=True)
            g, t = np.concatenate([gram, g[t > 1]]), np.concatenate([times, t[t > 1]])
            gram, back = np.unique(g, return_inverse=True)
            times = np.bincount(back, t, len(gram)).astype(np.int64)
            if len(gram) > 1_000_000:
                yield counts(times > 3)
                gram, times = gram[:0], times[:0]
        yield counts(times > 3)

    return docs.mapInArrow(run, SIGNS)


def postings(docs: DataFrame, grams: int, rule: Rule, boundary: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(sign, name): what sets meet in. Copies within a partition give theirs once."""
    handle = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT grams
    low = -(-rule.num * (boundary + 1) // rule.den)

    def signs(s: np.ndarray) -> np.ndarray:
        out, a = [], len(s)
        if a <= boundary:
            m = mix(s)
            for o in rule.subset_sizes(a, boundary):  # a subset is named by the sum of its grams and its size
                left_out = np.array(list(itertools.combinations(range(a), a - o)), np.int64).reshape(comb(a, o), a - o)
                out.append(mix(np.full(len(left_out), m.sum()) - m[left_out].sum(1, dtype=np.uint64) + np.full(1, o, np.uint64) * _ODD))
        if a >= low:
            known, kind = handle.value
            at = np.searchsorted(known, s)
            at[at == len(known)] = 0
            order = np.where(known[at] == s, kind[at], 0) if len(known) else np.zeros(a, np.int64)
            out.append(s[np.lexsort((s, order))[: rule.prefix(a)]])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def run(batches):
        seen: set[int] = set()
        for b in slices(batches, 1024, 2_000_000):
            sets = [s for s in gram_sets(texts_of(b, "text"), grams) if len(s)]
            if not sets:
                continue
            found, at = [], []
            names = short_names(sets, [node_of(s) for s in sets])
            for k, name in enumerate(names.tolist()):
                if name not in seen:
                    if len(seen) < 500_000:
                        seen.add(name)
                    found.append(signs(sets[k]))
                    at.append(k)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(names[at], [len(f) for f in found]))], ["sign", "name"])

    return docs.where("doc_id is not null").select("text").mapInArrow(run, "sign long, name long")


def profile_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs(x.reshape(-1, 256).astype(np.int16) - y.reshape(-1, 256)).sum(1, dtype=np.int64)


def could_link(rule: Rule, a: str = "a", b: str = "b"):
    """Whether sizes and sketches leave a link possible."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(4)), F.lit(0))
    fits = (F.greatest(n, m) * rule.num <= F.least(n, m) * rule.den)
    return fits & ((rule.num + rule.den) * (n + m - apart) >= 2 * rule.num * (n + m))


def code(column) -> Column:
    return F.shiftright(column, CODE_BITS)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, grams: int, rule: Rule) -> DataFrame:
    """Those of ``pairs`` (a, b: names) whose sets link, as (a, b: nodes)."""
    short = nodes.select("name", "node", F.col("rep.doc_id").alias("doc"), "n", *SKETCH, "profile").hint("merge")
    pairs = pairs.repartition("a").distinct()  # one exchange serves the distinct and the first join
    some = pairs.alias("p").join(short.alias("a"), F.expr("p.a = a.name")).join(short.alias("b"), F.expr("p.b = b.name")).where(could_link(rule))
    some = some.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.doc").alias("a_doc"), F.col("b.doc").alias("b_doc"), (F.col("a.n") + F.col("b.n")).alias("size"), F.col("a.profile").alias("x"), F.col("b.profile").alias("y"))
    num, both = rule.num, rule.num + rule.den

    def near(batches):
        for b in slices(batches, 2048, 4_000_000):
            x, y, size = b.column("x").to_pylist(), b.column("y").to_pylist(), b.column("size").to_numpy()
            keep = np.ones(len(x), bool)
            if at := [k for k in range(len(x)) if x[k] and y[k]]:
                apart = profile_distance(np.frombuffer(b"".join(x[k] for k in at), np.uint8), np.frombuffer(b"".join(y[k] for k in at), np.uint8))
                keep[at] = both * (size[at] - apart) >= 2 * num * size[at]
            yield b.select(["a", "b", "a_doc", "b_doc"]).filter(pa.array(keep))

    some = materialize(some.mapInArrow(near, "a binary, b binary, a_doc long, b_doc long"), "candidates")
    ids = materialize(some.select(F.col("a_doc").alias("doc_id")).union(some.select("b_doc")).distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")

    def sets(batches):
        for b in slices(batches, 1024, 2_000_000):
            found = gram_sets(texts_of(b, "text"), grams)
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "grams"])

    held = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("text").mapInArrow(sets, "node binary, grams binary")
    held = materialize(held.groupBy("node").agg(F.first("grams").alias("grams")), "sets")

    def intersect(batches):
        for b in slices(batches, 512, 8_000_000):
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(both * len(np.intersect1d(x, y, assume_unique=True)) >= num * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    whole = some.select("a", "b").join(held.select(F.col("node").alias("a"), F.col("grams").alias("x")).hint("merge"), "a").join(held.select(F.col("node").alias("b"), F.col("grams").alias("y")).hint("merge"), "b")
    out = materialize(whole.select("a", "b", "x", "y").mapInArrow(intersect, "a binary, b binary"), "links")
    release(some, held)
    return out


def cell_pairs(lists: DataFrame, nodes: DataFrame, roots: DataFrame, rule: Rule, low: int, high: int) -> DataFrame:
    """Candidates (a, b) between different components that share a list, those of rank above ``low`` to ``high``, as rows (a, b, null), and (null, null, sign) of lists that have more.

    ``lists`` (sign, name, lead, times). A list of many sets is dealt out in shards, and each pair of shards is a cell.
    """
    label = nodes.select("name", "node").join(roots.hint("merge"), "node", "left").select("name", F.xxhash64(F.coalesce("root", "node")).alias("root"))
    labelled = materialize(lists.join(label.hint("merge"), "name"), "labelled")
    mixed = labelled.groupBy("sign").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("sign")
    rows = labelled.join(mixed.hint("merge"), "sign", "left_semi").join(nodes.select("name", "n", *SKETCH, "profile").hint("merge"), "name")
    rows = rows.withColumn("shards", F.ceil(F.col("times") / (CELL // 2)).cast("int"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("name"), F.col("shards")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    rows = rows.withColumn("i", F.least("shard", "other")).withColumn("j", F.greatest("shard", "other"))
    columns = ["sign", "i", "j", "name", (F.col("name") == F.col("lead")).alias("lead"), "root", "n", *SKETCH, "profile"]
    rows = rows.select(*columns).repartition("sign", "i", "j").sortWithinPartitions("sign", "i", "j", "name")
    num, den = rule.num, rule.den

    def pairs(node, root, lead, n, s, profiles):
        """(left places, right places, whether more are left) of a cell, given as arrays."""
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        node, root, lead, n, s = node[first], root[first], lead[first], n[first], s[first]
        if len(node) < 2 or (root == root[0]).all():
            return first[:0], first[:0], False
        total = n[:, None] + n
        other = root[:, None] != root
        fits = np.maximum(n[:, None], n) * num <= np.minimum(n[:, None], n) * den
        fits[:, lead] = fits[lead] = False  # held against all before
        np.fill_diagonal(fits, False)
        if not (fits & other).any():
            return first[:0], first[:0], False
        apart = np.bitwise_count(s[:, None] ^ s[None]).sum(2).astype(np.int64)
        fits &= (num + den) * (total - apart) >= 2 * num * total
        large = np.flatnonzero(n >= PROFILED)
        if len(large) > 1:
            p = np.frombuffer(b"".join(profiles[first[k]] for k in large), np.uint8).reshape(-1, 256)
            for k, row in zip(large, p, strict=True):
                apart[k, large] = np.maximum(apart[k, large], profile_distance(p, row))
            fits &= (num + den) * (total - apart) >= 2 * num * total
        open_ = fits & other
        if not open_.any():
            return first[:0], first[:0], False
        order = np.argsort(np.where(fits, apart, 1 << 40), 1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(1, len(node) + 1)[None].repeat(len(node), 0), 1)
        now = open_ & (rank > low) & (rank <= high)
        x, y = np.nonzero(np.triu(now | now.T))
        return first[x], first[y], bool((open_ & (np.minimum(rank, rank.T) > high)).any())

    def run(batches):
        rest = None
        for b in itertools.chain(slices(batches, 4096, 16_000_000), [None]):
            t = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if t is None or not t.num_rows:
                continue
            t = t.combine_chunks()
            sign, i, j = (t.column(c).to_numpy() for c in ("sign", "i", "j"))
            cut = [0, *(np.flatnonzero((sign[1:] != sign[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), t.num_rows]
            last = len(cut) - (1 if b is None else 2)
            rest = None if b is None else t.slice(cut[last])
            if not last:
                continue
            node, root, lead = (t.column(c).to_numpy() for c in ("name", "root", "lead"))
            n, s = t.column("n").to_numpy().astype(np.int64), np.stack([t.column(c).to_numpy() for c in SKETCH], 1).view(np.uint64)
            profiles, left, right, more = t.column("profile").to_pylist(), [], [], []
            for a, z in itertools.pairwise(cut[: last + 1]):
                if z - a > 1:
                    x, y, again = pairs(node[a:z], root[a:z], lead[a:z], n[a:z], s[a:z], profiles[a:z])
                    left.append(x + a)
                    right.append(y + a)
                    if again:
                        more.append(int(sign[a]))
            if left and (more or sum(map(len, left))):
                a, z = (node[np.concatenate(side)] for side in (left, right))
                none = [None] * len(more)
                yield pa.RecordBatch.from_arrays([pa.array([*a.tolist(), *none], pa.int64()), pa.array([*z.tolist(), *none], pa.int64()), pa.array([None] * len(a) + more, pa.int64())], ["a", "b", "sign"])

    out = materialize(rows.mapInArrow(run, "a long, b long, sign long"), "pairs")
    release(labelled)
    return out


def near_duplicates(docs: DataFrame, *, grams: int = 5, num: int = 4, den: int = 5, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs``.

    Sets of word n-grams link when den * intersection >= num * union; component_id is the smallest doc_id that links lead to. A null or
    empty text, or one without words, has no set (0) and is its own component. Rows of one doc_id are judged each by its own set.
    Rows without a doc_id link with nothing and have a null component. An empty table gives an empty result. Other columns aren't
    read, but for ``row``, a column of distinct integers, if it is named: the result then has it, too, and ``first``, true for one row of each
    component, that of the smallest doc_id and ``row``, and for each row without a set or a doc_id.
    """
    rule = Rule(num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col(row).cast("long") if row else F.lit(0).cast("long")).alias("row"))
    signs = materialize(signatures(docs, grams), "signatures")
    frequent = signs.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "gram").limit(FREQUENT).toPandas()
    of_docs = signs.where("node is not null")
    nodes = of_docs.where("doc_id is not null and n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("rep"), *(F.first(c).alias(c) for c in ("name", "n", *SKETCH, "profile")))
    nodes = materialize(nodes, "nodes")
    sizes = nodes.groupBy(F.least("n", F.lit(2 * LARGEST_LIGHT)).alias("n")).count().collect()
    gram, times = frequent["gram"].to_numpy(np.int64).view(np.uint64), frequent["times"].to_numpy(np.int64)
    order = np.argsort(gram)
    all_grams = nodes.agg(F.sum("n")).first()[0] or 1
    boundary = rule.boundary({r.n: r["count"] for r in sizes}, 1 + float((times.astype(float) ** 2).sum()) / all_grams)
    meet = materialize(postings(docs, grams, rule, boundary, (gram[order], np.log2(np.maximum(times[order], 1)).astype(np.int64))), "postings")
    shared = meet.groupBy("sign").agg(F.min("name").alias("lead"), F.max("name").alias("last"), F.count("*").alias("times"))
    reach = rule.reach()
    shared = materialize(shared.where((F.col("lead") < F.col("last")) & ((F.col("times") > 2) | (code("last") - code("lead") <= reach))).drop("last"), "lists")
    lists = materialize(meet.join(shared.hint("merge"), "sign"), "members")
    release(meet, shared)
    led = lists.where((F.col("name") != F.col("lead")) & (code("name") - code("lead") <= reach))
    links = verified(led.select(F.col("name").alias("a"), F.col("lead").alias("b")), nodes, docs, grams, rule)
    roots = materialize(contracted(links), "roots")
    low, open_, more = 0, lists.where("times > 2"), None
    for high in RANKS:
        pairs = cell_pairs(open_, nodes, roots, rule, low, high)
        found = pairs.where("b is not null").select("a", "b")
        if found.limit(1).count():
            links = verified(found, nodes, docs, grams, rule)
            roots = materialize(contracted(links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")
        more = pairs.where("sign is not null").select("sign").distinct()
        if not more.limit(1).count():
            break
        low, open_ = high, lists.join(more.hint("merge"), "sign", "left_semi")
    else:
        raise RuntimeError("lists still hold pairs that weren't compared")
    # the smallest row of each component, then of each node, then of each row: the last join alone meets hot nodes
    named = nodes.select("node", "rep").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("least"))
    named = materialize(named.join(smallest.hint("merge"), "root").select("node", "least"), "components")
    release(lists)
    out = of_docs.select("doc_id", "row", F.col("n").cast("long").alias("n_shingles"), "node").join(named.hint("merge"), "node", "left")
    has = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = out.withColumn("component_id", F.when(has, F.col("least.doc_id")).otherwise(F.col("doc_id"))).withColumn("first", ~has | (F.struct("doc_id", "row") == F.col("least")))
    return out.select("doc_id", "n_shingles", "component_id", *([F.col("row").alias(row), "first"] if row else []))
