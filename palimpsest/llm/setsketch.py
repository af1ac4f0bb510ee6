"""Near-duplicate documents by SetSketch registers.

A document's sketch has ``REGISTERS`` registers. Register i is the smallest of one exponential variable per
shingle, on an exponentially spaced scale, truncated to whole steps, so sketches of parts merge by the
larger register. Bands of registers are the keys of buckets. Two sketches estimate the Jaccard
similarity jointly by maximum likelihood, given how many registers are larger, smaller and equal; pairs far
below the threshold go, all others are confirmed on the full sets of shingles.

Links are sought in two passes. Documents with the same set are one class first. Each bucket has a centre, its member
with the most company in all its buckets. In the first pass each class is tried against two centres, its home, which is
the one with the most company of those not far by the estimate, and the nearest one. So a bucket of any size costs two
pairs a member, and most of a group of copies becomes one component around one home. The second pass looks for the links between
what is in one bucket and not yet in one component:

* Of classes u, v with the same home c, one, say u, is not linked to c. Let r be what a class lacks of c, a what it adds, in numbers, and
  q = t a + r. Then u and v are linked only if (1 + t) (shared r + shared a) >= q_u + q_v - (1 - t) c. What both lack is often the same, so
  what they add decides: either (1 + t) least(r_u, r_v) alone is enough, which is told from numbers (by kinds of classes, not pair
  by pair), or they share m or more of what they add, (1 + t) m >= q_u - (1 - t) c + t (a - r) for the least a - r around the home. Then one of them
  is among all but the m - 1 most common that u adds: pairs are found by a join on those, most of which are u's alone, and decided by
  what differs.
* Classes with different homes are paired if they share a bucket, tried by the estimate and confirmed on the full sets.

Nothing that shares a bucket and is not already connected is left out.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WIDE_ROWS, groups_of, map_rows, saved, table
from .components import components
from .words import mixed, shingle_sets

#: 45 bands of 6: two documents of similarity 0.8 share no band once in 800,000 times, two of 0.3 share one 3 % of the time.
BANDS, ROWS = 45, 6
REGISTERS = BANDS * ROWS
#: Ratio of the scale's steps.
STEP = 1.001
#: Pairs whose estimate is this far under the threshold are not confirmed: five standard deviations.
MARGIN = 0.12
#: A class has its home at a centre that its estimate is so near to.
SAME_GROUP = 0.5
#: Bits at most of the map of documents whose sets are needed: 16 for each, 16 MB together; some others share a bit and are sent in vain.
MOST_BITS = 1 << 27

_rng = np.random.default_rng(19)
FLIP = _rng.integers(0, 1 << 32, (REGISTERS, 1), dtype=np.uint32)
TIMES = _rng.integers(0, 1 << 31, (REGISTERS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
BAND_SALT = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def smallest(items: np.ndarray) -> np.ndarray:
    """For each register the smallest 32-bit value over the items."""
    low = (items >> np.uint64(32)).astype(np.uint32)
    out = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(low), 2048):
        y = low[None, k : k + 2048] ^ FLIP
        y *= TIMES
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x7FEB352D)
        np.minimum(out, y.min(axis=1), out=out)
    return out


def registers(items: np.ndarray) -> np.ndarray:
    """The sketch of a set: floor(1 - log(x)) for the smallest exponential variable x, from 1 to 65,535; 0 if empty."""
    if not len(items):
        return np.zeros(REGISTERS, dtype="<u2")
    x = -np.log1p(-(smallest(items).astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(x) / math.log(STEP)) + 4096, 1, 65535).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each row and band."""
    parts = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    key = parts[..., 0]
    for k in range(1, ROWS):
        key = mixed(key ^ BAND_SALT) + parts[..., k]
    return mixed(key ^ BAND_SALT).view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarity of each pair of sketches, given the sizes of the sets.

    With u and v the sizes as shares of their sum, a register of the first is larger with chance
    p(u - vJ) and of the second with p(v - uJ), p(x) = -log(1 - x (b - 1) / b) to the base b; J is
    searched on a grid of 0.01.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    grid = np.arange(0, 1.0001, 0.01)[:, None]
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (STEP - 1) / STEP) / math.log(STEP)
    p, q = chance(u - v * grid), chance(v - u * grid)
    tiny = 1e-12
    like = more * np.log(p + tiny) + less * np.log(q + tiny) + same * np.log(np.clip(1 - p - q, tiny, None))
    like[(grid > np.minimum(u / v, v / u) + 0.01)] = -np.inf
    return grid[np.argmax(like, axis=0), 0]


def set_names(sets: list[np.ndarray]) -> tuple[list[int], list[int], list[int]]:
    """How many items each set has, and two sums of hashes of them: together they tell sets apart."""
    sums = lambda x: int(x.sum(dtype=np.uint64).view(np.int64)) if len(x) else 0
    return [len(x) for x in sets], [sums(x) for x in sets], [sums(mixed(x ^ np.uint64(0xA5A5A5A5A5A5A5A5))) for x in sets]


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_hash, n, h1, h2, sketch) of each row of ``docs`` (doc_id, text_hash, text)."""

    def make():
        def work(batch):
            texts = [t.as_py() or "" for t in batch.column(2)]
            names, sketch = ([], [], []), []
            for a, b in groups_of(texts):
                sets = shingle_sets([t.encode().lower() for t in texts[a:b]], k)
                for column, x in zip(names, set_names(sets)):
                    column += x
                sketch += [registers(x).tobytes() for x in sets]
            return [batch.column(0), batch.column(1), *names, sketch]

        return work

    return map_rows(docs.select("doc_id", "text_hash", "text"), make, "doc_id long, text_hash long, n long, h1 long, h2 long, sketch binary")


def banded(classes: DataFrame) -> DataFrame:
    """(key, id) for every class and band."""

    def make():
        def work(batch):
            ids = np.asarray(batch.column(0))
            sketches = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(len(ids), REGISTERS)
            return [band_keys(sketches).ravel(), np.repeat(ids, BANDS)]

        return work

    return map_rows(classes.select("id", "sketch"), make, "key long, id long")


def likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a, b) with est, where the sketches' estimate is ``least`` or more."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def make():
        def work(batch):
            read = lambda k: np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u2").reshape(batch.num_rows, REGISTERS)
            na, nb = (np.asarray(batch.column(k)).astype(float) for k in (2, 3))
            est = estimates(read(4), read(5), na, nb)
            keep = est >= least
            return [np.asarray(batch.column(0))[keep], np.asarray(batch.column(1))[keep], est[keep]]

        return work

    return map_rows(rows, make, "a long, b long, est double")


def needed(slots: DataFrame, bits: int) -> np.ndarray:
    """A map of ``bits`` bits of the slots in a table (slot)."""
    words = slots.groupBy((F.col("slot") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))).alias("bits"))
    out = np.zeros(bits // 64, dtype=np.uint64)
    for w, x in words.collect():  # one row for 64 bits of the map at most
        out[w] = np.uint64(x & 0xFFFFFFFFFFFFFFFF)
    return out


def sets_of(docs: DataFrame, k: int, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, items): the packed sorted shingle hashes of the ``classes`` in ``ids``, from the texts that stand for them."""
    wanted_ = saved(classes.drop("sketch").join(ids.distinct(), "id", "left_semi"), "wanted", classes.count())
    size = min(MOST_BITS, max(1 << 12, 1 << (16 * wanted_.count()).bit_length()))
    slot = lambda d: F.pmod(F.xxhash64(d, "text_hash"), F.lit(size)).alias("slot")
    sent = docs.sparkSession.sparkContext.broadcast(needed(wanted_.select(slot("doc")), size))

    def make():
        bits = sent.value

        def work(batch):
            slots = np.asarray(batch.column(1))
            wanted = np.flatnonzero(bits[slots // 64] >> (slots % 64).astype(np.uint64) & np.uint64(1)).tolist()
            if not wanted:
                return None
            texts = [batch.column(0)[i].as_py() or "" for i in wanted]
            sets = [s for a, b in groups_of(texts) for s in shingle_sets([t.encode().lower() for t in texts[a:b]], k)]
            return [*set_names(sets), [s.tobytes() for s in sets]]

        return work

    rows = map_rows(docs.select("text", slot("doc_id")), make, "n long, h1 long, h2 long, items binary")
    return saved(rows.join(wanted_.select("n", "h1", "h2", "id"), ["n", "h1", "h2"]).select("id", "items"), "sets").dropDuplicates(["id"])


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) with linked (100 * intersection >= ``percent`` * union of the full sets), lacks (how much of a's set
    b lacks), adds (how much b has besides), size (of a's set), lacked and added (the same, packed)."""
    rows = pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    rows = rows.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").select("a", "b", "x", "y")

    def make():
        def work(batch):
            linked, lacks, adds, size, lacked, added = [], [], [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                less, more = np.setdiff1d(p, q, assume_unique=True), np.setdiff1d(q, p, assume_unique=True)
                both = len(p) - len(less)
                linked.append(100 * both >= percent * (len(q) + len(less)))
                lacks.append(len(less))
                adds.append(len(more))
                size.append(len(p))
                lacked.append(less.tobytes())
                added.append(more.tobytes())
            return [batch.column(0), batch.column(1), linked, lacks, adds, size, lacked, added]

        return work

    return map_rows(rows, make, "a long, b long, linked boolean, lacks long, adds long, size long, lacked binary, added binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of ``pairs``."""
    return compared(pairs, sets, percent).filter("linked").select("a", "b")


def around_homes(homed: DataFrame, component: DataFrame, percent: int, most: int) -> DataFrame:
    """The links (a, b) between classes with the same home (``homed`` is ``compared`` pairs of a home and a class) in different
    components. ``most``: of how many classes at most."""
    named = homed.join(component.withColumnRenamed("node", "b"), "b", "left").withColumn("c", F.coalesce("component", "b"))
    apart = named.filter("not linked").select(F.col("a").alias("home")).distinct()
    own = ["home", "id", "c", "linked", "lacks", "adds", "size", "lacked", "added"]
    named = saved(named.withColumnRenamed("a", "home").withColumnRenamed("b", "id").join(apart, "home", "left_semi").select(*own), "homed", most, WIDE_ROWS)
    due = f"({percent} * adds + 100 * lacks - {100 - percent} * size)"  # above 0 where a class is not linked to its home

    # pairs that what both may lack is enough for, by kinds of classes
    kinds = named.groupBy("home", "linked", "lacks", "adds", "size").agg(F.count("*").alias("rows")).select("home", "linked", "lacks", "adds", "size", F.expr(due).alias("due"))
    kind = lambda x: kinds.select("home", *[F.col(c).alias(f"{c}{x}") for c in ("linked", "lacks", "adds", "size", "due")])
    enough = kind("a").filter("not linkeda").join(kind("b"), "home").filter(f"{100 + percent} * least(lacksa, lacksb) >= duea + dueb + {100 - percent} * sizea")
    member = lambda x: named.select("home", F.col("id").alias(x), F.col("c").alias(f"c{x}"), *[F.col(c).alias(f"{c}{x}") for c in ("linked", "lacks", "adds")])
    on = lambda x: ["home", f"linked{x}", f"lacks{x}", f"adds{x}"]
    lacking = enough.join(member("a"), on("a")).join(member("b"), on("b")).filter("ca <> cb").select("home", "a", "b")

    # pairs that share what they add
    def make():
        def work(batch):
            parts = [np.frombuffer(x.as_py(), dtype=np.int64) for x in batch.column(4)]
            times = [len(p) for p in parts]
            return [np.repeat(np.asarray(batch.column(k)), times) for k in range(4)] + [np.concatenate(parts)] if sum(times) else None

        return work

    items = map_rows(named.select("home", "id", "c", F.col("linked").cast("int"), "added"), make, "home long, id long, c long, linked int, item long")
    often = items.groupBy("home", "item").agg(F.count("*").alias("times"), F.sum(1 - F.col("linked")).alias("open")).filter("times > 1 and open > 0").select("home", "item", "times")
    shared = items.join(often, ["home", "item"])
    by = shared.filter("linked = 0").groupBy("home", "id", "c").agg(F.sort_array(F.collect_list(F.struct("times", "item"))).alias("by"))
    least = named.groupBy("home").agg(F.min(F.col("adds") - F.col("lacks")).alias("least"))
    m = F.expr(f"greatest(1, ceil(({due} + {percent} * least) / {100 + percent}))")
    room = named.join(least, "home").select("home", "id", "adds", (F.col("adds") - m + 1).cast("int").alias("room"))
    first = F.slice("by", F.lit(1), F.greatest(F.lit(0), F.col("room") - (F.col("adds").cast("int") - F.size("by"))))  # what it alone adds stands before
    left = by.join(room, ["home", "id"]).select("home", F.col("id").alias("a"), F.col("c").alias("ca"), F.explode(first).alias("x")).select("home", "a", "ca", F.col("x.item").alias("item"))
    right = shared.select("home", "item", F.col("id").alias("b"), F.col("c").alias("cb"))
    sharing = left.join(right, ["home", "item"]).filter("ca <> cb").select("home", "a", "b")

    pairs = lacking.union(sharing).select("home", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda x: named.select("home", F.col("id").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("lacks", "adds", "lacked", "added", "size")])
    rows = pairs.join(side("a"), ["home", "a"]).join(side("b"), ["home", "b"]).select("a", "b", "sizea", *[f"{c}{x}" for x in "ab" for c in ("lacks", "adds", "lacked", "added")])

    def decide():
        read = lambda x: np.frombuffer(x, dtype=np.int64)

        def work(batch):
            keep = []
            for k, (size, ra, aa, la, ma, rb, ab, lb, mb) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]))):
                both = size - ra - rb + len(np.intersect1d(read(la), read(lb), assume_unique=True)) + len(np.intersect1d(read(ma), read(mb), assume_unique=True))
                if 100 * both >= percent * (2 * size - ra - rb + aa + ab - both):
                    keep.append(k)
            return [batch.column(0).take(keep), batch.column(1).take(keep)] if keep else None

        return work

    return map_rows(rows, decide, "a long, b long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row: documents are linked if their sets of
    ``shingle``-word shingles (ASCII lower case; with fewer words the whole sequence) have 100 * intersection >=
    ``percent`` * union; component_id is the smallest id reachable over links, kept where it is the row's own.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing. A text of any length is worked
    on whole. Ids are whole numbers; rows of one id with different texts are linked each by its own. A row with a null id is linked like
    any other, but its component_id is the smallest id of its component, or null where there is none; there, the rows of one of
    the sets are kept. text_hash tells rows of one id apart. An empty table gives an empty one; other columns
    of the input do not come back, whatever their names.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    rows = saved(sketched(docs, shingle), "sketches")
    # one row stands for a class: the smallest id's, null ones last
    stands = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash", "sketch")).alias("s")
    classes = rows.filter("n > 0").groupBy("h1", "h2", "n").agg(stands).select("h1", "h2", "n", F.col("s.doc_id").alias("doc"), F.col("s.text_hash").alias("text_hash"), F.col("s.sketch").alias("sketch"))
    classes = saved(classes.withColumn("id", F.monotonically_increasing_id()), "classes", rows.count(), WIDE_ROWS)
    most = classes.count()
    sketches = classes.select("id", "n", "sketch")

    bands = banded(sketches)
    company = bands.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1")
    buckets = saved(bands.join(company, "key"), "buckets", BANDS * most)
    known = buckets.groupBy("id").agg(F.sum("rows").alias("known"))
    centres = buckets.join(known, "id").groupBy("key").agg(F.max(F.struct("known", (-F.col("id")).alias("m"))).alias("top")).select("key", (-F.col("top.m")).alias("centre"), "top.known")
    sizes = f"least(na, nb) * 100 >= greatest(na, nb) * {percent}"
    least = percent / 100 - MARGIN

    # first pass: each class against its home and the nearest centre
    stars = buckets.join(centres, "key").filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    hopeful = likely(stars, sketches, SAME_GROUP).join(known.select(F.col("id").alias("a"), "known"), "a")
    home, near = F.struct("known", "est", (-F.col("a")).alias("m")), F.struct("est", "known", (-F.col("a")).alias("m"))
    best = saved(hopeful.groupBy("b").agg(F.max(home).alias("h"), F.max(near).alias("n")).select("b", (-F.col("h.m")).alias("home"), (-F.col("n.m")).alias("near"), "n.est"), "homes", most)
    first = best.select(F.col("home").alias("a"), "b").union(best.filter(f"near <> home and est >= {least}").select(F.col("near").alias("a"), "b"))
    sets = sets_of(docs, shingle, classes, first.select(F.col("a").alias("id")).union(first.select("b")))
    tried = saved(compared(first, sets, percent), "tried", 2 * most, WIDE_ROWS)
    links = tried.filter("linked").select("a", "b")
    found = components(links)

    # second pass: what is not yet in one component, around the same home or in the same bucket
    homed = tried.join(best.select(F.col("home").alias("a"), "b"), ["a", "b"], "left_semi")
    links = saved(links.union(around_homes(homed, found, percent, most)), "around")
    found = components(links)
    named = buckets.select("key", "id").join(found, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    named = saved(named.join(best.select(F.col("b").alias("id"), "home"), "id", "left").join(sketches.select("id", "n"), "id"), "named", BANDS * most)
    parts = named.groupBy("key", "c").agg(F.count("*").alias("rows")).groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("rows", "c")).alias("top"))
    open_ = parts.filter("parts > 1").select("key", F.col("top.c").alias("top"))
    members = named.join(open_, "key")
    members = members.join(members.groupBy("id").agg(F.collect_set("key").alias("keys")), "id")
    side = lambda x: [F.col(c).alias(f"{c}{x}") for c in ("c", "home", "n", "keys")]
    few = members.filter("c <> top").select("key", F.col("id").alias("a"), *side("a"))
    all_ = members.select("key", F.col("id").alias("b"), *side("b"), (F.col("c") == F.col("top")).alias("main"))
    apart = "coalesce(homea <> homeb, true) and coalesce(homea <> b, true) and coalesce(homeb <> a, true)"
    once = "array_min(array_intersect(keysa, keysb)) = key"  # a pair comes from one of the buckets it shares
    crossing = few.join(all_, "key").filter(f"ca <> cb and (main or a < b) and {apart} and {sizes} and {once}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = saved(likely(crossing, sketches, least), "rest")
    if not rest.isEmpty():
        second = confirmed(rest, sets_of(docs, shingle, classes, rest.select(F.col("a").alias("id")).union(rest.select("b"))), percent)
        found = components(links.union(saved(second, "confirmed")))

    ends = classes.join(found, classes["id"] == found["node"], "left").select("h1", "h2", "n", "id", "doc", F.coalesce("component", "id").alias("c"))
    firsts = ends.groupBy("c").agg(F.min("doc").alias("component_id"), F.min("id").alias("least"))
    ends = ends.join(firsts, "c").select("h1", "h2", "n", "component_id", (F.col("id") == F.col("least")).alias("head"))
    alone = F.col("n_shingles") == 0
    out = rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "h1", "h2").join(ends.withColumnRenamed("n", "n_shingles"), ["h1", "h2", "n_shingles"], "left")
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
    kept = F.when(alone, True).when(F.col("component_id").isNull(), F.col("head")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash")


def op7_near_dedup(spark, sf_dir):
    """Near-duplicate components of all documents on two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2).drop("text_hash")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT s.doc_id, s.k, n.n FROM s JOIN n USING (doc_id)),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS b FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m.b, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
