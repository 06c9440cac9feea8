"""Near-duplicate join on word shingles with adaptive multi-match prefixes.

A document is the set of its SHINGLE-word shingles in lower case (with fewer
words, the whole sequence).  Two link when intersection / union >= NUM / DEN.
With the shingles of every set in one global order, rarest first, two linked
sets share at least m shingles of their m-prefixes, the first n - ceil(n * t) + m.
Each document chooses m by the candidates that its shingles' document counts
promise (a longer prefix meets more postings but asks for more common ones);
a pair is verified only if the shared prefix reaches the larger m of the two.

Exact document counts come from one exchange of summed-up keys between blocks.
Equal sets form one class first, and only its smallest identifier takes part.
Families of near copies are joined without listing their pairs: first each
document is held against one leader of its prefix postings, then only pairs
that are still in different components are candidates, so no link between
components is lost.  Sets are compared in full, as 64-bit names of shingles.

Null text, or text without words, is empty and linked with nothing.  A null
doc_id takes part as the largest number and is returned as null.  Rows that repeat a doc_id take
part as one: the larger set stands for them, and each row has its own n_shingles.
An empty table gives an empty table.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrowtext as at
from . import blocks as bl
from .components import components
from .shared import drop, written

SHINGLE, NUM, DEN = 5, 80, 100
#: Largest number of shared prefix shingles that may be asked for, and what checking a candidate costs against meeting a posting.
MOST_MATCHES, CHECK_COST = 4, 20
#: Rounds of leaders, and candidate pairs for each posting up to which pairs are listed without another.
LEADER_ROUNDS, PAIRS_PER_POSTING = 3, 4
#: Leaders that a document is held against in a round.
LEADERS = 4
#: Shingles for each shuffle partition, at most, whose rows are not dealt by the shingle.
HOT = 4
#: Rows that any shingle may have without being hot.
FEW = 64
_U = np.uint64
#: Shingles with the documents that hold each; whole sets with their smallest document and their rows.
SHINGLES, SETS = 0, 1
KINDS = {SHINGLES: bl.Kind(shift=24, reduce=("sum",)), SETS: bl.Kind(more=True, reduce=("min", "sum"))}
_POST = pa.schema([("doc", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("asks", pa.int32()), ("shingles", pa.binary()), ("prefix", pa.list_(pa.int64())), ("place", pa.list_(pa.int32()))])


class Sets:
    """The shingle sets of a block's documents: distinct names, sorted inside each document."""

    def __init__(self, table: pa.Table):
        table = bl.in_order(table.select(["doc_id", "text"]))
        self.ids = bl.doc_ids(table.column("doc_id"))
        parts = []
        for row, _, raw, offsets in at.pieces(table.column("text")):
            low = at.LOWER[raw]
            start, end, first = at.words(low, offsets)
            names = at.word_names(low, start, end)
            where, shingle = at.windows(names, first, SHINGLE)
            size = np.diff(first)
            short = np.flatnonzero((size > 0) & (size < SHINGLE))
            whole = at.HASH_A.slices(at.HASH_A.prefix(names), first[short], first[short] + size[short])
            doc = np.concatenate([at.owners(first)[where], short]) + row
            name = np.concatenate([shingle, whole])
            order = np.lexsort((name, doc))
            doc, name = doc[order], name[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])
            parts.append((doc[new], name[new]))
        empty = (np.zeros(0, np.int64), np.zeros(0, _U))
        self.doc, self.name = (np.concatenate(c) for c in zip(empty, *parts, strict=True))
        self.first = np.searchsorted(self.doc, np.arange(len(self.ids) + 1))
        self.size = np.diff(self.first)

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each whole set."""
        sums = []
        for salt in (1, 2):
            run = np.append(_U(0), np.cumsum(at.fmix(self.name + _U(salt << 60))))
            sums.append(at.fmix(run[self.first[1:]] - run[self.first[:-1]] + self.size.astype(_U)))
        return sums[0], sums[1]

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct 40-bit keys in order, documents that hold each, and the key number of each shingle."""
        short = self.name & ~_U((1 << 24) - 1)
        order = np.argsort(short, kind="stable")
        begin = bl.firsts(short[order])
        size = np.diff(np.append(begin, len(order)))
        number = np.empty(len(order), np.int64)
        number[order] = np.repeat(np.arange(len(begin)), size)
        return short[order][begin], size, number

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct signatures in order, the smallest id of each, the number of each document's (-1: empty), and rows of each."""
        one, two = self.signatures()
        some = np.flatnonzero(self.size)
        order = some[np.lexsort((self.ids[some], two[some], one[some]))]
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        number = np.full(len(self.ids), -1)
        number[order] = np.cumsum(new) - 1
        head = order[new]
        rows = np.diff(np.append(np.flatnonzero(new), len(order)))
        return one[head], two[head], self.ids[head], number, rows


def least_shared(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n shares with any set that it links to, at least."""
    return -(-n * NUM // DEN)


def _ask(p: bl.Plan):
    def ask(key: tuple, table: pa.Table) -> pa.Table:
        s, block = Sets(table), key[0].as_py()
        keys, docs, _ = s.keys()
        one, two, least, _, n_rows = s.classes()
        return bl.table(bl.ask(KINDS, SHINGLES, block, p.first, keys, None, [docs]) + bl.ask(KINDS, SETS, block, p.first, one, two, [least, n_rows]), bl.ASK)

    return ask


def tell_counts(piece: bl.Piece, docs: list[np.ndarray]) -> tuple:
    """How many documents hold each key that more than one holds."""
    shared = docs[0] > 1
    return len(piece.keys), np.packbits(shared).tobytes(), b"", [bl.plain(docs[0][shared])]


def choose(others: np.ndarray, base: int) -> int:
    """Shared prefix shingles to ask for, by the other documents that hold each shingle in prefix order; 0: no set can link.

    base is the length of the 1-prefix.  A prefix for m meets sum(others) postings and leaves at most an m-th of them as candidates.
    """
    met = np.cumsum(others)
    held = np.cumsum(others > 0)
    best, cost = 1, np.inf
    for m in range(1, min(MOST_MATCHES, len(others) - base + 1) + 1):
        last = base + m - 2
        if held[last] < m:
            return 0
        c = met[last] * (1 + CHECK_COST / m)
        if c < cost:
            best, cost = m, c
    return best


def _post(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
    s = Sets(table)
    told = told.sort_by("rng").to_pylist()
    count = np.ones(len(s.keys()[0]), np.int64) if not told else None
    shares, reps, class_rows = [], [], []
    for r in told:
        if r["kind"] == SETS:
            reps.append(bl.unplain(r["vals"][0], r["n"]))
            class_rows.append(bl.unplain(r["vals"][1], r["n"]))
        else:
            bits = np.unpackbits(np.frombuffer(r["keys"], np.uint8), count=r["n"]).astype(bool)
            part = np.ones(r["n"], np.int64)
            part[bits] = bl.unplain(r["vals"][0], int(bits.sum()))
            shares.append(part)
    if count is None:
        count = np.concatenate([np.zeros(0, np.int64), *shares])
    _, _, number = s.keys()
    held = count[number] if len(number) else number
    _, _, _, set_number, _ = s.classes()
    rep_of = np.concatenate([np.zeros(0, _U), *reps]).view(np.int64)
    rep = np.where(set_number >= 0, rep_of[np.maximum(set_number, 0)], s.ids) if len(rep_of) else s.ids
    # documents that hold a shingle, without those of the same class
    own = np.concatenate([np.zeros(0, _U), *class_rows]).astype(np.int64)
    others = held - own[set_number[s.doc]] if len(own) else held - 1
    shared = np.bincount(s.doc, others > 0, len(s.ids)).astype(np.int64)
    need = least_shared(s.size)
    # all but the first row of a class rest, and so do sets of which too few shingles stand anywhere else
    leads = (rep == s.ids) & (s.size > 0) & (shared >= need)
    # of rows that repeat an identifier the largest set stands for all
    by_id = np.lexsort((np.arange(len(s.ids)), -s.size, s.ids))
    again = np.zeros(len(s.ids), bool)
    again[by_id[1:]] = s.ids[by_id[1:]] == s.ids[by_id[:-1]]
    leads &= ~again
    asks, prefix, place, blob = [0] * len(s.ids), [None] * len(s.ids), [None] * len(s.ids), [None] * len(s.ids)
    for d in np.flatnonzero(leads).tolist():
        a, b = s.first[d], s.first[d + 1]
        order = np.lexsort((s.name[a:b], held[a:b]))
        base = int(s.size[d] - need[d] + 1)
        order = order[: base + MOST_MATCHES - 1]
        m = choose(others[a:b][order], base)
        if m:
            some = np.flatnonzero(others[a:b][order] > 0)
            asks[d], prefix[d], place[d] = m, s.name[a:b][order][some].view(np.int64), some
            blob[d] = s.name[a:b].tobytes()
    return pa.Table.from_arrays([pa.array(s.ids), pa.array(rep), pa.array(s.size), pa.array(shared), pa.array(asks, pa.int32()), pa.array(blob, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(place, pa.list_(pa.int32()))], schema=_POST)


def _shared_counts(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Common members of pairs of sorted sets."""
    n = len(a)
    sizes = [np.array([len(x) // 8 for x in side]) for side in (a, b)]
    own = [np.repeat(np.arange(n), s) for s in sizes]
    name = np.concatenate([np.frombuffer(b"".join(a), _U), np.frombuffer(b"".join(b), _U)])
    pair = np.concatenate(own)
    order = np.lexsort((name, pair))
    name, pair = name[order], pair[order]
    twice = (name[1:] == name[:-1]) & (pair[1:] == pair[:-1])
    return np.bincount(pair[1:][twice], minlength=n)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            both = _shared_counts(part.column("set_a").to_pylist(), part.column("set_b").to_pylist())
            union = part.column("n_a").to_numpy() + part.column("n_b").to_numpy() - both
            linked = np.flatnonzero(DEN * both >= NUM * union)
            yield part.select(["a", "b"]).take(pa.array(linked))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    side = lambda x: sets.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"set_{x}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "set_a", "set_b").mapInArrow(_check, "a long, b long")


def _hot(rows: DataFrame) -> DataFrame:
    """Shingles with more rows than a task should take alone: so many rows make at most HOT shingles for each shuffle partition."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(FEW, rows.count() // (HOT * partitions))
    return written(rows.groupBy("shingle").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > most))


def _joined(rows: DataFrame, few: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows with what `few` says of their shingle, a row for each; rows of hot shingles, which are few, stay where they are."""
    known = F.broadcast(hot.select("shingle"))
    cold = rows.join(known, "shingle", "left_anti").join(few, "shingle")
    return cold.unionByName(rows.join(F.broadcast(few.join(known, "shingle", "left_semi")), "shingle"))


def _labelled(postings: DataFrame, labels: DataFrame, hot: DataFrame) -> DataFrame:
    """Postings of shingles that still join several components, with their documents' components and the largest of each shingle."""
    rows = postings.join(labels.withColumnRenamed("id", "doc"), "doc", "left").withColumn("part", F.coalesce("label", "doc")).drop("label")
    sizes = rows.groupBy("shingle", "part").agg(F.count("*").alias("m"))
    most = sizes.groupBy("shingle").agg(F.max(F.struct("m", F.col("part"))).alias("top"), F.sum("m").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
    return _joined(rows, most.select("shingle", F.col("top.part").alias("main"), (F.col("all") - F.col("top.m")).alias("others"), "all"), hot)


def _voted(met: DataFrame, most: int) -> DataFrame:
    """(a, b) for each document and the leaders that it meets most often."""
    votes = met.groupBy("a", "b").agg(F.count("*").alias("votes"))
    best = Window.partitionBy("a").orderBy(F.desc("votes"), "b")
    some = votes.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= most)
    return some.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _leaders(rows: DataFrame, turn: int, hot: DataFrame) -> DataFrame:
    """For each document outside its shingles' largest component, some documents inside to be held against.

    Leaders are drawn anew in each turn, shingle by shingle, from the documents with few shingles of their own.
    """
    few = F.floor(F.col("shared") * 20 / F.col("n"))
    lead = rows.filter("part = main").groupBy("shingle").agg(F.max_by("doc", F.struct(few, F.xxhash64("doc", "shingle", F.lit(turn)))).alias("b"))
    return _voted(_joined(rows.filter("part <> main"), lead, hot).select(F.col("doc").alias("a"), "b"), LEADERS)


def _across(rows: DataFrame) -> DataFrame:
    """All pairs in different components that share enough of their prefixes.

    Sizes x and y ask for an intersection of at least least = NUM * (x + y) / (NUM + DEN).  Neither set may have fewer
    shingles in common with any other document, and `asks` shared shingles stand among the first size - least + asks of both.
    """
    outside = rows.filter("part <> main")
    x, y = outside.alias("x"), rows.alias("y")
    least = F.ceil((F.col("x.n") + F.col("y.n")) * NUM / (NUM + DEN) - 1e-9)
    asks = F.greatest("x.asks", "y.asks")
    within = (F.col("x.place") < F.col("x.n") - least + asks) & (F.col("y.place") < F.col("y.n") - least + asks)
    once = (F.col("y.part") == F.col("y.main")) | (F.col("x.doc") < F.col("y.doc"))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.part") != F.col("y.part")) & once & (least <= F.least("x.shared", "y.shared")) & within)
    counted = met.groupBy(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"), asks.alias("asks")).agg(F.count("*").alias("m"))
    return counted.filter("m >= asks").select("a", "b")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All documents (doc, rep, n, ...) and verified links between class representatives, enough to join every component."""
    p = bl.plan(bl.block_count(docs))
    by_block = bl.blocked(docs, p.blocks, together=True).groupBy("block")
    asks = by_block.applyInArrow(_ask(p), bl.ASK_DDL)
    told = bl.exchange(written(asks) if p.wide else asks, KINDS, p, {SHINGLES: tell_counts, SETS: bl.tell_all})
    ddl = ", ".join(f"{f.name} { {pa.int64(): 'long', pa.int32(): 'int', pa.binary(): 'binary', pa.list_(pa.int64()): 'array<long>', pa.list_(pa.int32()): 'array<int>'}[f.type]}" for f in _POST)
    posted = written(by_block.cogroup(told.groupBy("asker")).applyInArrow(_post, ddl))
    sets = posted.filter("shingles is not null")
    prefixes = sets.select("doc", "n", "shared", "asks", F.explode(F.arrays_zip("prefix", "place")).alias("p")).select("doc", "n", "shared", "asks", F.col("p.prefix").alias("shingle"), F.col("p.place").alias("place"))
    # only shingles that stand in two prefixes lead to candidates
    # the leader of a shingle is the document with the fewest shingles of its own, which most copies of a family are close to
    met = prefixes.groupBy("shingle").agg(F.max_by("doc", F.struct(F.col("shared") / F.col("n"), -F.col("doc"))).alias("lead"), F.count("*").alias("m")).filter("m > 1").drop("m")
    hot = _hot(prefixes)
    postings = written(_joined(prefixes, met, hot))
    found = written(verified(_voted(postings.filter("doc <> lead").select(F.col("doc").alias("a"), F.col("lead").alias("b")), LEADERS), sets))
    met_by, rows = postings, postings.drop("lead")
    for turn in range(1, LEADER_ROUNDS + 1):
        labels = components(found)
        postings = written(_labelled(rows, labels, hot))
        drop(met_by, labels)
        met_by, rows = postings, postings.select("doc", "n", "shared", "asks", "shingle", "place")
        size = postings.groupBy("shingle").agg(F.max(F.col("others") * F.col("all")).alias("pairs"), F.count("*").alias("n")).agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("n")).first()
        if not size["n"]:
            break
        last = turn == LEADER_ROUNDS or size["pairs"] <= PAIRS_PER_POSTING * size["n"]
        pairs = _across(postings) if last else _leaders(postings, turn, hot)
        more = written(found.unionByName(verified(pairs, sets)))
        drop(found)
        found = more
        if last:
            break
    drop(met_by, hot)
    return posted, found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document."""
    posted, found = links(docs)
    out = posted.select(F.col("doc"), "rep", "n")
    # rows that repeat a doc_id are one document
    twice = posted.groupBy("doc").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("rows")).filter("least <> most")
    own = twice.select(F.col("least").alias("a"), F.col("doc").alias("b")).unionByName(twice.select(F.col("doc").alias("a"), F.col("most").alias("b")))
    labels = components(found.unionByName(own))
    out = out.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left")
    part = F.coalesce("label", "rep")
    back = lambda c: F.when(c != int(bl.NULL_ID), c)
    return out.select(back(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), back(part).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each component: the row with its smallest identifier stays.

    Rows that repeat that identifier stay too.
    """
    part = near_duplicates(docs).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    gone = written(part.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone")))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]), "left_anti")
