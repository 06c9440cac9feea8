"""Name matching: exact, containment, fuzzy, keywords, agenda items (survey J3-J5, J11-J15, A3, A11, O5)."""

from __future__ import annotations

import itertools
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import token_set_ratio, token_set_score, weighted_ratio
from ..functions.text import company_key, null_to_blank
from .lineage import settled

#: Signs of a name's beginning by which longer names that begin with it are found.
PREFIX = 8
#: Keywords that are held against all names at once.
KEYWORDS = 20_000
#: Names of a group that are held against as many others at once.
BLOCK = 128
_PLACE = {c: i for i, c in enumerate(string.ascii_lowercase + string.digits)}


def exact(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Equal, non-blank keys; every match stays."""
    return left.filter(F.col(left_key) != "").join(right.filter(F.col(right_key) != ""), F.col(left_key) == F.col(right_key))


def _grams(key: Column, n: int) -> Column:
    """Distinct n-sign substrings of a key."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) - n + 1), lambda i: F.substring(key, i, F.lit(n))))


def containment(left: DataFrame, right: DataFrame, left_key: str, right_key: str, gram: int = 3) -> DataFrame:
    """Pairs in which either key holds the other.

    The shorter key's first `gram` signs stand in the longer one, so an equi-join on them finds every
    pair without holding each key against each; keys shorter than that are few and joined by all their length.
    """
    out = None
    for a, b, a_key, b_key in ((left, right, left_key, right_key), (right, left, right_key, left_key)):
        # a's key inside b's
        for n in range(1, gram + 1):
            head = a.filter(F.length(a_key) == n if n < gram else F.length(a_key) >= gram).withColumn("_g", F.substring(a_key, 1, n))
            parts = b.filter(F.length(b_key) >= n).withColumn("_g", F.explode(_grams(F.col(b_key), n)))
            found = head.join(parts, "_g").filter(F.col(b_key).contains(F.col(a_key))).drop("_g")
            if a is right:
                found = found.filter(F.col(a_key) != F.col(b_key))
            found = found.select(*left.columns, *right.columns)
            out = found if out is None else out.unionByName(found)
    return out


def common_run(threshold: int, longest: int = 400) -> int:
    """The length of a common substring that two strings have at least if their ratio reaches the threshold.

    Strings of S signs together at distance d have (S - d) / 2 signs in common, in d + 1 pieces at most.
    """
    least = longest
    for s in range(2, longest):
        for d in range(s % 2, int(s * (100 - threshold) / 100 + 1e-9) + 1, 2):
            least = min(least, -(-((s - d) // 2) // (d + 1)))
    return max(1, least)


def close_candidates(left: DataFrame, right: DataFrame, left_key: str, right_key: str, threshold: int, within: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of distinct keys whose token-set score may reach the threshold, by equi-joins, with equal `within` columns.

    Keys that share a token meet by it.  Keys without a common token are compared as sorted tokens alone: they meet
    by a run of signs that they must have in common, and their lengths are close.
    """
    q = common_run(threshold)
    words = lambda k: F.array_distinct(F.filter(F.split(F.col(k), r"(?U)\s+"), lambda w: w != ""))
    plain = lambda k: F.array_join(F.array_sort(words(k)), " ")
    runs = lambda c: F.when(F.length(c) >= q, _grams(c, q)).otherwise(F.array().cast("array<string>"))
    by_word = left.select(*within, left_key, F.explode(words(left_key)).alias("_w")).join(right.select(*within, right_key, F.explode(words(right_key)).alias("_w")), [*within, "_w"])
    a = left.select(*within, left_key, plain(left_key).alias("_a")).select(*within, left_key, F.length("_a").alias("_m"), F.explode(runs(F.col("_a"))).alias("_g"))
    b = right.select(*within, right_key, plain(right_key).alias("_b")).select(*within, right_key, F.length("_b").alias("_n"), F.explode(runs(F.col("_b"))).alias("_g"))
    near = F.abs(F.col("_m") - F.col("_n")) * 100 <= (F.col("_m") + F.col("_n")) * (100 - threshold)
    by_run = a.join(b, [*within, "_g"]).filter(near)
    return by_word.select(*within, left_key, right_key).unionByName(by_run.select(*within, left_key, right_key)).distinct()


def best_fuzzy(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: str, threshold: int = 90) -> DataFrame:
    """For each left key the right key with the highest token-set score, the first in `order` on a tie, if it reaches the threshold."""
    names = left.select(left_key).filter(F.col(left_key) != "").distinct()
    stated = right.filter(F.col(right_key) != "").groupBy(right_key).agg(F.min(order).alias("_o"))
    scored = close_candidates(names, stated, left_key, right_key, threshold).withColumn("_s", token_set_score(F.col(left_key), F.col(right_key)))
    met = scored.filter(F.col("_s") >= threshold).join(stated, right_key)
    best = met.groupBy(left_key).agg(F.max_by(F.struct(right_key, "_s"), F.struct("_s", (-F.col("_o")).alias("o"))).alias("_b"))
    return left.join(best.select(left_key, F.col(f"_b.{right_key}").alias(right_key), F.col("_b._s").alias("score")), left_key)


def cascade(left: DataFrame, right: DataFrame, left_id: str, left_key: str, right_key: str, order: str, threshold: int = 90) -> DataFrame:
    """J3-J5 in stages: what a stage matches leaves the next. Columns: left_id, match_type, score, right_key."""
    hit = exact(left, right, left_key, right_key).select(left_id, F.lit("exact").alias("match_type"), F.lit(100).alias("score"), right_key, order)
    rest = left.join(hit.select(left_id).distinct(), left_id, "left_anti")
    part = containment(rest, right, left_key, right_key).select(left_id, F.lit("partial").alias("match_type"), F.lit(None).cast("int").alias("score"), right_key, order)
    rest = rest.join(part.select(left_id).distinct(), left_id, "left_anti")
    orders = right.groupBy(right_key).agg(F.min(order).alias(order))
    near = best_fuzzy(rest, right, left_key, right_key, order, threshold).join(orders, right_key).select(left_id, F.lit("fuzzy").alias("match_type"), "score", right_key, order)
    return hit.unionByName(part).unionByName(near)


def compared(people: DataFrame, companies: DataFrame, threshold: int = 90) -> DataFrame:
    """The whole comparison: a row for each person's entity, with its matches joined in company order.

    people: row_id, entity, name, email, position; companies: ord, company, source_url, source_path, snippet.
    """
    left = people.withColumn("person_key", company_key("entity"))
    right = companies.withColumn("company_key", company_key("company")).filter("company_key <> ''")
    matched = cascade(left.select("row_id", "person_key"), right.select("company_key", "ord"), "row_id", "person_key", "company_key", "ord", threshold)
    full = matched.filter("match_type <> 'fuzzy'").join(right, ["company_key", "ord"]).unionByName(matched.filter("match_type = 'fuzzy'").drop("ord").join(right, "company_key"))

    def listed(c: str, sep: str) -> Column:
        some = F.transform(F.array_sort(F.collect_list(F.when(F.trim(null_to_blank(c)) != "", F.struct("ord", F.col(c))))), lambda x: x[c])
        return F.array_join(F.array_distinct(some), sep)

    summed = full.groupBy("row_id").agg(
        F.min("match_type").alias("match_type"), F.max("score").alias("match_score"),
        listed("company", "; ").alias("matched_companies"), listed("source_url", "; ").alias("matched_source_urls"),
        listed("source_path", "  ||  ").alias("matched_source_paths"), listed("snippet", "  ||  ").alias("matched_snippets"),
    )
    return left.join(summed, "row_id", "left").withColumn("match_type", F.coalesce("match_type", F.lit("unmatched")))


def ranked(compared_rows: DataFrame) -> DataFrame:
    """Matched rows, exact before fuzzy before partial, then score and name."""
    rank = F.when(F.col("match_type") == "exact", 0).when(F.col("match_type") == "fuzzy", 1).otherwise(2)
    return compared_rows.filter("match_type <> 'unmatched'").orderBy(rank, F.desc(F.coalesce("match_score", F.lit(0))), F.lower("entity"), "row_id")


def counts(compared_rows: DataFrame) -> DataFrame:
    """A3"""
    kinds = ("exact", "partial", "fuzzy", "unmatched")
    return compared_rows.agg(F.count("*").alias("total"), *(F.count_if(F.col("match_type") == k).alias(k) for k in kinds))


def keyword_interests(companies: DataFrame, interests: DataFrame, name: str = "company") -> DataFrame:
    """Interests one of whose keywords stands in the name, in order of the dictionary, with the first such keyword.

    interests: interest, interest_ord, keyword, keyword_ord.
    """
    words = interests.select("interest", "interest_ord", "keyword_ord", "keyword", F.lower(F.trim("keyword")).alias("_k")).filter("_k <> ''")
    names = companies.select(name, F.lower(F.trim(null_to_blank(name))).alias("_n")).filter("_n <> ''").distinct()
    found = containment_one_way(words, names, "_k", "_n")
    one = found.groupBy(name, "interest").agg(F.min("interest_ord").alias("o"), F.min_by("keyword", "keyword_ord").alias("k"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "interest", "k"))), lambda x: x[c]), "; ")
    return one.groupBy(name).agg(listed("interest").alias("interests"), F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("o", "interest", "k"))), lambda x: x["k"])), "; ").alias("keywords"))


def containment_one_way(inner: DataFrame, outer: DataFrame, inner_key: str, outer_key: str, gram: int = 3) -> DataFrame:
    """Pairs in which the outer key holds the inner one, by an equi-join on the inner key's first signs."""
    out = None
    for n in range(1, gram + 1):
        head = inner.filter(F.length(inner_key) == n if n < gram else F.length(inner_key) >= gram).withColumn("_g", F.substring(inner_key, 1, n))
        parts = outer.filter(F.length(outer_key) >= n).withColumn("_g", F.explode(_grams(F.col(outer_key), n)))
        found = head.join(parts, "_g").filter(F.col(outer_key).contains(F.col(inner_key))).drop("_g")
        out = found if out is None else out.unionByName(found)
    return out


def keyword_match(companies: DataFrame, interests: DataFrame, threshold: int = 90, name: str = "company") -> DataFrame:
    """J12, then J13 for the rest: the best keyword by weighted ratio, its interests only from the threshold on."""
    hit = keyword_interests(companies, interests, name).withColumn("score", F.lit(100))
    rest = companies.select(name).filter(F.length(F.trim(null_to_blank(name))) > 0).distinct().join(hit.select(name), name, "left_anti")
    words = interests.select(F.lower(F.trim("keyword")).alias("_k")).filter("_k <> ''").distinct()
    best = best_keywords(rest, name, words)
    of = interests.select(F.lower(F.trim("keyword")).alias("keywords"), "interest", "interest_ord").groupBy("keywords", "interest").agg(F.min("interest_ord").alias("o"))
    joined = of.groupBy("keywords").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "interest"))), lambda x: x["interest"]), "; ").alias("_i"))
    near = best.join(joined, "keywords", "left").select(name, F.when(F.col("score") >= threshold, F.col("_i")).otherwise("").alias("interests"), "keywords", "score")
    return hit.unionByName(near)


def best_keywords(names: DataFrame, name: str, words: DataFrame) -> DataFrame:
    """The keyword (column _k) with the highest weighted ratio for each name, the first in order on a tie, whatever the score.

    The dictionary is the stated set: it is held against all names in blocks of KEYWORDS, one block sent along at a time.
    """
    spark, found = names.sparkSession, None
    listed = (r["_k"] for r in words.orderBy("_k").toLocalIterator())
    while block := list(itertools.islice(listed, KEYWORDS)):
        sent = spark.sparkContext.broadcast(block)

        def run(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for written in frame[name]:
                    plain = written.strip(" ").lower()
                    score, place = max((int(weighted_ratio(plain, k)), -i) for i, k in enumerate(sent.value))
                    rows.append((written, score, sent.value[-place]))
                yield pd.DataFrame(rows, columns=[name, "score", "keywords"])

        part = names.select(name).mapInPandas(run, f"`{name}` string, score int, keywords string")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return names.select(name, F.lit(0).alias("score"), F.lit(None).cast("string").alias("keywords"))
    return found.groupBy(name).agg(F.max("score").alias("score"), F.min_by("keywords", F.struct(-F.col("score"), F.col("keywords"))).alias("keywords"))


def agenda_conflicts(officials: DataFrame, items: DataFrame) -> DataFrame:
    """A company of an official's interests stands, case and all, in an agenda item's description.

    officials: name, interests array<struct<company_name, interest_type>>; items: title, description, meeting_date.
    """
    held = officials.select("name", F.explode("interests").alias("i")).select("name", F.col("i.company_name").alias("company_name"), F.col("i.interest_type").alias("interest_type")).filter("company_name <> ''")
    return containment_one_way(held, items.filter("description is not null"), "company_name", "description")


def _signs(names: list[str]) -> np.ndarray:
    """How often each letter and digit stands in the distinct tokens of each name; other signs share a column."""
    out = np.zeros((len(names), len(_PLACE) + 1), np.int16)
    for row, name in zip(out, names, strict=True):
        for sign, n in Counter("".join(set(name.split()))).items():
            row[_PLACE.get(sign, -1)] += n
    return out


def near_longer(short: list[str], long: list[str], threshold: int) -> list[str]:
    """Those of `short` that one longer name of `long` is close to.

    Of two names one may be within the threshold's reach only if few signs of their distinct tokens stand apart.
    With T the threshold's share that may differ, and W a name's signs: tokens that the other side lacks weigh
    2T / (1 + T) of W at most where they alone decide, and 2T / (1 - T) where two remainders are compared.
    """
    close = lambda x, y: len(y) > len(x) and int(token_set_ratio(x, y)) >= threshold
    if len(short) * len(long) <= 64:
        return [x for x in short if any(close(x, y) for y in long)]
    t = (100 - threshold) / 100
    share = max(2 * t / (1 + t), 2 * t / max(1 - t, 1e-9))
    a, b = _signs(short), _signs(long)
    reach = lambda names: np.array([share * (len(" ".join(set(n.split()))) + 1) + 1e-6 for n in names])
    longer = np.array([len(n) for n in long])[None] > np.array([len(n) for n in short])[:, None]
    apart = np.zeros((2, len(short), len(long)), np.int32)
    for i in range(a.shape[1]):
        gap = a[:, i, None] - b[None, :, i]
        apart[0] += np.maximum(gap, 0)
        apart[1] += np.maximum(-gap, 0)
    may = longer & ((apart[0] <= reach(short)[:, None]) | (apart[1] <= reach(long)[None]))
    return [x for x, row in zip(short, may, strict=True) if any(close(x, long[j]) for j in np.flatnonzero(row))]


def less_complete(df: DataFrame, row: str, groups: list[str], name: str, threshold: int = 94) -> DataFrame:
    """Rows for which another of the same group (nulls equal) has a longer name that begins with this one or is close to it.

    Names that begin alike meet by an equi-join inside their group, the longer by one of its first PREFIX beginnings.
    What is left is held against the longer names of its group, BLOCK names a side at a time, in `near_longer`.
    """
    group = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"})
    keyed = df.select(row, group.alias("_q"), company_key(name).alias("_k")).filter("_k <> ''")
    each = settled(keyed.select("_q", "_k").distinct())
    head = F.least(F.length("_k"), F.lit(PREFIX))
    short = each.withColumn("_h", F.left("_k", head))
    sizes = F.transform(F.sequence(F.lit(1), head), lambda n: F.left("_k", n))
    other = each.select("_q", F.col("_k").alias("_o"), F.explode(sizes).alias("_h"))
    gone = short.join(other, ["_q", "_h"]).filter((F.length("_o") > F.length("_k")) & F.col("_o").startswith(F.col("_k"))).select("_q", "_k").distinct()
    if threshold <= 100:
        gone = settled(gone)
        blocks = lambda x: _blocks(x, each)
        left = blocks(each.join(gone, ["_q", "_k"], "left_anti")).withColumnsRenamed({"_b": "_s", "names": "short"})
        pairs = left.join(blocks(each).withColumnsRenamed({"_b": "_l", "names": "long"}), "_q")
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(batch.column(c) for c in ("_q", "short", "long")), strict=True)
                found = [(q.as_py(), x) for q, a, b in rows for x in near_longer(a.as_py(), b.as_py(), threshold)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["_q", "_k"])

        near = pairs.repartition(parts, "_q", "_s", "_l").select("_q", "short", "long").mapInArrow(run, "_q string, _k string")
        gone = gone.unionByName(near.distinct())
    return keyed.join(gone, ["_q", "_k"], "left_semi").select(row)


def _blocks(names: DataFrame, each: DataFrame) -> DataFrame:
    """The names of each group in lists of about BLOCK, dealt by hash: _q, _b, names."""
    sizes = each.groupBy("_q").agg(F.ceil(F.count("*") / BLOCK).alias("_n"))
    return names.join(sizes, "_q").withColumn("_b", F.pmod(F.xxhash64("_k"), F.col("_n"))).groupBy("_q", "_b").agg(F.collect_list("_k").alias("names"))
