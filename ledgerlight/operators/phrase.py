"""Phrase matches of entities in texts and their use (survey J1, J2, J6-J10, A7-A9, A12, F36, X6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hinted_value, last_name, null_to_blank, person_key, person_letters, search_key

# Confidence of a phrase that is the whole name, of several words, of one word.
WHOLE, SEVERAL, SINGLE = 0.92, 0.82, 0.72


def tokens(text: Column | str) -> Column:
    return F.filter(F.split(search_key(text), " "), lambda w: w != "")


#: Words of a phrase's beginning by which texts are looked through.
HEAD = 4
#: Phrases of so many bytes at most are sent to all texts; of more, texts' runs and phrases meet by a shuffle.
SENT_BYTES = 8 << 20


def occurrences(texts: DataFrame, text_id: str, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """J6 as an equi-join: (text_id, phrase) where the phrase's words stand next to each other in the text.

    A text's distinct runs of up to HEAD words meet the phrases that begin so; only those lengths are made that
    phrases begin with.  Longer phrases are then looked for in the few texts that hold their beginning.
    """
    keyed = phrases.select(search_key(phrase).alias("_p")).filter(F.length("_p") >= 3).distinct()
    begun = keyed.withColumn("_n", F.size(F.split("_p", " "))).withColumn("_h", F.substring_index("_p", " ", HEAD))
    # HEAD numbers at most, and the phrases' bytes: few enough, and they go to the texts
    told = begun.agg(F.sort_array(F.collect_set(F.least("_n", F.lit(HEAD)))).alias("lengths"), F.sum(F.octet_length("_p") + F.octet_length("_h")).alias("size")).first()
    lengths = told["lengths"]
    begun = F.broadcast(begun) if (told["size"] or 0) <= SENT_BYTES else begun
    words = texts.select(F.col(text_id), tokens(text).alias("_t"))

    def runs(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size("_t") - n), lambda i: F.concat_ws(" ", *(F.get("_t", i + k) for k in range(n))))
        return F.when(F.size("_t") >= n, each).otherwise(F.array().cast("array<string>"))

    if not lengths:
        return words.select(text_id, F.lit("").alias("phrase")).limit(0)
    met = words.select(text_id, F.explode(F.array_distinct(F.concat(*map(runs, lengths)))).alias("_h")).join(begun, "_h").select(text_id, "_p", "_n")
    short = met.filter(F.col("_n") <= HEAD).select(text_id, "_p")
    padded = texts.select(F.col(text_id), F.concat(F.lit(" "), search_key(text), F.lit(" ")).alias("_s"))
    long = met.filter(F.col("_n") > HEAD).join(padded, text_id).filter(F.col("_s").contains(F.concat(F.lit(" "), F.col("_p"), F.lit(" "))))
    return short.unionByName(long.select(text_id, "_p")).distinct().withColumnRenamed("_p", "phrase")


def confidence(alias: Column, name: Column) -> Column:
    return F.when(alias == name, WHOLE).when(alias.contains(" "), SEVERAL).otherwise(SINGLE)


def matter_text(*columns: str) -> Column:
    """fields joined by blanks, lower case."""
    return F.lower(F.concat_ws(" ", *(F.nullif(null_to_blank(c), F.lit("")) for c in columns)))


def owner_keys(first: str, middle: str, last: str, full: str) -> Column:
    """Letters-only keys under which an owner's own name may appear as an entity."""
    f, m, s = F.col(first), F.col(middle), F.col(last)
    forms = (F.col(full), F.concat_ws(" ", f, s), F.concat_ws(" ", f, m, s), F.concat_ws(" ", s, f), F.concat_ws(" ", s, f, m))
    return F.array_distinct(F.filter(F.array(*map(person_letters, forms)), lambda k: k != ""))


def entities(rows: DataFrame, order: str) -> DataFrame:
    """Each owner's entities, once each, without owners' own names; the first row wins."""
    value = rows.withColumn("raw_name", hinted_value([c for c in rows.columns if c != order])).withColumn("norm_name", search_key("raw_name"))
    own = owner_keys("owner_first_name", "owner_middle_name", "owner_last_name", "owner_full_name")
    kept = value.filter("norm_name <> ''").filter(~F.array_contains(own, person_letters("raw_name")))
    first = F.min_by(F.struct("raw_name", "record_type", "owner_full_name"), order)
    return kept.groupBy(person_key("owner_full_name").alias("owner_key"), "norm_name").agg(first.alias("e"), F.min(order).alias(order)).select("owner_key", "norm_name", "e.*", order)


def owner_groups(found: DataFrame) -> DataFrame:
    """Every entity under its owner's full and last name."""
    names = F.array_distinct(F.array(F.col("owner_key"), last_name("owner_key")))
    return found.withColumn("person_key", F.explode(names)).filter("person_key <> ''")


def vote_matches(votes: DataFrame, found: DataFrame, text_columns: tuple[str, ...] = ("matter_id", "matter_title", "result", "body"), least: float = 0.75) -> DataFrame:
    """A vote's politician owns, by full or last name, an entity that the vote's own text names.

    votes: row_id, politician_name and the text columns.
    """
    people = votes.select("row_id", F.explode(F.array_distinct(F.array(person_key("politician_name"), last_name(person_key("politician_name"))))).alias("person_key")).filter("person_key <> ''")
    owned = owner_groups(found).dropDuplicates(["person_key", "owner_key", "norm_name"])
    named = occurrences(votes.withColumn("_text", matter_text(*text_columns)), "row_id", "_text", found, "norm_name")
    pairs = people.join(owned, "person_key").join(named.withColumnRenamed("phrase", "norm_name"), ["row_id", "norm_name"])
    scored = pairs.withColumn("confidence", F.lit(WHOLE)).filter(F.col("confidence") >= least)
    return scored.dropDuplicates(["row_id", "owner_key", "norm_name"])


def enriched(votes: DataFrame, matches: DataFrame, keys: tuple[str, ...] = ("matter_id", "meeting_date", "matter_title")) -> DataFrame:
    """Vote rows with their matches summed up.

    As in the data's origin the key names neither file nor body, so equal matters of two files enrich each other.
    """
    who = person_key("politician_name")
    keyed = votes.withColumn("_who", who)
    for k in keys:
        keyed = keyed.withColumn(f"_{k}", null_to_blank(k))
    on = ["_who", *(f"_{k}" for k in keys)]
    flat = matches.join(keyed.select("row_id", *on), "row_id").select(*on, "owner_full_name", "raw_name", "norm_name", "confidence", "record_type", "ord")
    once = flat.groupBy(*on, "owner_full_name", "raw_name", "norm_name", "record_type").agg(F.max("confidence").alias("confidence"), F.min("ord").alias("ord"))

    def in_order(c: str) -> Column:
        return F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c])), "; ")

    summed = once.groupBy(*on).agg(
        F.array_join(F.array_sort(F.collect_set("owner_full_name")), "; ").alias("matched_owners"),
        in_order("raw_name").alias("matched_companies"), in_order("norm_name").alias("matched_aliases"),
        F.max("confidence").alias("match_confidence"), F.count("*").alias("match_count"),
        F.array_join(F.array_sort(F.collect_set("record_type")), "; ").alias("matched_record_types"),
    )
    out = keyed.join(summed, on, "left").drop(*on)
    return out.withColumn("match_count", F.coalesce("match_count", F.lit(0))).fillna("", ["matched_owners", "matched_companies", "matched_aliases", "matched_record_types"])


def minutes_matches(minutes: DataFrame, found: DataFrame, least: float = 0.75) -> DataFrame:
    """Every entity that a minutes text names, whoever owns it; once for each file, owner, company and alias."""
    named = occurrences(minutes, "minutes_cache_key", "text", found, "norm_name").withColumnRenamed("phrase", "norm_name")
    scored = named.join(found, "norm_name").withColumn("confidence", F.lit(WHOLE)).filter(F.col("confidence") >= least)
    return scored.dropDuplicates(["minutes_cache_key", "owner_full_name", "raw_name", "norm_name"])


def allowed(votes: DataFrame, people: DataFrame, name: str = "politician_name") -> DataFrame:
    """Votes of people on the list, by full or last name."""
    listed = people.select(F.explode(F.array(person_key("full_name"), last_name(person_key("full_name")))).alias("_k")).filter("_k <> ''").distinct()
    return votes.join(listed, person_key(name) == F.col("_k"), "left_semi")


def with_filings(rows: DataFrame, filings: DataFrame, jurisdiction: str | None = None) -> DataFrame:
    """Entity rows with their filings."""
    kept = filings if jurisdiction is None else filings.filter(F.col("jurisdiction") == jurisdiction)
    return rows.join(kept, "form700_cache_key")


def with_minutes(votes: DataFrame, minutes: DataFrame) -> DataFrame:
    """Vote rows with their minutes, dates sorted as text."""
    return votes.join(minutes.select("minutes_cache_key", "jurisdiction", "platform", "minutes_url"), "minutes_cache_key").orderBy(F.desc("meeting_date"), "matter_id", "politician_name")


def minutes_in_order(minutes: DataFrame) -> DataFrame:
    """O2: minutes that have a text, latest date first (dates as text), then by body."""
    return minutes.filter("text_path <> ''").orderBy(F.desc("meeting_date"), "body")


def entities_in_order(rows: DataFrame) -> DataFrame:
    """O4"""
    return rows.orderBy("owner_last_name", "owner_first_name", "entity_name")


def owners(filings: DataFrame) -> DataFrame:
    """Distinct owners by name, those with the latest filing first among equal names."""
    names = ["filer_last_name", "filer_first_name", "filer_middle_name", "filer_full_name", "agency_name"]
    return filings.groupBy(*names).agg(F.max("filed_date").alias("_d")).orderBy("filer_last_name", "filer_first_name", F.desc("_d")).drop("_d")
