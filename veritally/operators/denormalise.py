"""From nested official feeds to one flat unit table, and its totals.

Provinces and constituencies are unnested in one scan, ballots stay lists.  The
lookups are reference tables of a country: parties are a map in one row,
provinces, constituencies and candidates are joined and broadcast only while
Spark's own size threshold says so.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Defaults of the feeds.
NO_COLOUR = "#999"
NO_RANK = 999
#: Note of a unit that only the official source has counted so far.
PENDING_NOTE = "รอข้อมูลชุดที่สอง"

#: Fields of a unit's candidate and their names in its list of parties.
PARTY_FIELDS = {"party": "name", "party_color": "color", "candidate_id": "candidate_id", "name": "candidate_name", "official_votes": "official", "citizen_votes": "citizen", "percent": "percent", "rank": "rank"}


def known_parties(parties: DataFrame) -> DataFrame:
    """(party_id, party, party_color, abbr): defaults for the colour, and the name for an empty abbreviation."""
    return parties.select(
        F.expr("try_cast(id as int)").alias("party_id"),
        F.col("name").alias("party"),
        F.coalesce("color", F.lit(NO_COLOUR)).alias("party_color"),
        F.coalesce(F.nullif(F.col("abbr"), F.lit("")), F.col("name")).alias("abbr"),
    )


def with_lookup(df: DataFrame, lookup: DataFrame, on: str, name: str, default: Column) -> DataFrame:
    """Left join that fills ``name`` with a default where the lookup has no row."""
    return df.join(lookup, on, "left").withColumn(name, F.coalesce(F.col(name), default))


def provinces(statistics: DataFrame) -> DataFrame:
    """A row for each province, its constituencies and party results still nested."""
    return statistics.select(F.posexplode("result_province").alias("prov_pos", "p")).select("prov_pos", "p.*")


def is_counted(turn_out: Column, valid_votes: Column) -> Column:
    """Whether anything of a constituency was counted."""
    return ~((F.coalesce(turn_out, F.lit(0)) == 0) & (F.coalesce(valid_votes, F.lit(0)) == 0))


def constituencies(provinces: DataFrame) -> DataFrame:
    """A row for each constituency in which anything was counted."""
    rows = provinces.select("prov_id", "prov_pos", F.posexplode("constituencies").alias("cons_pos", "c")).select("prov_id", "prov_pos", "cons_pos", "c.*")
    return rows.where(is_counted(F.col("turn_out"), F.col("valid_votes")))


def known_by_id(parties: DataFrame) -> DataFrame:
    """One row with a map ``known`` from party_id to (party, party_color): the parties of a country fit in a row."""
    one = known_parties(parties).where("party_id is not null").groupBy("party_id").agg(F.min(F.struct("party", "party_color")).alias("p"))
    return one.agg(F.map_from_entries(F.collect_list(F.struct("party_id", "p"))).alias("known"))


def ranked(cons: DataFrame, parties: DataFrame) -> DataFrame:
    """``cons`` with unit_id and its ``candidates`` by rank, with their parties' names and without their own.

    Equal and missing ranks keep the feed's order, missing ones last.  A ballot is
    ordered where it is nested, so nothing is shuffled.
    """
    rank = lambda c, i: F.struct(F.coalesce(c["mp_app_rank"], F.lit(NO_RANK)).alias("rank"), i.alias("pos"), c.alias("c"))
    rows = cons.withColumnRenamed("cons_id", "unit_id").withColumn("candidates", F.sort_array(F.transform("candidates", rank))).crossJoin(F.broadcast(known_by_id(parties)))
    zero = F.lit(0)

    def entry(x: Column) -> Column:
        c = x["c"]
        party = F.try_element_at("known", c["party_id"])
        return F.struct(
            c["mp_app_id"].alias("mp_app_id"),
            F.coalesce(party["party"], F.concat(F.lit("party_"), c["party_id"].cast("string"))).alias("party"),
            F.coalesce(party["party_color"], F.lit(NO_COLOUR)).alias("party_color"),
            F.coalesce(c["mp_app_vote"], zero).alias("votes"),
            F.coalesce(c["mp_app_vote_percent"], F.lit(0.0)).alias("percent"),
            F.coalesce(c["mp_app_rank"], zero).alias("rank"),
        )

    return rows.withColumn("first", entry(F.get("candidates", zero))).withColumn("candidates", F.transform("candidates", entry)).drop("known")


def unit_candidates(statistics: DataFrame, parties: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates of :func:`units` as rows: unit_id, place (from 1) and an entry's fields; nothing is gathered for them."""
    rows = ranked(constituencies(provinces(statistics)), parties).select("unit_id", F.posexplode("candidates").alias("pos", "c")).select("unit_id", (F.col("pos") + 1).alias("place"), "c.*")
    rows = with_lookup(rows, candidates.select("mp_app_id", F.col("mp_app_name").alias("name"), F.col("mp_app_no").alias("number")), "mp_app_id", "name", F.lit(""))
    return rows.select(
        "unit_id", "place", F.coalesce("mp_app_id", F.lit("")).alias("candidate_id"), "name", F.coalesce("number", F.lit(0)).alias("number"), "party", "party_color",
        F.col("votes").alias("official_votes"), F.lit(0).cast("bigint").alias("citizen_votes"), "percent", "rank",
    )


def unit_parties(statistics: DataFrame, parties: DataFrame, candidates: DataFrame) -> DataFrame:
    """:func:`unit_candidates` under their parties' names."""
    return unit_candidates(statistics, parties, candidates).select("unit_id", "place", *[F.col(field).alias(name) for field, name in PARTY_FIELDS.items()])


def with_names(rows: DataFrame, cons: DataFrame, candidates: DataFrame) -> DataFrame:
    """:func:`ranked` rows whose candidates have their names and numbers.

    Only ids are looked up and only names that are known come back, a list for each
    unit; a ballot bounds it.  The ballots themselves are shuffled once, by unit.
    """
    asked = cons.select(F.col("cons_id").alias("unit_id"), F.explode("candidates.mp_app_id").alias("mp_app_id"))
    people = candidates.select("mp_app_id", F.struct("mp_app_id", F.col("mp_app_name").alias("name"), F.col("mp_app_no").alias("number")).alias("person"))
    names = asked.join(people, "mp_app_id").groupBy("unit_id").agg(F.collect_list("person").alias("names"))

    def named(c: Column) -> Column:
        own = F.array_min(F.filter("names", lambda p: p["mp_app_id"] == c["mp_app_id"]))
        return F.struct(
            F.coalesce(c["mp_app_id"], F.lit("")).alias("candidate_id"),
            F.coalesce(own["name"], F.lit("")).alias("name"),
            F.coalesce(own["number"], F.lit(0)).alias("number"),
            c["party"].alias("party"),
            c["party_color"].alias("party_color"),
            c["votes"].alias("official_votes"),
            F.lit(0).cast("bigint").alias("citizen_votes"),
            c["percent"].alias("percent"),
            c["rank"].alias("rank"),
        )

    return rows.join(names, "unit_id", "left").withColumn("candidates", F.coalesce(F.transform("candidates", named), F.array())).drop("names")


def as_parties(candidates: Column) -> Column:
    """The same candidates under their parties' names."""
    return F.transform(candidates, _as_party)


def units(statistics: DataFrame, provinces_: DataFrame, parties: DataFrame, info: DataFrame, candidates: DataFrame | None) -> DataFrame:
    """The unit table: a row for each counted constituency, with its labels, counts, winner and candidates.

    The winner is first by rank, not by votes.  parties lists the same candidates
    under their parties' names.  ``candidates`` None: without both lists, whose
    names are the one large lookup.  The second source hasn't counted yet: its votes
    and the difference are 0, the level is pending.
    """
    cons = constituencies(provinces(statistics))
    rows = ranked(cons, parties)
    rows = with_names(rows, cons, candidates) if candidates is not None else rows.drop("candidates")
    rows = rows.join(info.select(F.col("cons_id").alias("unit_id"), "zone", "registered_vote", F.col("total_vote_stations").alias("total_stations")), "unit_id", "left")
    rows = with_lookup(rows, provinces_, "prov_id", "province", F.col("prov_id"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    lists = ["candidates", as_parties(F.col("candidates")).alias("parties")] if candidates is not None else []
    return rows.select(
        "unit_id",
        F.concat("province", F.lit(" เขต "), F.split_part("unit_id", F.lit("_"), F.lit(2))).alias("constituency"),
        "province",
        "prov_id",
        F.coalesce("zone", F.array().cast("array<string>")).alias("zone"),
        F.coalesce("valid_votes", F.lit(0)).alias("official_total"),
        F.lit(0).cast("bigint").alias("citizen_total"),
        F.lit(0).cast("bigint").alias("difference"),
        F.lit("pending").alias("level"),
        n("turn_out"),
        F.coalesce("percent_turn_out", F.lit(0.0)).alias("percent_turn_out"),
        n("valid_votes"),
        n("invalid_votes"),
        n("blank_votes"),
        n("registered_vote"),
        n("total_stations"),
        F.coalesce("counted_vote_stations", F.lit(0)).alias("counted_stations"),
        F.coalesce("percent_count", F.lit(0.0)).alias("percent_count"),
        F.coalesce("pause_report", F.lit(False)).alias("pause_report"),
        F.coalesce("first.party", F.lit("")).alias("winner"),
        F.coalesce("first.votes", F.lit(0)).alias("winner_votes"),
        F.coalesce("first.party_color", F.lit(NO_COLOUR)).alias("winner_color"),
        F.lit(False).alias("has_discrepancy"),
        F.lit(PENDING_NOTE).alias("note"),
        *lists,
    )


def _as_party(c: Column) -> Column:
    return F.struct(*[c[field].alias(name) for field, name in PARTY_FIELDS.items()])


def national_parties(statistics: DataFrame, parties: DataFrame, limit: int = 10) -> DataFrame:
    """The parties with the most constituency votes in the country: three sums, ties by id."""
    rows = provinces(statistics).select(F.explode("result_party").alias("r")).select("r.*")
    sums = party_totals(rows, "party_id", {"cons_votes": "party_cons_votes", "list_votes": "party_list_vote", "seats": "first_mp_app_count"})
    named = with_lookup(sums, known_parties(parties), "party_id", "party", F.concat(F.lit("party_"), F.col("party_id").cast("string")))
    return most_votes(named, "party_id", limit)


def party_totals(rows: DataFrame, party: str, sums: Mapping[str, str]) -> DataFrame:
    """Each party's sums (name -> column; missing values count 0)."""
    return rows.groupBy(party).agg(*[F.sum(F.coalesce(column, F.lit(0))).alias(name) for name, column in sums.items()])


def most_votes(totals: DataFrame, party: str, limit: int = 10) -> DataFrame:
    """The ``limit`` parties with the most ``cons_votes``, ties by ``party``."""
    return totals.orderBy(F.desc("cons_votes"), party).limit(limit)


def province_summary(statistics: DataFrame, provinces_: DataFrame) -> DataFrame:
    """A row for each province, also those without a counted constituency; its units are counted where they are nested."""
    counted = F.filter("constituencies", lambda c: is_counted(c["turn_out"], c["valid_votes"]))
    units = F.when(F.col("constituencies").isNotNull(), F.size(counted)).cast("bigint")
    rows = provinces(statistics).select("prov_id", "turn_out", "valid_votes", "counted_vote_stations", "total_vote_stations", "percent_count", units.alias("units"))
    rows = with_lookup(rows, provinces_, "prov_id", "province", F.col("prov_id"))
    return rows.select("prov_id", "province", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("turn_out", "valid_votes", "counted_vote_stations", "total_vote_stations")], F.coalesce("percent_count", F.lit(0.0)).alias("percent_count"), F.coalesce("units", F.lit(0)).alias("units"))


def top_by_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, with their place; groups are limited before the shuffle."""
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("place") <= n)
