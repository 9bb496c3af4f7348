"""Schemas of the feeds: nested official statistics, lookups, units, two-source documents."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, LONG, INT, REAL, FLAG = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PARTY_RESULT = record(party_id=INT, party_cons_votes=LONG, party_list_vote=LONG, first_mp_app_count=LONG)
CANDIDATE_RESULT = record(mp_app_id=TEXT, party_id=INT, mp_app_vote=LONG, mp_app_vote_percent=REAL, mp_app_rank=INT)
CONSTITUENCY_RESULT = record(
    cons_id=TEXT, turn_out=LONG, percent_turn_out=REAL, valid_votes=LONG, invalid_votes=LONG, blank_votes=LONG, counted_vote_stations=LONG,
    percent_count=REAL, pause_report=FLAG, candidates=T.ArrayType(CANDIDATE_RESULT),
)
PROVINCE_RESULT = record(
    prov_id=TEXT, turn_out=LONG, valid_votes=LONG, counted_vote_stations=LONG, total_vote_stations=LONG, percent_count=REAL,
    result_party=T.ArrayType(PARTY_RESULT), constituencies=T.ArrayType(CONSTITUENCY_RESULT),
)
STATISTICS = record(
    last_update=TEXT, turn_out=LONG, valid_votes=LONG, invalid_votes=LONG, blank_votes=LONG, percent_count=REAL, result_province=T.ArrayType(PROVINCE_RESULT)
)
PARTIES = record(id=TEXT, name=TEXT, color=TEXT, abbr=TEXT)
CONSTITUENCIES = record(cons_id=TEXT, total_vote_stations=LONG, registered_vote=LONG, zone=T.ArrayType(TEXT))
CANDIDATES = record(mp_app_id=TEXT, mp_app_name=TEXT, mp_app_party_id=INT, mp_app_no=INT, image_url=TEXT)
PROVINCES = record(prov_id=TEXT, province=TEXT)

UNIT_CANDIDATE = record(candidate_id=TEXT, name=TEXT, number=INT, party=TEXT, party_color=TEXT, official_votes=LONG, citizen_votes=LONG, percent=REAL, rank=INT)
UNIT_PARTY = record(name=TEXT, color=TEXT, candidate_id=TEXT, candidate_name=TEXT, official=LONG, citizen=LONG, percent=REAL, rank=INT)
UNITS = record(
    unit_id=TEXT, constituency=TEXT, province=TEXT, prov_id=TEXT, zone=T.ArrayType(TEXT), official_total=LONG, citizen_total=LONG, difference=LONG, level=TEXT,
    turn_out=LONG, percent_turn_out=REAL, valid_votes=LONG, invalid_votes=LONG, blank_votes=LONG, registered_vote=LONG, total_stations=LONG,
    counted_stations=LONG, percent_count=REAL, pause_report=FLAG, winner=TEXT, winner_votes=LONG, winner_color=TEXT, has_discrepancy=FLAG, note=TEXT,
    candidates=T.ArrayType(UNIT_CANDIDATE), parties=T.ArrayType(UNIT_PARTY),
)

#: One source's document of a unit; ``candidates`` wins over ``parties`` even if empty.
VOTES = T.ArrayType(record(name=TEXT, votes=LONG))
UNIT_DOCUMENT = record(unit_id=TEXT, timestamp=TEXT, candidates=VOTES, parties=VOTES)
UNIT_LIST = record(unit_id=TEXT, constituency=TEXT, province=TEXT)
PROBES = record(url=TEXT, status=INT, preview=TEXT)
