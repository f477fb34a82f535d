"""Official feed documents to typed rows, with every malformed document or entry returned as a fault.

Each entry of a document is parsed on its own, so a bad one never costs its neighbours. Adapters return (rows, faults);
a fault names its document's ``keep`` columns, the place in the document and the first rule that was broken.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe import functions as fn
from tallyframe.operators import lookup

UNREADABLE = "unreadable_document"

# Position codes and their abbreviations.
POSITION_ABBREVIATION = {
    "1": "P", "2": "C", "3": "1B", "4": "2B", "5": "3B", "6": "SS", "7": "LF", "8": "CF", "9": "RF", "10": "DH",
}

# Feed statistic -> column of a batting line, and of the outcome vector of a game log.
BATTING_STATISTICS = {
    "plateAppearances": "plate_appearances",
    "atBats": "at_bats",
    "hits": "hits",
    "doubles": "doubles",
    "triples": "triples",
    "homeRuns": "home_runs",
    "baseOnBalls": "base_on_balls",
    "intentionalWalks": "intentional_walks",
    "hitByPitch": "hit_by_pitch",
    "strikeOuts": "strikeouts",
    "sacBunts": "sac_bunts",
    "sacFlies": "sac_flies",
    "catchersInterference": "catchers_interference",
}
OUTCOME_STATISTICS = {
    "plateAppearances": "batting_PA",
    "atBats": "batting_AB",
    "baseOnBalls": "batting_BB",
    "hitByPitch": "batting_HBP",
    "strikeOuts": "batting_SO",
    "sacFlies": "batting_SF",
    "sacBunts": "batting_SH",
    "catchersInterference": "batting_CI",
}

# Shapes of single entries; identifiers are text, since feeds write them as numbers or text.
PLAY_ENTRY = """struct<
  atBatIndex: string, about: struct<atBatIndex: string, inning: string, halfInning: string, startTime: string, endTime: string>,
  result: struct<eventType: string, event: string, description: string>,
  matchup: struct<batter: struct<id: string>, pitcher: struct<id: string>, batSide: struct<code: string>, pitchHand: struct<code: string>>,
  playEvents: array<struct<isPitch: string>>>"""
FIELDING_ENTRY = """struct<
  player: struct<id: string, fullName: string>, person: struct<id: string, fullName: string>, team: struct<id: string, name: string>,
  position: struct<code: string, abbreviation: string, name: string, type: string>, stat: map<string, string>>"""
GAME_LOG_ENTRY = """struct<
  date: string, gameType: string, game: struct<gamePk: string, pk: string, id: string>,
  league: struct<id: string>, team: struct<id: string>, sport: struct<id: string>, stat: map<string, string>>"""
BOX_PLAYER = """struct<
  person: struct<id: string, fullName: string>, position: struct<abbreviation: string>, battingOrder: string,
  stats: struct<batting: map<string, string>>>"""
GAME_DATA = """struct<gameData: struct<
  game: struct<type: string>, datetime: struct<officialDate: string>,
  teams: struct<
    away: struct<id: string, league: struct<id: string>, sport: struct<id: string>>,
    home: struct<id: string, league: struct<id: string>, sport: struct<id: string>>>>>"""


def statistics(stat: Column, names: Sequence[str]) -> Column:
    """(given, value) of each named statistic as one array.

    A loop in an array function stays small where a copy of the rule for each statistic would make generated code
    too large for the compiler.
    """
    texts = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.try_element_at(stat, n))
    return F.transform(texts, lambda x: F.struct(x.isNotNull().alias("given"), fn.whole_number(x).alias("value")))


def bad_count(value: Column) -> Column:
    return value.isNull() | (value < 0)


def array_entries(documents: DataFrame, text: str, path: str, schema: str, keep: Sequence[str]) -> DataFrame:
    """keep, position, raw text and parsed item of each entry at ``path``; one null entry if the array is unreadable.

    ``path`` is a field, or two with a point where the outer one is an array whose parts are read one after the other.
    Entries are parsed inside the generator: conditions on parsed fields cannot be pushed below it, where each field of
    a condition would parse the text again.
    """
    outer, _, inner = path.partition(".")
    if not inner:
        texts = F.from_json(F.col(text), f"struct<{outer}: array<string>>")[outer]
    else:
        parts = F.from_json(F.col(text), f"struct<{outer}: array<struct<{inner}: array<string>>>>")[outer]
        texts = F.flatten(F.transform(parts, lambda p: F.coalesce(p[inner], F.array().cast("array<string>"))))
    read = documents.select(*keep, texts.alias("_texts"))
    entries = F.transform("_texts", lambda raw: F.struct(raw.alias("raw"), F.from_json(raw, schema).alias("item")))
    rows = read.select(*keep, F.col("_texts").isNull().alias("unreadable"), F.posexplode_outer(entries).alias("position", "_entry"))
    return rows.where("unreadable or position is not null").select(*keep, "unreadable", "position", "_entry.raw", "_entry.item")


def judged(rows: DataFrame, rules: Sequence[tuple[Column, str]], place: Sequence[str], fields: Mapping[str, Column]) -> DataFrame:
    """Place, typed fields and first broken rule (``fault``, null for none) of every row, in one reading of the documents.

    The fault passes through a generator of one element, so that a condition on it is not replaced by all the rules.
    """
    checked = rows.withColumn("_fault", fn.first_case(rules)).select(*rows.columns, F.explode(F.array("_fault")).alias("fault"))
    return checked.select(*place, *[c.alias(name) for name, c in fields.items()], "fault")


def split_faults(rows: DataFrame, rules: Sequence[tuple[Column, str]], place: Sequence[str], fields: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(typed rows that break no rule, place and first broken rule of the others); an unknown rule counts as kept."""
    checked = judged(rows, rules, place, fields)
    return checked.where("fault is null").drop("fault"), checked.where("fault is not null").select(*place, "fault")


def unique_grain(rows: DataFrame, faults: DataFrame, keys: Sequence[str], place: Sequence[str], fault: str) -> tuple[DataFrame, DataFrame]:
    """Rows of keys that occur once; the rows of other keys join the faults."""
    kept = lookup.without_ambiguous(rows, keys)
    repeated = rows.groupBy(*[F.col(k).alias(f"_r_{k}") for k in keys]).agg(F.count("*").alias("_n")).where("_n > 1")
    doubled = rows.join(repeated, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], "left_semi")
    return kept.drop("position"), faults.unionByName(doubled.select(*place, F.lit(fault).alias("fault")))


def fielding_usage(documents: DataFrame, text: str, keep: Sequence[str] = ("season", "league_id", "level_group")) -> tuple[DataFrame, DataFrame]:
    """(one row per player, team and position with games and outs, faults) of fielding split documents.

    Innings become outs exactly; a designated hitter has none; a team, player and position may occur once.
    """
    rows = array_entries(documents, text, "splits", FIELDING_ENTRY, keep)
    item = F.col("item")
    names = ("code", "abbreviation", "name", "type")
    who = F.coalesce(item["player"], item["person"])
    innings = F.trim(F.try_element_at(item["stat"], F.lit("innings")))
    rows = rows.withColumns(
        {
            **{f"_{f}": F.coalesce(F.trim(item["position"][f]), F.lit("")) for f in names},
            "_player": fn.whole_number(who["id"]),
            "_team": fn.whole_number(item["team"]["id"]),
            "_games": statistics(item["stat"], ("games", "gamesPlayed", "gamesStarted")),
            "_outs": fn.innings_to_outs(innings),
        }
    )
    trimmed = {f: F.col(f"_{f}") for f in names}
    player, team, outs = F.col("_player"), F.col("_team"), F.col("_outs")
    games, played, started = [F.col("_games")[i]["value"] for i in range(3)]
    rules = [
        (F.col("unreadable"), UNREADABLE),
        (bad_count(player), "invalid_player_id"),
        (bad_count(team), "invalid_team_id"),
        (~fn.member(trimmed["code"], list(POSITION_ABBREVIATION)), "unknown_position_code"),
        (trimmed["abbreviation"] != fn.map_value(trimmed["code"], POSITION_ABBREVIATION), "position_code_mismatch"),
        (trimmed["name"] == "", "missing_position_name"),
        (bad_count(games) | bad_count(played) | bad_count(started), "invalid_games"),
        (games != played, "games_differ"),
        (started > played, "more_starts_than_games"),
        (outs.isNull(), "invalid_innings"),
        ((trimmed["abbreviation"] == "DH") & (outs != 0), "designated_hitter_with_outs"),
    ]
    fields = {
        "team_id": team,
        "team_name": F.coalesce(item["team"]["name"], F.lit("")),
        "player_id": player,
        "player_name": F.coalesce(who["fullName"], F.lit("")),
        **{f"position_{f}": c for f, c in trimmed.items()},
        "games_played": played,
        "games_started": started,
        "source_innings": innings,
        "fielding_outs": outs,
    }
    place = [*keep, "position"]
    usage, faults = split_faults(rows, rules, place, fields)
    return unique_grain(usage, faults, [*keep, "team_id", "player_id", "position_code"], place, "repeated_grain")


def _box_sides(documents: DataFrame, text: str, keep: Sequence[str], field: str) -> DataFrame:
    """keep, batting_side and one field of both sides of a box score; the document is parsed once for both."""
    side = f"struct<{field}>"
    name = field.split(":")[0]
    read = documents.select(*keep, F.from_json(F.col(text), f"struct<teams: struct<away: {side}, home: {side}>>")["teams"].alias("_teams"))
    return read.select(*keep, F.inline(F.array(*[F.struct(F.lit(s).alias("batting_side"), F.col("_teams")[s][name].alias(name)) for s in ("away", "home")])))


def boxscore_lines(documents: DataFrame, text: str, keep: Sequence[str] = ("game_pk",)) -> DataFrame:
    """Batting line of each player of both sides with its ``fault`` (null for none): players are a map keyed ``ID<player id>``.

    A player without a batting line has not batted and is left out; a statistic that the line lacks stays null.
    """
    halves = _box_sides(documents, text, keep, "players: map<string, string>")
    entries = F.transform(F.map_entries("players"), lambda e: F.struct(e["key"].alias("player_key"), F.from_json(e["value"], BOX_PLAYER).alias("item")))
    rows = halves.select(*keep, "batting_side", F.col("players").isNull().alias("unreadable"), F.explode_outer(entries).alias("_entry"))
    rows = rows.select(*keep, "batting_side", "unreadable", "_entry.player_key", "_entry.item").where("unreadable or player_key is not null")
    item = F.col("item")
    batting = item["stats"]["batting"]
    rows = rows.withColumns({"_person": fn.whole_number(item["person"]["id"]), "_line": statistics(batting, list(BATTING_STATISTICS))})
    person = F.col("_person")
    malformed = F.coalesce(F.exists("_line", lambda x: x["given"] & bad_count(x["value"])), F.lit(False))
    rules = [
        (F.col("unreadable"), UNREADABLE),
        (bad_count(person), "invalid_player_id"),
        (F.col("player_key") != F.concat(F.lit("ID"), person.cast("string")), "player_key_mismatch"),
        (malformed, "invalid_statistic"),
    ]
    fields = {
        "player_id": person,
        "player_name": F.coalesce(item["person"]["fullName"], F.lit("")),
        "position_abbreviation": item["position"]["abbreviation"],
        "batting_order": fn.whole_number(item["battingOrder"]),
        "has_batting": F.coalesce(F.size(batting) > 0, F.lit(False)),
        **{c: F.col("_line")[i]["value"] for i, c in enumerate(BATTING_STATISTICS.values())},
    }
    lines = judged(rows, rules, [*keep, "batting_side", "player_key"], fields)
    return lines.where("has_batting or fault is not null").drop("has_batting")


def boxscore_players(documents: DataFrame, text: str, keep: Sequence[str] = ("game_pk",)) -> tuple[DataFrame, DataFrame]:
    """(lines of ``boxscore_lines`` without fault, faults)."""
    lines = boxscore_lines(documents, text, keep)
    return lines.where("fault is null").drop("fault", "player_key"), lines.where("fault is not null").select(*keep, "batting_side", "player_key", "fault")


def boxscore_teams(documents: DataFrame, text: str, keep: Sequence[str] = ("game_pk",)) -> DataFrame:
    """Batting totals that a box score states for each side; a side without totals gives no row."""
    sides = _box_sides(documents, text, keep, "teamStats: struct<batting: map<string, string>>")
    stated = sides.select(*keep, "batting_side", F.col("teamStats.batting").alias("stat")).where(F.size("stat") > 0)
    totals = stated.select(*keep, "batting_side", statistics(F.col("stat"), list(BATTING_STATISTICS)).alias("_line"))
    return totals.select(*keep, "batting_side", *[F.col("_line")[i]["value"].alias(c) for i, c in enumerate(BATTING_STATISTICS.values())])


def boxscore_gaps(players: DataFrame, teams: DataFrame, keep: Sequence[str] = ("game_pk",)) -> DataFrame:
    """Stated team total against the sum of the side's players, where they differ; one row per statistic."""
    keys, names = [*keep, "batting_side"], list(BATTING_STATISTICS.values())
    sums = players.groupBy(*keys).agg(*[F.sum(n).alias(f"_{n}") for n in names])
    joined = teams.join(sums, keys, "left")
    cells = F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("stated"), F.coalesce(f"_{n}", F.lit(0)).alias("summed")) for n in names])
    return joined.select(*keys, F.inline(cells)).where("stated <> summed")


def play_sequences(documents: DataFrame, text: str, event_types: Mapping[str, bool], keep: Sequence[str] = ("game_pk",)) -> tuple[DataFrame, DataFrame]:
    """(one row per distinct play with its payload hash and the number of equal copies, faults).

    ``event_types`` maps every known event type to whether it completes a plate appearance. The hash is over the play
    with its names in order, so copies that differ in order only are one.
    """
    rows = array_entries(documents, text, "allPlays", PLAY_ENTRY, keep)
    item, about, matchup = F.col("item"), F.col("item.about"), F.col("item.matchup")
    rows = rows.withColumns({"_event": F.trim(item["result"]["eventType"]), "_index": fn.whole_number(item["atBatIndex"])})
    rows = rows.withColumn("_completes", fn.map_value(F.col("_event"), event_types))
    event, completes = F.col("_event"), F.col("_completes")
    rules = [
        (F.col("unreadable"), UNREADABLE),
        (F.col("_index").isNull(), "missing_at_bat_index"),
        (~F.coalesce(fn.present(event), F.lit(False)), "blank_event_type"),
        (completes.isNull(), "unknown_event_type"),
    ]
    fields = {
        "at_bat_index": F.col("_index"),
        "payload_hash": F.sha2(F.coalesce(F.to_json(F.try_parse_json("raw")), "raw"), 256),
        "classification_status": F.when(completes, "official_true_pa").otherwise("official_non_pa"),
        "result_event_type": event,
        "result_event": item["result"]["event"],
        "result_description": item["result"]["description"],
        "is_plate_appearance": completes,
        "batter_mlbam_id": fn.whole_number(matchup["batter"]["id"]),
        "pitcher_mlbam_id": fn.whole_number(matchup["pitcher"]["id"]),
        "batter_side": matchup["batSide"]["code"],
        "pitcher_hand": matchup["pitchHand"]["code"],
        "inning": fn.whole_number(about["inning"]),
        "half_inning": about["halfInning"],
        "sequence_start_time": F.try_to_timestamp(about["startTime"]),
        "sequence_end_time": F.try_to_timestamp(about["endTime"]),
        "official_physical_pitch_count": F.size(F.filter(F.coalesce(item["playEvents"], F.array()), lambda e: e["isPitch"] == "true")).cast("bigint"),
    }
    typed, faults = split_faults(rows, rules, [*keep, "position"], fields)
    # Equal payloads have equal fields, so grouping by all of them joins copies without choosing among rows.
    return typed.drop("position").groupBy(*keep, *fields).agg(F.count("*").alias("duplicate_row_count")), faults


def participant_authority(sequences: DataFrame, keys: Sequence[str] = ("game_pk", "at_bat_index"), batter: str = "batter_mlbam_id") -> tuple[DataFrame, DataFrame]:
    """(the one official batter of each sequence, sequences whose copies name several)."""
    named = sequences.where(F.col(batter).isNotNull()).groupBy(*keys).agg(F.min(batter).alias("official_batter_id"), F.max(batter).alias("_other"))
    agreed = F.col("official_batter_id") == F.col("_other")
    return named.where(agreed).drop("_other"), named.where(~agreed).select(*keys)


def game_leagues(documents: DataFrame, text: str, keep: Sequence[str] = ("game_pk",)) -> tuple[DataFrame, DataFrame]:
    """(date, league, sport and teams of each regular-season game, faults); both teams must share league and sport."""
    data = F.col("_doc.gameData")
    rows = documents.select(*keep, F.explode(F.array(F.from_json(F.col(text), GAME_DATA))).alias("_doc"))
    away, home = data["teams"]["away"], data["teams"]["home"]
    numbers = {f"{side}_{part}": fn.whole_number(c) for side, t in (("away", away), ("home", home)) for part, c in (("team", t["id"]), ("league", t["league"]["id"]), ("sport", t["sport"]["id"]))}
    found = {**numbers, "date": fn.first_date(data["datetime"]["officialDate"], ["yyyy-MM-dd"]), "kind": F.trim(data["game"]["type"])}
    rows = rows.withColumns({f"_{name}": c for name, c in found.items()})
    number, date, kind = {n: F.col(f"_{n}") for n in numbers}, F.col("_date"), F.col("_kind")

    def apart(part):
        return ~F.coalesce(number[f"away_{part}"] == number[f"home_{part}"], F.lit(False))

    rules = [
        (data.isNull(), UNREADABLE),
        (~kind.eqNullSafe(F.lit("R")), "not_regular_season"),
        (date.isNull(), "missing_official_date"),
        (number["away_team"].isNull() | number["home_team"].isNull(), "missing_team"),
        (apart("league"), "ambiguous_league"),
        (apart("sport"), "ambiguous_sport"),
    ]
    fields = {
        "game_date": date,
        "game_type": kind,
        "league_id": number["away_league"],
        "sport_id": number["away_sport"],
        "away_team_id": number["away_team"],
        "home_team_id": number["home_team"],
    }
    return split_faults(rows, rules, list(keep), fields)


def game_log_rows(documents: DataFrame, text: str, keep: Sequence[str] = ("player_id", "sport_id")) -> DataFrame:
    """One outcome vector per game, player and league of game-log documents, or one row per faulty split, with ``fault`` (null for none).

    Splits of one game for several teams are added up (team null) when they agree on date and game type, name distinct
    teams and have whole vectors; otherwise the game is a fault. Splits without a game are faults too.
    """
    rows = array_entries(documents, text, "stats.splits", GAME_LOG_ENTRY, keep)
    item = F.col("item")
    game = F.col("_game")
    rows = rows.withColumns(
        {
            "_game": F.coalesce(*[fn.whole_number(item["game"][f]) for f in ("gamePk", "pk", "id")]),
            "_line": statistics(item["stat"], list(OUTCOME_STATISTICS)),
        }
    )
    rules = [
        (F.col("unreadable"), UNREADABLE),
        (game.isNull(), "missing_game"),
        (fn.whole_number(item["sport"]["id"]) != F.col("sport_id"), "other_sport"),
    ]
    fields = {
        "game_id": game,
        "game_date": fn.first_date(item["date"], ["yyyy-MM-dd"]),
        "game_type": item["gameType"],
        "league_id": fn.whole_number(item["league"]["id"]),
        "team_id": fn.whole_number(item["team"]["id"]),
        **{c: F.col("_line")[i]["value"] for i, c in enumerate(OUTCOME_STATISTICS.values())},
    }
    splits = judged(rows, rules, [*keep, "position"], fields)
    vector = list(OUTCOME_STATISTICS.values())
    whole = F.lit(True)
    for name in ("game_date", "game_type", "team_id", *vector):
        whole = whole & F.col(name).isNotNull()
    # Several splits of a game are few; days, types and teams are numbers or hashes, so nothing is sorted. Faulty splits
    # go through the same aggregate, equal ones as one row with their number, so the documents are read once.
    faulty = F.col("fault").isNotNull()
    placed = splits.withColumns({"_at": F.when(faulty, F.col("position")), **{c: F.when(~faulty, F.col(c)) for c in ("game_id", "league_id")}})
    games = placed.groupBy(*keep, "fault", "_at", "game_id", "league_id").agg(
        F.count("*").alias("_n"),
        F.count_if(whole).alias("_whole"),
        F.size(F.collect_set("team_id")).alias("_teams"),
        F.min("game_date").alias("game_date"),
        F.max("game_date").alias("_last_date"),
        F.size(F.collect_set("game_type")).alias("_types"),
        F.any_value("game_type", True).alias("game_type"),
        F.max("team_id").alias("team_id"),
        F.min("position").alias("position"),
        *[F.sum(c).alias(c) for c in vector],
    )
    added = (F.col("_whole") == F.col("_n")) & (F.col("_teams") == F.col("_n")) & (F.col("_types") == 1) & (F.col("game_date") == F.col("_last_date"))
    one = F.col("_n") == 1
    fitted = games.withColumn("team_id", F.when(one, F.col("team_id"))).withColumn("_fit", one | F.coalesce(added, F.lit(False)))
    fault = F.when(faulty, F.col("fault")).when(~F.col("_fit"), "ambiguous_team_splits")
    copies = F.explode(F.array_repeat(fault, F.when(faulty, F.col("_n")).otherwise(1).cast("int")))
    return fitted.select("game_id", *keep, "position", "game_date", "game_type", "league_id", "team_id", *vector, copies.alias("fault"))


def hitting_game_log(documents: DataFrame, text: str, keep: Sequence[str] = ("player_id", "sport_id")) -> tuple[DataFrame, DataFrame]:
    """(games of ``game_log_rows`` without fault, faults)."""
    games = game_log_rows(documents, text, keep)
    return games.where("fault is null").drop("position", "fault"), games.where("fault is not null").select(*keep, "position", "fault")
