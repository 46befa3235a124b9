"""Row-wise expressions. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from playmetrics.functions.codes import (
    MATCHUP_FEATURES,
    POSITION_CODES,
    RATINGS_TEAM_CODES,
    TEAM_CODES,
)

# Name suffix and name shape patterns. `(?U)` makes \w and \s cover all of
# Unicode and \z is the end of the text only.
SUFFIX = r"(?U)\s+(JR\.?|SR\.?|III|II|IV|V)\z"
PUNCTUATION = r"['\-\.]"
OUTER_BLANKS = r"(?U)^\s+|\s+\z"
FIRST_WORD_REST = r"(?U)^(\w)\w*\s+"
BLANKS = r"(?U)\s+"
FIRST_WORD = r"(?U)^(\w+)"
LAST_WORD = r"(?U)\s(\w+)\z"


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    """Drop blanks of every kind at both ends (`trim` drops spaces only)."""
    return F.regexp_replace(as_column(col), OUTER_BLANKS, "")


def literal_map(entries: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def recode(key: Column, entries: Mapping[str, str], otherwise: Column) -> Column:
    """One lookup of `key`; `otherwise` where the table has no entry."""
    if not entries:
        return otherwise
    return F.coalesce(literal_map(entries)[key], otherwise)


def fill(col: Column | str, value: object) -> Column:
    return F.coalesce(as_column(col), F.lit(value))


def clip(col: Column | str, low: float, high: float) -> Column:
    """Bound a value; NULL stays NULL (`greatest` and `least` alone would give a bound)."""
    c = as_column(col)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


# --- names and codes ---------------------------------------------------------------


def normalize_player_name(name: Column | str) -> Column:
    """Key for matching names: `Patrick Mahomes II` and `P.Mahomes` both give `PMAHOMES`.

    The suffix goes before the blanks are stripped, so a trailing blank protects it, and
    only the first of three or more words is shortened.
    """
    key = F.regexp_replace(F.upper(as_column(name)), SUFFIX, "")
    key = strip(F.regexp_replace(key, PUNCTUATION, ""))
    key = F.regexp_replace(key, FIRST_WORD_REST, "$1")
    return F.regexp_replace(key, BLANKS, "")


def letters_only_name(name: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.upper(as_column(name)), "[^A-Z ]", ""))


def extract_first_last_name(name: Column | str) -> tuple[Column, Column]:
    """First and last word, NULL where there is none."""
    c = as_column(name)
    empty = F.lit("")
    return (
        F.nullif(F.regexp_extract(c, FIRST_WORD, 1), empty),
        F.nullif(F.regexp_extract(c, LAST_WORD, 1), empty),
    )


def standardize_team_abbr(team: Column | str, source: str = "ratings") -> Column:
    """Standard team code. Only codes of the ratings source differ from the standard."""
    c = as_column(team)
    return recode(c, TEAM_CODES if source == "ratings" else {}, c)


def ratings_team_abbr(team: Column | str) -> Column:
    c = as_column(team)
    return recode(c, RATINGS_TEAM_CODES, c)


def standardize_position(position: Column | str) -> Column:
    """Standard position code, applied once; an unknown value keeps its own case."""
    c = as_column(position)
    return recode(F.upper(c), POSITION_CODES, c)


# --- games -------------------------------------------------------------------------


def categorize_environment(roof: Column | str) -> Column:
    indoor = F.lower(as_column(roof)).isin("dome", "closed")
    return F.when(indoor, F.lit("Indoor")).otherwise(F.lit("Outdoor"))


def in_dome(roof: Column | str) -> Column:
    return F.lower(as_column(roof)) == "dome"


def adjusted_temp(roof: Column | str = "roof", temp: Column | str = "temp") -> Column:
    return F.when(in_dome(roof), F.lit(72.0)).otherwise(as_column(temp))


def adjusted_wind(roof: Column | str = "roof", wind: Column | str = "wind") -> Column:
    return F.when(in_dome(roof), F.lit(0.0)).otherwise(as_column(wind))


def weather_impact_score(
    roof: Column | str = "roof", temp: Column | str = "temp", wind: Column | str = "wind"
) -> Column:
    """Cold below 40 and wind above 15 count; `greatest` skips a missing value."""
    cold = F.greatest(F.lit(0.0), F.lit(40.0) - as_column(temp)) / 10
    windy = F.greatest(F.lit(0.0), as_column(wind) - F.lit(15.0)) / 5
    return F.when(in_dome(roof), F.lit(0.0)).otherwise(cold + windy)


def cover_margin(home_score: Column | str, away_score: Column | str, spread: Column | str) -> Column:
    """Home margin plus spread: the side is always the home team's."""
    return as_column(home_score) - as_column(away_score) + as_column(spread)


def classify_ats_result(margin: Column | str) -> Column:
    m = as_column(margin)
    return F.when(m > 0, "Favorite Cover").when(m < 0, "Underdog Cover").otherwise("Push")


def total_result(home_score: Column | str, away_score: Column | str, line: Column | str) -> Column:
    points, bar = as_column(home_score) + as_column(away_score), as_column(line)
    return F.when(points > bar, "Over").when(points < bar, "Under").otherwise("Push")


def game_winner(
    home_team: Column | str = "home_team",
    away_team: Column | str = "away_team",
    home_score: Column | str = "home_score",
    away_score: Column | str = "away_score",
) -> Column:
    """The home team if it scored more; a tie or a missing score goes to the away team."""
    home_won = as_column(home_score) > as_column(away_score)
    return F.when(home_won, as_column(home_team)).otherwise(as_column(away_team))


def game_outcomes(
    home_score: Column | str = "home_score", away_score: Column | str = "away_score"
) -> dict[str, Column]:
    """The six outcome columns, for `withColumns`."""
    home, away = as_column(home_score), as_column(away_score)
    margin = F.abs(home - away)
    return {
        "total_points": home + away,
        "margin": margin,
        "home_digit": F.pmod(home, F.lit(10)),
        "away_digit": F.pmod(away, F.lit(10)),
        "one_score_game": margin <= 7,
        "blowout": margin >= 14,
    }


def next_season_changes(
    value: Column | str = "epa_current_season",
    value_next: Column | str = "epa_next_season",
    games: Column | str = "games_current",
    games_next: Column | str = "games_next",
    rating: Column | str = "rating_current",
    rating_next: Column | str = "rating_next",
) -> dict[str, Column]:
    """Changes to the next season, for `withColumns` on the output of `season_pairs`."""
    return {
        "epa_change": as_column(value_next) - as_column(value),
        "games_lost": as_column(games) - as_column(games_next),
        "rating_change": as_column(rating_next) - as_column(rating),
    }


# --- ratios and probabilities ------------------------------------------------------


def epa_per_play(total: Column | str = "total_epa", plays: Column | str = "plays") -> Column:
    """Total per play; NULL for zero plays."""
    return F.try_divide(as_column(total), as_column(plays))


def spread_to_win_prob(spread: Column | str) -> Column:
    return clip(F.lit(0.5) - as_column(spread) / 14, 0.05, 0.95)


def shrunk_probability(probability: Column | str) -> Column:
    """Pull a probability into [0.15, 0.85]."""
    return F.lit(0.15) + F.lit(0.70) * as_column(probability)


# --- features ----------------------------------------------------------------------


def feature_category(feature: Column | str) -> Column:
    c = as_column(feature)
    market = c.contains("spread") | c.contains("total") | c.contains("implied")
    return (
        F.when(c.contains("ovr"), "Madden Rating")
        .when(market, "Vegas Market")
        .otherwise("PBP/EPA Stats")
    )


def readable_feature(feature: Column | str) -> Column:
    shorter = F.replace(as_column(feature), F.lit("_diff"), F.lit(""))
    return F.initcap(F.replace(shorter, F.lit("_"), F.lit(" ")))


def matchup_feature_columns() -> list[str]:
    return list(MATCHUP_FEATURES)
