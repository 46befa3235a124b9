"""Lookup tables and texts of the domain."""

from __future__ import annotations

from typing import NamedTuple

# Team codes of the ratings source and their standard codes.
TEAM_CODES = {
    "TAM": "TB",
    "LVR": "LV",
    "LAR": "LA",
    "GNB": "GB",
    "KAN": "KC",
    "NWE": "NE",
    "NOR": "NO",
    "SFO": "SF",
    "OAK": "LV",
    "STL": "LA",
    "SDG": "LAC",
    "JAC": "JAX",
}

# Standard code back to the ratings code; where two share one, the later entry counts.
RATINGS_TEAM_CODES = {standard: code for code, standard in TEAM_CODES.items()}

# Position names and codes with their standard code.
POSITION_CODES = {
    "QUARTERBACK": "QB",
    "HALFBACK": "RB",
    "FULLBACK": "FB",
    "WIDE RECEIVER": "WR",
    "TIGHT END": "TE",
    "LEFT TACKLE": "OT",
    "RIGHT TACKLE": "OT",
    "LEFT GUARD": "OG",
    "RIGHT GUARD": "OG",
    "CENTER": "C",
    "LEFT END": "DE",
    "RIGHT END": "DE",
    "DEFENSIVE TACKLE": "DT",
    "OUTSIDE LINEBACKER": "OLB",
    "MIDDLE LINEBACKER": "MLB",
    "INSIDE LINEBACKER": "ILB",
    "CORNERBACK": "CB",
    "FREE SAFETY": "FS",
    "STRONG SAFETY": "SS",
    "KICKER": "K",
    "PUNTER": "P",
    "HB": "RB",
    "SS": "S",
    "FS": "S",
    "OLB": "LB",
    "MLB": "LB",
    "ILB": "LB",
    "RE": "DE",
    "LE": "DE",
    "LT": "OT",
    "RT": "OT",
    "LG": "OG",
    "RG": "OG",
}

# The columns of the matchup model, in model order.
MATCHUP_FEATURES = [
    "off_epa_diff",
    "def_epa_diff",
    "pass_epa_diff",
    "rush_epa_diff",
    "success_rate_diff",
    "explosive_rate_diff",
    "redzone_epa_diff",
    "third_down_epa_diff",
    "turnover_diff",
    "playoff_epa_diff",
    "qb_ovr_diff",
    "avg_ovr_diff",
    "max_ovr_diff",
    "spread_line",
    "total_line",
    "implied_win_prob",
]


class Meaning(NamedTuple):
    name: str
    description: str
    positive: str
    negative: str


# What each feature is called, what it measures, and what its sign says.
FEATURE_MEANINGS = {
    "off_epa_diff": Meaning(
        "Offensive Efficiency",
        "Overall offensive performance difference (higher = better offense)",
        "Home team has a more efficient offense",
        "Away team has a more efficient offense",
    ),
    "def_epa_diff": Meaning(
        "Defensive Efficiency",
        "Points allowed per play difference (lower/negative = better defense)",
        "Home team allows more points (worse defense)",
        "Home team allows fewer points (better defense)",
    ),
    "pass_epa_diff": Meaning(
        "Passing Attack",
        "Passing game efficiency difference",
        "Home team has a stronger passing game",
        "Away team has a stronger passing game",
    ),
    "rush_epa_diff": Meaning(
        "Running Game",
        "Rushing efficiency difference",
        "Home team has a more effective running game",
        "Away team has a more effective running game",
    ),
    "success_rate_diff": Meaning(
        "Consistency",
        "Percentage of plays that gain positive yards/value",
        "Home team is more consistent on every play",
        "Away team is more consistent on every play",
    ),
    "explosive_rate_diff": Meaning(
        "Big Play Ability",
        "Rate of explosive/chunk plays",
        "Home team generates more big plays",
        "Away team generates more big plays",
    ),
    "redzone_epa_diff": Meaning(
        "Red Zone Scoring",
        "Efficiency when close to the end zone (inside 20 yards)",
        "Home team is better at finishing drives with touchdowns",
        "Away team is better at finishing drives with touchdowns",
    ),
    "third_down_epa_diff": Meaning(
        "Third Down Conversions",
        "Ability to convert crucial third down plays",
        "Home team is better at keeping drives alive",
        "Away team is better at keeping drives alive",
    ),
    "turnover_diff": Meaning(
        "Ball Security",
        "Net turnovers (interceptions + fumbles forced - turnovers committed)",
        "Home team wins the turnover battle",
        "Away team wins the turnover battle",
    ),
    "playoff_epa_diff": Meaning(
        "Playoff Experience",
        "Performance in playoff games this season",
        "Home team performed better in the playoffs",
        "Away team performed better in the playoffs",
    ),
    "qb_ovr_diff": Meaning(
        "Quarterback Rating",
        "Madden video game QB rating (subjective expert assessment)",
        "Home team has a higher-rated quarterback",
        "Away team has a higher-rated quarterback",
    ),
    "avg_ovr_diff": Meaning(
        "Team Roster Strength",
        "Average player rating across the roster",
        "Home team has a stronger overall roster",
        "Away team has a stronger overall roster",
    ),
    "max_ovr_diff": Meaning(
        "Star Power",
        "Rating of the best player on each team",
        "Home team has a higher-rated star player",
        "Away team has a higher-rated star player",
    ),
    "spread_line": Meaning(
        "Vegas Spread",
        "Point spread set by oddsmakers (negative = home favored)",
        "Away team is favored by Vegas",
        "Home team is favored by Vegas",
    ),
    "total_line": Meaning(
        "Expected Total Points",
        "Over/under total points (higher = expected high-scoring game)",
        "Game expected to be high-scoring",
        "Game expected to be low-scoring",
    ),
    "implied_win_prob": Meaning(
        "Vegas Implied Probability",
        "Win probability derived from betting lines",
        "Betting markets favor home team",
        "Betting markets favor away team",
    ),
}

# Per feature the clause about the favoured team and a short name for it.
FEATURE_PHRASES = {
    "off_epa_diff": ("moved the ball more efficiently on offense", "offensive efficiency"),
    "def_epa_diff": ("limited opposing offenses more effectively", "defensive performance"),
    "pass_epa_diff": ("dominated through the air with superior passing", "passing attack"),
    "rush_epa_diff": ("established the ground game with a stronger rushing attack", "running game"),
    "success_rate_diff": ("executed more consistently on every snap", "play-by-play consistency"),
    "explosive_rate_diff": ("created more explosive chunk plays", "big-play ability"),
    "redzone_epa_diff": ("converted red zone trips into touchdowns more efficiently", "red zone scoring"),
    "third_down_epa_diff": ("sustained drives by converting on third down", "third down execution"),
    "turnover_diff": ("won the turnover battle with better ball security", "turnover margin"),
    "playoff_epa_diff": ("elevated their play during the postseason", "playoff performance"),
    "qb_ovr_diff": ("has the edge at quarterback, the game's most important position", "quarterback advantage"),
    "avg_ovr_diff": ("fields a deeper and more talented roster overall", "roster depth"),
    "max_ovr_diff": ("boasts the best individual playmaker on the field", "star power"),
    "spread_line": ("has the confidence of oddsmakers", "Vegas backing"),
    "total_line": ("projects for a high-scoring affair", "game pace"),
    "implied_win_prob": ("is favored by betting markets", "market sentiment"),
}

# How a team code reads in a sentence; other codes stand for themselves.
TEAM_NAMES = {
    "KC": "Kansas City",
    "PHI": "Philadelphia",
    "SF": "San Francisco",
    "TB": "Tampa Bay",
    "LAR": "the Rams",
    "CIN": "Cincinnati",
    "NE": "New England",
    "ATL": "Atlanta",
    "DEN": "Denver",
    "CAR": "Carolina",
    "SEA": "Seattle",
    "GB": "Green Bay",
    "NYG": "the Giants",
    "BAL": "Baltimore",
    "NO": "New Orleans",
    "PIT": "Pittsburgh",
    "ARI": "Arizona",
    "IND": "Indianapolis",
    "CHI": "Chicago",
    "DAL": "Dallas",
    "BUF": "Buffalo",
    "MIA": "Miami",
    "MIN": "Minnesota",
    "DET": "Detroit",
    "LV": "Las Vegas",
    "LAC": "the Chargers",
    "NYJ": "the Jets",
    "CLE": "Cleveland",
    "HOU": "Houston",
    "TEN": "Tennessee",
    "JAX": "Jacksonville",
    "WAS": "Washington",
}
