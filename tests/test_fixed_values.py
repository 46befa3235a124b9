"""Fixed tables and texts must not change by accident: a changed word or code fails here."""

import hashlib
import json

import pytest

from playmetrics.functions import codes

DIGESTS = {
    "FEATURE_MEANINGS": "e45633744ff251e2",
    "FEATURE_PHRASES": "494971a3339353e2",
    "MATCHUP_FEATURES": "5aa2ba043b4ab2d3",
    "POSITION_CODES": "f4059bec98aa7c27",
    "RATINGS_TEAM_CODES": "7bebc3348686f051",
    "TEAM_CODES": "431ace1badcfdd55",
    "TEAM_NAMES": "54c189342df8deaa",
}

# fmt: off
TEAM_CODES = {"TAM": "TB", "LVR": "LV", "LAR": "LA", "GNB": "GB", "KAN": "KC", "NWE": "NE", "NOR": "NO", "SFO": "SF", "OAK": "LV", "STL": "LA", "SDG": "LAC", "JAC": "JAX"}
# fmt: on


def digest(value):
    text = json.dumps(value, ensure_ascii=False, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


@pytest.mark.parametrize("name", list(DIGESTS))
def test_fixed_value(name):
    assert digest(getattr(codes, name)) == DIGESTS[name]


def test_every_fixed_value_is_listed():
    assert {n for n in dir(codes) if n.isupper()} == set(DIGESTS)


def test_team_codes():
    assert codes.TEAM_CODES == TEAM_CODES
