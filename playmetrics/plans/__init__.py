"""Whole analyses built from the operators: seasons, teams, matchups, models, texts."""
