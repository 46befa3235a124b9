import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from playmetrics.operators import sizing
from playmetrics.sources import schemas, sinks, tables


@pytest.fixture
def plays(spark):
    rows = [(s, f"g{i}", float(i)) for i, s in enumerate([2000, 2001, 2001, 2002])]
    return spark.createDataFrame(rows, "season int, game_id string, epa double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_season_filter_prunes_folders(spark, plays, tmp_path):
    path = str(tmp_path / "plays")
    sinks.write_seasons(plays, path)
    got = tables.load_plays(spark, path, range(2001, 2002))
    assert got.count() == 2
    assert "PartitionFilters: [isnotnull(season" in plan(got) or "PartitionFilters: [(season" in plan(got)
    assert tables.load_plays(spark, path).count() == 4


def test_filter_and_columns_reach_the_scan(spark, plays, tmp_path):
    path = str(tmp_path / "plays.parquet")
    plays.write.parquet(path)
    got = tables.load_plays(spark, path, [2001]).select("epa")
    assert "PushedFilters: [IsNotNull(season), EqualTo(season,2001)]" in plan(got) or "In(season, [2001])" in plan(got)
    assert "ReadSchema: struct<season:int,epa:double>" in plan(got)


def test_declared_schema(spark, plays, tmp_path):
    path = str(tmp_path / "plays.parquet")
    plays.write.parquet(path)
    got = tables.load_plays(spark, path, schema=schemas.PLAYS)
    assert got.count() == 4 and "wpa" in got.columns
    assert dict(tables.schema_rows(got))["epa"] == "double"


def test_merge_twice_is_once_and_leaves_other_seasons(spark, plays, tmp_path):
    path = str(tmp_path / "plays")
    sinks.write_seasons(plays, path)
    untouched = sorted(p.name for p in (tmp_path / "plays" / "season=2000").glob("*.parquet"))
    new = spark.createDataFrame([("n", 2001, 9, "more")], "game_id string, season int, epa int, extra string")
    for _ in range(2):
        got = sinks.merge_seasons(spark, path, new)
        rows = sorted((r["season"], r["game_id"], r["epa"]) for r in got.collect())
        assert rows == [(2000, "g0", 0.0), (2001, "n", 9.0), (2002, "g3", 3.0)]
    assert untouched == sorted(p.name for p in (tmp_path / "plays" / "season=2000").glob("*.parquet"))


def test_merge_refuses_to_lose_a_column(spark, plays, tmp_path):
    path = str(tmp_path / "plays")
    sinks.write_seasons(plays, path)
    with pytest.raises(ValueError, match="epa"):
        sinks.merge_seasons(spark, path, plays.drop("epa"))


def test_core_tables_and_views(spark, plays, tmp_path):
    for name in ("plays", "schedules", "players"):
        plays.write.parquet(str(tmp_path / f"{name}.parquet"))
    paths = [str(tmp_path / f"{n}.parquet") for n in ("plays", "schedules", "players")]
    core = tables.load_core(spark, *paths, seasons=[2001], views=True)
    assert {n: df.count() for n, df in core.items()} == {"plays": 2, "schedules": 2, "players": 4}
    assert spark.sql("SELECT count(*) FROM players").first()[0] == 4
    for name in core:
        spark.catalog.dropTempView(name)


def test_tracking_stats(spark, plays, tmp_path):
    plays.write.parquet(str(tmp_path / "nextgen_rushing.parquet"))
    assert tables.load_tracking_stats(spark, str(tmp_path), "rushing", [2002]).count() == 1
    with pytest.raises(ValueError, match="stat_type"):
        tables.load_tracking_stats(spark, str(tmp_path), "kicking")
    with pytest.raises(AnalysisException):
        tables.load_tracking_stats(spark, str(tmp_path), "passing")


def test_final_games(spark):
    games = spark.createDataFrame([("SB", 1), ("REG", 2), (None, 3)], "game_type string, game_id int")
    assert [r["game_id"] for r in tables.final_games(games).collect()] == [1]


def test_ratings_csv(spark, tmp_path):
    header = ",".join(c.split()[0] for c in schemas.RATINGS.replace("\n", " ").split(","))
    path = tmp_path / "ratings.csv"
    path.write_text(header + "\n2023,LVIII,Pat Example,QB,KC,99,82,99,97,96,72,89,91,0,0\n\n")
    row = tables.load_ratings(spark, str(path)).collect()
    assert len(row) == 1 and row[0]["overall"] == 99 and row[0]["season"] == 2023


def test_roster_team_comes_from_the_file_name(spark, tmp_path):
    header = ",".join(c.split()[0] for c in schemas.ROSTER.replace("\n", " ").split(","))
    numbers = ",".join(["80"] * 11)
    names = ["Player Data - Some Team.csv", "Others.csv", "A - B-C.csv"]
    for name in names:
        (tmp_path / name).write_text(f"{header}\nD. Example,QB,{numbers}\nE. Example,HB,{numbers}\n")
    got = tables.load_rosters(spark, [str(tmp_path / n) for n in names])
    assert {r["team"] for r in got.collect()} == {"Some Team", "Others", "B-C"}
    assert got.count() == 6


def test_rosters_by_folder(spark, tmp_path):
    """Teams that look like numbers, hold signs of paths, or are unknown."""
    teams = ["KC", "49", "007", "A+B", "a b", "50%", "x/y=z", "é", None, ""]
    columns = schemas.ROSTER.replace("\n", " ")
    rows = [(f" P{i} ", "QB", i, *[None] * 10, t) for i, t in enumerate(teams * 2)]
    df = spark.createDataFrame(rows, f"{columns}, team string")
    sinks.write_rosters(df, str(tmp_path / "rosters"))
    got = tables.load_team_rosters(spark, str(tmp_path / "rosters"))
    assert got.columns == df.columns
    want = sorted((r[0], r[2], r[-1] or None) for r in rows)
    assert sorted((r["Player"], r["OVR"], r["team"]) for r in got.collect()) == want


def test_merge_names_what_it_drops(spark, tmp_path):
    path = str(tmp_path / "plays")
    sinks.write_seasons(spark.createDataFrame([(1, 2020)], "v int, season int"), path)
    with pytest.warns(UserWarning, match="extra"):
        sinks.merge_seasons(spark, path, spark.createDataFrame([(2, 7, 2021)], "v int, extra int, season int"))


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(" a ", 0.1, True), (None, None, False)], "s string, x double, b boolean")
    for kind in ("csv", "parquet"):
        got = sinks.write_results(df, str(tmp_path / kind), kind)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
        assert got.dtypes == df.dtypes


class Session:
    """What `shared_folder` asks a session for."""

    def __init__(self, master, setting=None):
        self.master, self.setting, self.folder = master, setting, None
        self.conf = self.sparkContext = self
        self.applicationId = "app-1"

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.setting or default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_comes_from_the_session():
    cluster = Session("yarn", "hdfs:///shared")
    assert sizing.shared_folder(cluster) == "hdfs:///shared" == cluster.folder
    assert sizing.scratch_path(cluster, "x").startswith("hdfs:///shared/app-1/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sizing.shared_folder(Session("yarn"))
    local = Session("local[4]")
    assert sizing.shared_folder(local) == sizing.shared_folder(local) == local.folder


def test_settled_rows_do_not_change(spark):
    df = sizing.settle(spark.range(100).withColumn("r", F.rand()))
    assert df.collect() == df.collect()
    assert "Rand" not in plan(df)


def test_full_table_stands_in_for_a_missing_one(spark, plays, tmp_path):
    slim, full = str(tmp_path / "slim"), str(tmp_path / "full")
    plays.write.parquet(full)
    assert tables.load_plays(spark, slim, [2001], full_path=full).count() == 2
    plays.limit(1).write.parquet(slim)
    assert tables.load_plays(spark, slim, full_path=full).count() == 1
    with pytest.raises(AnalysisException):
        tables.load_plays(spark, str(tmp_path / "none"))


def test_a_large_season_is_written_by_many_tasks(spark, tmp_path):
    """Rebalancing splits the season that holds most rows and leaves the others few files."""
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.shuffle.partitions": "20",
    }
    before = {k: spark.conf.get(k) for k in settings}
    df = spark.range(0, 300_000, 1, 12).select(
        F.when(F.col("id") % 3 > 0, 2000).otherwise(2001 + F.col("id") % 10).cast("int").alias("season"),
        F.xxhash64("id").alias("noise"),
    )
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = sinks.write_seasons(df, str(tmp_path / "plays"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "plays").glob("season=*")}
    assert files["season=2000"] > 4
    # Without rebalancing each of the twelve tasks would write a file per season.
    assert all(n < 12 for name, n in files.items() if name != "season=2000")
    assert got.count() == 300_000
