import pytest
from pyspark.sql import functions as F

from spanweave.functions import levels, names, texts, timecode


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "fps", "seconds"),
    [("12.5", None, 12.5), ("7", None, 7.0), ("1:02:03", None, 3723.0), ("02:03", None, 123.0), ("00:00:01.5", None, 1.5), ("00:00:01,05", None, 1.05), ("00:00:01:12", 24.0, 1.5), ("00:00:01:12", None, None), ("1;2;3", None, 3723.0), ("", None, None), ("x", None, None), ("1:2:3:4:5", 24.0, None), (None, None, None)],
)
def test_timecodes(spark, text, fps, seconds):
    assert one(spark, timecode.parse_timecode(F.lit(text), fps)) == seconds


def test_samples(spark):
    for tc, n in [("00:00:00:01", 1920), ("00:00:01:00", 48_000), ("00:07:07:00", 20_496_000)]:
        assert one(spark, timecode.samples(F.lit(tc))) == n
    for tc in ["00:00:00:25", "00:60:00:00", "1:2:3", ""]:
        with pytest.raises(Exception, match="not a time code"):
            one(spark, timecode.samples(F.lit(tc)))


def test_formats(spark):
    assert one(spark, timecode.hms(F.lit(3723.46))) == "01:02:03.5"
    assert one(spark, timecode.smpte(F.lit(1.999))) == "00:00:02:00"
    assert [one(spark, timecode.infer_fps(F.lit(f))) for f in (23, 24, 29, 47, 59, 70)] == [24.0, 25.0, 30.0, 48.0, 60.0, 30.0]


def test_names(spark):
    assert one(spark, names.canonical_key(F.lit(" Dr. Who-2 "))) == "dr_who_2"
    assert one(spark, names.speakers(F.lit("Amane/Shoma [narration] & amane (V.O)"))) == ["amane", "shoma"]
    assert one(spark, names.episode_number(F.lit("Show EP 041 final"))) == 41
    assert one(spark, names.episode_number(F.lit("step 12"))) is None
    assert one(spark, names.slug(F.lit("my DUB show-two"))) == "My-DUB-Show-Two" and one(spark, names.slug(F.lit("HEROES (2023)"))) == "Heroes-2023"
    day = F.lit("2024-03-01").cast("date")
    assert [one(spark, names.output_name(F.lit(a), F.lit(b), "QC-Report", day)) for a, b in (("a b", "7"), ("", "123"), (None, "pilot x"))] == ["A-B_EP07_QC-Report_2024-03-01", "EP123_QC-Report_2024-03-01", "Pilot-X_QC-Report_2024-03-01"]
    asked = {" Help ": "help", "my runs": "history", "is it done": "status", "run status": "run", "anything new?": "scan", "are the audio files delivered for ep 4": "audio_check", "start the scriptless compare": "audio_run", "yes": "run", "episode #12": "check", "hello": None}
    assert {t: one(spark, names.command(F.lit(t))) for t in asked} == asked
    assert one(spark, names.common_prefix(F.lit("EP1_a"), F.lit("EP1_b"))) == "EP1_"
    assert one(spark, names.cut_prefix(F.lit("Show - EP1_ab"))) == "Show - "
    assert one(spark, names.cut_prefix(F.lit("EP1_ab"))) == "EP1_"


def test_texts(spark):
    assert one(spark, texts.songlike(F.lit("la la la la la la la la")))
    assert not one(spark, texts.songlike(F.lit("a line of seven quite distinct words")))
    assert one(spark, texts.content_words(F.lit("Eu sei, que eu já"))) == ["eu", "sei", "que", "já"]
    q = lambda **k: F.struct(*(F.lit(v).alias(n) for n, v in ({"nsp": 0.1, "alp": -0.5, "cr": 1.2, "engine": "x"} | k).items()))
    say = lambda quality, text="a b": one(spark, texts.reliable(quality, F.lit(text)))
    assert say(q()) and not say(q(nsp=0.5)) and not say(q(cr=2.5)) and not say(q(cr=1.8, engine="sarvam")) and not say(q(alp=-0.4, engine="scribe"))
    assert not say(q(alp=-1.3)) and say(q(alp=-1.3), "a b c d")


def test_levels(spark):
    assert [one(spark, levels.clamp(F.lit(x), 3.0)) for x in (-5.0, 1.5, 9.0)] == [-3.0, 1.5, 3.0]
    assert one(spark, levels.decibels(F.lit(0.0))) == -180.0 and one(spark, levels.decibels(F.lit(0.5))) == -6.0
    assert [one(spark, levels.tolerated_coverage(F.lit(t))) for t in (0.5, 1.0, 2.0, 0.0)] == [0.75, 0.5, 0.2, 0.8]


def test_episode_grammars(spark):
    """name, number of the name, of a folder, as watched, and range."""
    cases = [
        ("Show_#07_SCLA", 7, None, 7, None), ("# 9 x", None, None, 9, None), ("a#1234", 1234, None, 123, None), ("EP 40", 40, 40, 40, None), ("MAL_SHOW_EPI 040_FOR AI", 40, 40, None, None), ("MALEPI40", None, 40, None, None),
        ("Episode - 12", 12, 12, 12, None), ("episod 3", None, 3, None, None), ("EP_320", 320, 320, 320, None), ("EP3201", 3201, 3201, None, None), ("S1_E40", 40, None, None, None), ("Rider2", None, None, None, None), ("Step 2", None, 2, None, None),
        ("E5e6", 5, None, None, None), ("2E7", None, None, None, None), ("EP\t8", 8, 8, 8, None), ("EP 9x", 9, 9, None, None), ("12EP9", 9, 9, None, None), ("EP 41 to 45", 41, 41, 41, (41, 45)), ("41-45", None, None, None, (41, 45)), ("1 – 2", None, None, None, (1, 2)),
        ("4 of 5", None, None, None, None), ("", None, None, None, None), ("EP--4", None, None, None, None), ("X EP 1, #2", 2, 1, 2, None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "n string")
    n = F.col("n")
    got = df.select("n", names.episode_number(n).alias("a"), names.folder_episode(n).alias("b"), names.watched_episode(n).alias("w"), names.episode_range(n).alias("r")).collect()
    for case, r in zip(cases, got, strict=True):
        assert (r.n, r.a, r.b, r.w, tuple(r.r) if r.r else None) == case
    held = df.where(names.names_episode(n, F.lit(40))).collect()
    assert {r.n for r in held} == {"EP 40", "MAL_SHOW_EPI 040_FOR AI", "MALEPI40", "S1_E40"}


def test_commands(spark):
    said = {
        "Help": "help", "what can you do?": "help", "my runs": "history", "help me": None, "is it done yet": "status", "is the check done": None, "what's new?": "scan", "any uploads": "scan", "check the audio files": "audio_check", "no-script qc": "audio_check",
        "run scriptless": "audio_run", "compare mixes": "audio_run", "yes": "run", "do it": "run", "go ahead": "run", "ep 42": "check", "ep42 please": "check", "number 1234": None, "7": "check", "hello": None, "status of the run": "run", "": None, "start check of 5": "run",
    }
    df = spark.createDataFrame([(k,) for k in said], "t string")
    assert {r.t: r.c for r in df.select("t", names.command(F.col("t")).alias("c")).collect()} == said
